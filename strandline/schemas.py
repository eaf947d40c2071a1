"""Schemas and parameter sets."""

from __future__ import annotations

from dataclasses import dataclass, field

READS = "read_id bigint, name string, sequence string, quality string"
CONTIGS = "name string, ordinal int, sequence string"
TARGETS = "amplicon_id string, chromosome string, start bigint, end bigint, primer_fwd string, primer_rev string, expected_length int, snp_positions array<bigint>"
BARCODES = "sample_id string, barcode string, expected_position int"

PAIRED, PROPER, UNMAPPED, REVERSE, READ1, READ2, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x10, 0x40, 0x80, 0x100, 0x400, 0x800


@dataclass(frozen=True)
class SeedParams:
    k: int = 19
    stride: int = 6
    max_hits: int = 8
    max_seeds: int = 64
    #: Letters that a k-mer may have; None for any text.
    letters: str | None = "ACGT"

    def __post_init__(self):
        if not 10 <= self.k <= 32:
            raise ValueError("k must be between 10 and 32")


@dataclass(frozen=True)
class FilterParams:
    min_mapq: int = 0
    min_score: int = 0
    filter_secondary: bool = False
    filter_supplementary: bool = False


@dataclass(frozen=True)
class LocalParams:
    """Scores of the local aligner with traceback."""

    match: int = 2
    mismatch: int = -3
    gap_open: int = -5
    gap_extend: int = -2


@dataclass(frozen=True)
class BandedParams:
    """Scores of the banded aligner: linear gaps."""

    match: int = 1
    mismatch: int = -4
    gap: int = -6
    band: int = 64
    flank: int = 100
    max_length: int = 512


@dataclass(frozen=True)
class CallParams:
    min_depth: int = 100
    min_allele_frequency: float = 0.01
    min_base_quality: int = 20


@dataclass(frozen=True)
class DemuxParams:
    max_mismatches: int = 1
    region: int = 50
    min_quality: float = 20.0


@dataclass(frozen=True)
class TrimParams:
    max_mismatches: int = 2
    min_overlap: int = 10
    starts: int = 5


@dataclass(frozen=True)
class ChimeraParams:
    min_length: int = 60
    edge: int = 30
    step: int = 5
    max_distance: int = 10
    abundance_ratio: float = 2.0
    parents: int = 100


@dataclass(frozen=True)
class Target:
    amplicon_id: str
    chromosome: str
    start: int
    end: int
    primer_fwd: str = ""
    primer_rev: str = ""
    expected_length: int = 0
    snp_positions: tuple[int, ...] = ()

    def is_valid(self) -> bool:
        return bool(self.amplicon_id) and bool(self.chromosome) and self.start < self.end


@dataclass(frozen=True)
class PanelConfig:
    targets: tuple[Target, ...] = ()
    reference: str = ""
    max_distance: int = 2
    call: CallParams = field(default_factory=CallParams)

    def is_valid(self) -> bool:
        return bool(self.targets) and all(t.is_valid() for t in self.targets)
