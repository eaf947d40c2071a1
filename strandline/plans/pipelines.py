"""The two batch pipelines as plans: whole-genome reads to SAM rows, and amplicon reads to variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import align as A
from strandline.operators import amplicon as M
from strandline.schemas import BandedParams, CallParams, ChimeraParams, DemuxParams, FilterParams, SeedParams, TrimParams


@dataclass(frozen=True)
class Whole:
    """Results of ``align_reads``: SAM rows of every read, the alignments, and run metrics."""

    sam: DataFrame
    alignments: DataFrame
    metrics: DataFrame


def align_reads(reads: DataFrame, contigs: DataFrame, seeds: SeedParams = SeedParams(), banded: BandedParams | None = BandedParams(), keep: FilterParams | None = None, index: DataFrame | None = None, both_strands: bool = False) -> Whole:
    """Seed, chain, align and describe reads; SAM rows have the alignments' CIGARs. ``banded=None`` scores without gaps and stays in the JVM.

    With ``both_strands`` a read is tried as its reverse complement too and keeps the better score; SAM rows of such reads
    are turned and flagged.
    """
    index = A.kmer_index(contigs, seeds) if index is None else index
    how = (lambda *of: A.place_banded(*of, banded, trace=True)) if banded else A.place_ungapped
    place = lambda r: A.place_each_once(r, contigs, how, seeds, index)
    aligned = place(reads)
    if both_strands:
        back = reads.withColumn("sequence", S.reverse_complement("sequence")).withColumn("quality", F.reverse("quality"))
        other = place(back)
        both = aligned.withColumn("strand", F.lit(0)).unionByName(other.withColumn("strand", F.lit(1)))
        best = both.groupBy("read_id").agg(F.max(F.struct("score", -F.col("strand"))).alias("b")).selectExpr("read_id", "-b.col2 strand")
        aligned = both.join(best, ["read_id", "strand"])
    if keep:
        aligned = aligned.withColumn("flag", F.lit(0)).where(A.passes(keep)).drop("flag")
    sam = A.sam_rows(reads, aligned)
    return Whole(sam, aligned, A.run_metrics(sam))


@dataclass(frozen=True)
class Panel:
    """Results of ``call_panel``, one table for each stage that ran."""

    clusters: DataFrame
    assigned: DataFrame
    piles: DataFrame
    calls: DataFrame
    stats: DataFrame
    demux: DataFrame | None = None


def call_panel(reads: DataFrame, targets: DataFrame, contigs: DataFrame, call: CallParams = CallParams(), distance: int = 2, barcodes: DataFrame | None = None, demux: DemuxParams = DemuxParams(), trim: TrimParams | None = None, chimeras: ChimeraParams | None = None) -> Panel:
    """Demultiplex and trim where asked, collapse all reads, drop chimeras where asked, assign, pile up and call.

    A cluster lies at its target's start. Depth counts reads, not clusters.
    """
    split = None
    if barcodes is not None:
        split = M.demultiplex(reads, barcodes, demux)
        reads = split.where("sample_id is not null").select("read_id", "name", F.col("trimmed").alias("sequence"), F.substr("quality", F.length("quality") - F.length("trimmed") + 1, F.length("trimmed")).alias("quality"))
    if trim is not None:
        reads = M.trim_primers(reads, targets, trim).select("read_id", "name", F.col("trimmed_sequence").alias("sequence"), F.col("trimmed_quality").alias("quality"))
    clusters = M.merge_similar(M.collapse_exact(reads, ids=False), distance)
    if chimeras is not None:
        found = M.chimera_de_novo(clusters.selectExpr("consensus_sequence id", "consensus_sequence sequence", "read_count abundance"), M.chimera_parents(clusters, chimeras), chimeras)
        clusters = clusters.join(found.where("is_chimera").selectExpr("id consensus_sequence"), "consensus_sequence", "left_anti")
    assigned = M.assign(clusters, targets)
    placed = assigned.join(targets.select("amplicon_id", "chromosome", "start"), "amplicon_id").select("chromosome", "start", F.col("consensus_sequence").alias("sequence"), F.col("consensus_quality").alias("quality"), "read_count")
    marks = targets.select("chromosome", F.explode("snp_positions").alias("position")).distinct()
    marks = A.at_windows(marks.withColumnRenamed("chromosome", "contig"), contigs, "position", F.lit(1), A.TILE).select(F.col("contig").alias("chromosome"), "position", F.upper("window").alias("ref_base"))
    piles = M.pileup(placed, marks)
    calls = M.annotate_variants(M.call_variants(piles, call), targets)
    sizes = M.collapse_stats(reads, clusters).select("reads_in", "clusters_out", "compression_ratio", "avg_cluster_size")
    stats = M.panel_stats(clusters, assigned, placed, calls).join(sizes)  # one row each
    return Panel(clusters, assigned, piles, calls, stats, split)
