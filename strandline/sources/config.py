"""Panel, pipeline and barcode configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.functions import sequence as S
from strandline.schemas import BARCODES, TARGETS, CallParams, PanelConfig, Target


def _value(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_sections(text: str) -> dict:
    """A small YAML subset: sections, ``key: value`` lines, ``- key: value`` items and ``[a, b]`` lists."""
    out: dict = {}
    section, item = None, None
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip()
        if not line.strip():
            continue
        bare = line.strip()
        if not line[0].isspace() and not bare.startswith("-"):
            key, _, value = bare.partition(":")
            section, item = key.strip(), None
            out[section] = _value(value) if value.strip() else {}
            continue
        if bare.startswith("-"):
            if not isinstance(out.get(section), list):
                out[section] = []
            item = {}
            out[section].append(item)
            bare = bare[1:].strip()
            if not bare:
                continue
        key, _, value = bare.partition(":")
        (item if item is not None else out[section])[key.strip()] = _value(value)
    return out


def panel_from_string(text: str) -> PanelConfig:
    found = parse_sections(text)
    targets = []
    for t in found.get("targets", found.get("amplicons", [])) or []:
        marks = t.get("snp_positions", [])
        targets.append(Target(str(t.get("amplicon_id", "")), str(t.get("chromosome", "")), int(t.get("start", 0)), int(t.get("end", 0)), str(t.get("primer_fwd", "")), str(t.get("primer_rev", "")), int(t.get("expected_length", 0)), tuple(marks if isinstance(marks, list) else [marks])))
    call = found.get("variant_calling", {})
    params = CallParams(int(call.get("min_depth", 100)), float(call.get("min_allele_frequency", 0.01)), int(call.get("min_base_quality", 20)))
    reference = found.get("reference", "")
    return PanelConfig(tuple(targets), reference if isinstance(reference, str) else str(reference.get("fasta", "")), int(found.get("collapse", {}).get("max_distance", 2)), params)


def load_panel(path: str) -> PanelConfig:
    with open(path) as f:
        return panel_from_string(f.read())


def problems(config: PanelConfig) -> list[str]:
    """What makes a panel unusable; empty if nothing does."""
    out = [] if config.targets else ["no targets"]
    out += [f"target {i} ({t.amplicon_id or 'unnamed'}) lacks an id, a chromosome or a positive length" for i, t in enumerate(config.targets) if not t.is_valid()]
    ids = [t.amplicon_id for t in config.targets]
    return out + [f"target id {x} repeats" for x in sorted({x for x in ids if ids.count(x) > 1})]


EXAMPLE = """reference: reference.fa
collapse:
  max_distance: 2
variant_calling:
  min_depth: 100
  min_allele_frequency: 0.01
  min_base_quality: 20
targets:
  - amplicon_id: "AMP_001"
    chromosome: chr1
    start: 1000
    end: 1200
    primer_fwd: ACGTACGTAC
    primer_rev: GCTAGCTAGC
    expected_length: 200
    snp_positions: [1050, 1100]
"""


def write_example(path: str) -> None:
    with open(path, "w") as f:
        f.write(EXAMPLE)


def targets_frame(spark: SparkSession, config: PanelConfig) -> DataFrame:
    rows = [(t.amplicon_id, t.chromosome, t.start, t.end, t.primer_fwd, t.primer_rev, t.expected_length, list(t.snp_positions), i) for i, t in enumerate(config.targets) if t.is_valid()]
    return spark.createDataFrame(rows, TARGETS + ", ord bigint")


PIPELINE_KEYS = {"reference": str, "reads1": str, "reads2": str, "output": str, "metrics": str, "batch_size": int, "kmer_size": int, "min_mapq": int, "threads": int, "mark_duplicates": bool, "sort": bool, "index": bool}


def load_pipeline(path: str) -> dict:
    """``key=value`` lines with # comments; unknown keys and bad values are errors."""
    out = {}
    with open(path) as f:
        for n, raw in enumerate(f, 1):
            line = raw.split("#")[0].strip()
            if not line:
                continue
            key, eq, value = (x.strip() for x in line.partition("="))
            if not eq or key not in PIPELINE_KEYS:
                raise ValueError(f"line {n}: unknown setting {key!r}")
            kind = PIPELINE_KEYS[key]
            out[key] = value.lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
    if "batch_size" in out and not 1 <= out["batch_size"] <= 100_000:
        raise ValueError("batch_size must be between 1 and 100000")
    return out


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, barcode, expected_position, reverse_complement of a CSV; a header line is one that names sample_id."""
    rows = spark.read.schema(BARCODES).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.where("not contains(sample_id, 'sample_id') and barcode is not null").withColumn("reverse_complement", S.reverse_complement("barcode"))
