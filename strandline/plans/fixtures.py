"""Deterministic sequencing data derived from the driver tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = ("0123456789abcdef", "ACGTACGTACGTACGT")
PATTERN = "56789:;<=>?@ABCDEFGHI"  # qualities 20 to 40
SITES = (100, 300, 500, 700)
#: Barcodes of eight samples and one code that no sample has.
CODES = ("ATCGATCG", "GCTAGCAA", "TTGACCAG", "CAGTTGAC", "GGATCTCA", "AACCGTGT", "TGCATTCC", "CTAAGGTT", "TTTTTTTT")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark, sf_dir) -> DataFrame:
    return contigs_of(_t(spark, sf_dir, "nation"))


def contigs_of(nations: DataFrame) -> DataFrame:
    """25 contigs of 1,024 bases, from hashes of nation names."""
    piece = lambda i: F.translate(F.md5(F.concat("n_name", F.lit("-"), i.cast("string")).cast("binary")), *LETTERS)
    seq = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), piece), "")
    return nations.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ordinal"), seq.alias("sequence"))


def events(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events")


def truth(spark, sf_dir) -> DataFrame:
    return truth_of(_t(spark, sf_dir, "events"))


def truth_of(events: DataFrame) -> DataFrame:
    """read_id, planted contig (ordinal) and start of each read."""
    return events.select(F.col("event_id").alias("read_id"), F.expr("cast(user_id % 25 as int)").alias("ordinal"), F.expr("cast((user_id * 7 + event_id % 5 * 90) % 900 as int)").alias("start"), "event_type")


def _put(s, cond, base, at):
    """``s`` with one base replaced where the condition holds; ``s`` stands in the expression once."""
    return F.overlay(s, F.when(cond, base).otherwise(""), F.when(cond, at).otherwise(1), F.when(cond, 1).otherwise(0))


def reads(spark, sf_dir) -> DataFrame:
    return reads_of(_t(spark, sf_dir, "events"), contigs(spark, sf_dir))


def reads_of(events: DataFrame, contigs: DataFrame) -> DataFrame:
    """100 bases of each event's contig; base 41 forced to A for errors, and single-base variants planted at fixed places
    of the reference at rates by contig (none, half, nearly all)."""
    c = F.broadcast(contigs.select("ordinal", F.col("sequence").alias("ref")))  # 25 contigs
    r = truth_of(events).join(c, "ordinal").withColumn("s", F.substr("ref", F.col("start") + 1, F.lit(100)))
    for p in SITES:
        hit = (F.lit(p).between(F.col("start"), F.col("start") + 99)) & (F.expr(f"(read_id * 7 + {p}) % 10") < F.expr("case ordinal % 3 when 0 then 0 when 1 then 5 else 9 end"))
        at = F.lit(p) - F.col("start")
        alt = F.translate(F.substr("ref", F.lit(p + 1), F.lit(1)), "ACGT", "CGTA")
        r = r.withColumn("s", _put(F.col("s"), hit, alt, at + 1))
    r = r.withColumn("s", _put(F.col("s"), F.col("event_type") == "error", F.lit("A"), F.lit(42)))
    quality = F.substr(F.lit(PATTERN * 6), F.expr("cast(read_id % 21 as int) + 1"), F.lit(100))
    return r.select("read_id", F.concat(F.lit("ev"), F.col("read_id")).alias("name"), F.col("s").alias("sequence"), quality.alias("quality"))


def barcodes(spark) -> DataFrame:
    return spark.createDataFrame([(f"S{i}", c, 0) for i, c in enumerate(CODES[:8])], "sample_id string, barcode string, expected_position int")


def barcoded(spark, sf_dir) -> DataFrame:
    """Reads behind a barcode, with one base of it changed in every fourth."""
    code = F.get(F.array(*map(F.lit, CODES)), F.expr("cast(read_id % 9 as int)"))
    at = F.expr("cast(read_id % 8 as int)")
    bad = F.concat(F.substr(code, F.lit(1), at), F.translate(F.substr(code, at + 1, F.lit(1)), "ACGT", "GTAC"), F.substr(code, at + 2, F.lit(8)))
    r = reads(spark, sf_dir)
    return r.select("read_id", "name", F.concat(F.when(F.expr("read_id % 4 = 1"), bad).otherwise(code), "sequence").alias("sequence"), F.concat(F.lit("55555555"), "quality").alias("quality"))


def targets(spark, sf_dir) -> DataFrame:
    """One target of 200 bases for each contig: primers are its ends, markers the planted places within."""
    c = contigs(spark, sf_dir)
    start = F.expr("80")
    rev = F.reverse(F.translate(F.substring("sequence", 261, 20), "ATCG", "TAGC"))
    return c.select(F.concat(F.lit("AMP_"), F.lpad(F.col("ordinal").cast("string"), 3, "0")).alias("amplicon_id"), F.col("name").alias("chromosome"), start.cast("bigint").alias("start"), F.lit(280).cast("bigint").alias("end"), F.substring("sequence", 81, 20).alias("primer_fwd"), rev.alias("primer_rev"), F.lit(200).alias("expected_length"), F.array(F.lit(100).cast("bigint")).alias("snp_positions"), F.col("ordinal").cast("bigint").alias("ord"))


def markers(spark, sf_dir) -> DataFrame:
    return markers_of(contigs(spark, sf_dir))


def markers_of(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.col("name").alias("chromosome"), "sequence", F.explode(F.array(*map(F.lit, SITES))).alias("p")).select("chromosome", F.col("p").cast("bigint").alias("position"), F.substr("sequence", F.col("p") + 1, F.lit(1)).alias("ref_base"))


def placed(spark, sf_dir) -> DataFrame:
    """Reads at their planted places: chromosome, start, sequence, quality, read_count."""
    c = F.broadcast(contigs(spark, sf_dir).select("ordinal", F.col("name").alias("chromosome")))
    return reads(spark, sf_dir).join(truth(spark, sf_dir).select("read_id", "ordinal", F.col("start").cast("bigint").alias("start")), "read_id").join(c, "ordinal").select("read_id", "chromosome", "start", "sequence", "quality", F.lit(1).alias("read_count"))


def _planted(i: int) -> str:
    p = SITES[i]
    inner = "x0" if i == 0 else f"x{i}"
    src = "SELECT e.event_id read_id, e.event_type, c.ordinal, c.sequence ref, ((e.user_id * 7 + e.event_id % 5 * 90) % 900)::INT start, substr(c.sequence, ((e.user_id * 7 + e.event_id % 5 * 90) % 900)::INT + 1, 100) s FROM events e JOIN contigs c ON c.ordinal = e.user_id % 25" if i == 0 else f"SELECT * FROM {inner}"
    return f"""x{i + 1} AS (SELECT * REPLACE (CASE WHEN {p} BETWEEN start AND start + 99 AND (read_id * 7 + {p}) % 10 < CASE ordinal % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 9 END
 THEN left(s, {p} - start) || translate(substr(ref, {p + 1}, 1), 'ACGT', 'CGTA') || substr(s, {p} - start + 2) ELSE s END AS s) FROM ({src}))"""


#: The same data for DuckDB: WITH-list of contigs, reads, truth, placed, markers, barcodes, barcoded, targets.
CTE = ",\n".join([
    """contigs AS (SELECT n_name AS name, n_nationkey AS ordinal, string_agg(translate(md5(n_name || '-' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS sequence
 FROM nation, range(32) r(i) GROUP BY ALL)""",
    *(_planted(i) for i in range(len(SITES))),
    f"""reads AS (SELECT read_id, 'ev' || read_id AS name, CASE WHEN event_type = 'error' THEN left(s, 41) || 'A' || substr(s, 43) ELSE s END AS sequence,
 substr(repeat('{PATTERN}', 6), (read_id % 21)::INT + 1, 100) AS quality FROM x{len(SITES)})""",
    f"truth AS (SELECT read_id, ordinal, start FROM x{len(SITES)})",
    "placed AS (SELECT r.read_id, c.name chromosome, t.start::BIGINT start, r.sequence, r.quality FROM reads r JOIN truth t USING (read_id) JOIN contigs c USING (ordinal))",
    f"markers AS (SELECT name chromosome, p::BIGINT AS position, substr(sequence, p + 1, 1) ref_base FROM contigs, (VALUES {', '.join(f'({p})' for p in SITES)}) v(p))",
    f"barcodes AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}S{i}{chr(39)}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(CODES))}) v(i, sample_id, barcode))",
    """barcoded AS (SELECT read_id, name, CASE WHEN read_id % 4 = 1 THEN left(barcode, (read_id % 8)::INT) || translate(substr(barcode, (read_id % 8)::INT + 1, 1), 'ACGT', 'GTAC') || substr(barcode, (read_id % 8)::INT + 2) ELSE barcode END || sequence AS sequence,
 '55555555' || quality AS quality FROM reads JOIN barcodes ON i = read_id % 9)""",
    """targets AS (SELECT 'AMP_' || lpad(ordinal::VARCHAR, 3, '0') amplicon_id, name chromosome, 80 AS start, 280 AS stop, substr(sequence, 81, 20) primer_fwd,
 reverse(translate(substr(sequence, 261, 20), 'ATCG', 'TAGC')) primer_rev, 200 expected_length, ordinal ord FROM contigs)""",
])
