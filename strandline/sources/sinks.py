"""SAM, VCF, JSON and FASTQ sinks. Bodies are written by the tasks as text; headers are single small files or lines."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.align import contig_starts


def sam_header(contigs: DataFrame, program: str = "strandline", order: str = "unsorted") -> list[str]:
    """Header lines; contigs by name. The contig list is metadata of the reference and small."""
    rows = contig_starts(contigs).selectExpr("name", "length n").orderBy("name").collect()
    return [f"@HD\tVN:1.6\tSO:{order}"] + [f"@SQ\tSN:{r[0]}\tLN:{r[1]}" for r in rows] + [f"@PG\tID:{program}\tPN:{program}"]


def sam_lines(rows: DataFrame) -> DataFrame:
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in cols), F.concat(F.lit("AS:i:"), F.col("score").cast("string")))
    return rows.select(line.alias("line"))


def _write(spark: SparkSession, header: list[str], body: DataFrame, path: str, compression: str | None) -> None:
    """part 0 is the header's; a body keeps the order of its partitions."""
    options = {"compression": compression} if compression else {}
    spark.createDataFrame([(x,) for x in header], "line string").coalesce(1).write.mode("overwrite").options(**options).text(f"{path}/header")
    body.write.mode("overwrite").options(**options).text(f"{path}/body")


def write_sam(rows: DataFrame, contigs: DataFrame, path: str, compression: str | None = None) -> None:
    _write(rows.sparkSession, sam_header(contigs), sam_lines(rows), path, compression)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Header and body lines of a written folder, header first."""
    part = lambda k, n: spark.read.text(f"{path}/{k}").select(F.lit(n).alias("part"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return part("header", 0).union(part("body", 1)).orderBy("part", "at").select("line")


def vcf_header(contigs: list[str], samples: list[str], multi: bool = False, date: str | None = None, reference: str | None = None) -> list[str]:
    """Header lines; a single-sample header names the reference, if it is known, and its filters."""
    info = ['##INFO=<ID=AMP,Number=1,Type=String,Description="Amplicon">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">', '##INFO=<ID=KNOWN,Number=0,Type=Flag,Description="Known marker">']
    info += ['##INFO=<ID=AC,Number=A,Type=Integer,Description="Allele count">', '##INFO=<ID=AN,Number=1,Type=Integer,Description="Allele number">'] if multi else ['##INFO=<ID=RD,Number=1,Type=Integer,Description="Reference depth">', '##INFO=<ID=AD,Number=A,Type=Integer,Description="Alternative depth">']
    form = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths of alleles">', '##FORMAT=<ID=AF,Number=A,Type=Float,Description="Allele frequency">']
    form += ['##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">'] if multi else []
    filters = [] if multi else ['##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=LowDepth,Description="Depth below the least">', '##FILTER=<ID=LowAF,Description="Allele frequency below the least">']
    form += filters
    date = date or datetime.date.today().strftime("%Y%m%d")
    source = ["##source=strandline"] + ([f"##reference={reference}"] if reference and not multi else [])
    return ["##fileformat=VCFv4.2", f"##fileDate={date}", *source, *(f"##contig=<ID={c}>" for c in sorted(set(contigs))), *info, *form, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def _known() -> Column:
    return F.when(F.col("known"), F.lit(";KNOWN")).otherwise(F.lit(""))


def vcf_lines(calls: DataFrame, samples: list[str]) -> DataFrame:
    """One line for each call (chromosome, position 0-based, amplicon_id, ref_base, alt_base, qual, depth, ...)."""
    amp = F.coalesce("amplicon_id", F.lit("."))
    af = F.format_string("%.3f", F.round("allele_frequency", 3))
    info = F.concat(F.lit("AMP="), amp, F.lit(";DP="), F.col("depth"), F.lit(";AF="), af, F.lit(";RD="), F.col("ref_count"), F.lit(";AD="), F.col("alt_count"), _known())
    gt = F.concat(F.col("genotype"), F.lit(":"), F.col("depth"), F.lit(":"), F.col("ref_count"), F.lit(","), F.col("alt_count"), F.lit(":"), af)
    cols = ["chromosome", (F.col("position") + 1).cast("string"), amp, "ref_base", "alt_base", F.col("qual").cast("string"), F.lit("PASS"), info, F.lit("GT:DP:AD:AF"), *([gt] * len(samples))]
    return calls.orderBy("chromosome", "position").select(F.concat_ws("\t", *cols).alias("line"))


def write_vcf(calls: DataFrame, samples: list[str], path: str, reference: str | None = None) -> None:
    contigs = [r[0] for r in calls.select("chromosome").distinct().collect()]
    _write(calls.sparkSession, vcf_header(contigs, samples, reference=reference), vcf_lines(calls, samples), path, None)


def multi_vcf_lines(genotypes: DataFrame, counts: DataFrame, samples: list[str]) -> DataFrame:
    """One line for each position of the joint genotypes, one column for each sample of the given list."""
    cell = F.when(F.col("genotype") == "./.", "./.:0:0,0:0.000:0").otherwise(F.concat(F.col("genotype"), F.lit(":"), F.col("depth"), F.lit(":"), F.col("depth") - F.col("alt_depth"), F.lit(","), F.col("alt_depth"), F.lit(":"), F.format_string("%.3f", F.round("allele_frequency", 3)), F.lit(":60")))
    keys = ["chromosome", "position", "ref_allele", "alt_allele", "amplicon_id"]
    wide = genotypes.withColumn("cell", cell).groupBy(*keys).pivot("sample_id", samples).agg(F.first("cell"))
    out = wide.join(counts, ["chromosome", "position"])
    amp = F.when(F.col("amplicon_id") == "", ".").otherwise(F.col("amplicon_id"))
    info = F.concat(F.lit("AMP="), amp, F.lit(";AC="), F.col("ac"), F.lit(";AN="), F.col("an"), F.lit(";AF="), F.format_string("%.4f", F.round("af", 4)), F.lit(";DP="), F.col("dp"), F.when(F.col("amplicon_id") == "", "").otherwise(";KNOWN"))
    cols = [F.col("chromosome"), (F.col("position") + 1).cast("string"), amp, F.col("ref_allele"), F.col("alt_allele"), F.lit("60"), F.lit("PASS"), info, F.lit("GT:DP:AD:AF:GQ"), *(F.coalesce(F.col(f"`{s}`"), F.lit("./.:0:0,0:0.000:0")) for s in samples)]
    return out.orderBy("chromosome", "position").select(F.concat_ws("\t", *cols).alias("line"))


def write_multi_vcf(genotypes: DataFrame, counts: DataFrame, path: str) -> None:
    samples = [r[0] for r in genotypes.select("sample_id").distinct().orderBy("sample_id").collect()]
    contigs = [r[0] for r in genotypes.select("chromosome").distinct().collect()]
    _write(genotypes.sparkSession, vcf_header(contigs, samples, multi=True), multi_vcf_lines(genotypes, counts, samples), path, None)


def stats_json(stats: DataFrame) -> DataFrame:
    """A one-row table of statistics as one JSON line."""
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("json"))


def write_json(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, contigs) of folders that ``write_sam`` wrote, given as a path or glob: the SAM columns with the score, and name and
    length of the header's contigs."""
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    kinds = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "int", "tlen": "int"}
    part = F.split("value", "\t")
    body = spark.read.text(f"{path}/body").select(*(F.get(part, F.lit(i)).cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(cols)), F.regexp_extract("value", r"\tAS:i:(-?\d+)", 1).cast("int").alias("score"))
    head = spark.read.text(f"{path}/header").where("value like '@SQ%'")
    contigs = head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length")).distinct()
    return body, contigs


def merge_sam(spark: SparkSession, paths: str, out: str, sort: bool = True) -> None:
    """One SAM folder of several, given by a glob: all rows, by contig and position unless ``sort`` is off, under one header."""
    rows, contigs = read_sam(spark, paths)
    names = [f"@SQ\tSN:{r[0]}\tLN:{r[1]}" for r in contigs.orderBy("name").collect()]
    header = [f"@HD\tVN:1.6\tSO:{'coordinate' if sort else 'unsorted'}", *names, "@PG\tID:strandline\tPN:strandline"]
    _write(spark, header, sam_lines(merge_alignments([rows], sort)), out, None)


def fasta_lines(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("sequence")).alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality")).alias("value"))


def write_chunks(reads: DataFrame, n: int, path: str, compression: str | None = None) -> None:
    """FASTQ in ``n`` (at most 256) folders of contiguous reads; with compression "gzip" the files are compressed."""
    from strandline.operators.amplicon import chunks

    if not 1 <= n <= 256:
        raise ValueError("between 1 and 256 chunks")
    body = chunks(reads, n).withColumn("value", F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality")))
    options = {"compression": compression} if compression else {}
    body.repartitionByRange(n, "read_id").sortWithinPartitions("read_id").select("chunk", "value").write.mode("overwrite").partitionBy("chunk").options(**options).text(path)


def merge_alignments(parts: list[DataFrame], sort: bool = True) -> DataFrame:
    """One table of several alignment tables, by contig and position unless ``sort`` is off."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rname", "pos", "qname") if sort else out
