"""Variant calls of a running sequencer, kept up to date. Incremental: files of reads that arrive are aligned once.

    python -m jobs.panel_watch --config jobs/panel_watch.json --events EVENTS --nation NATION --out OUT --checkpoint CHECKPOINT

A run takes the files of ``events`` that are new since the last one (a file stream with availableNow), seeds, chains and
aligns their reads to the contigs of ``nation``, counts bases at the marked places and adds the counts to those of all runs before. It ends when
no file is left; a scheduler starts it again. ``out`` has one row a marked place, partitioned by chromosome: bases,
depth, the alternative and the call. A batch rewrites the partitions of the chromosomes that it touched and no others.

What makes a rerun safe: the stream's checkpoint names the files of each batch; a batch's counts and the sums as of
it stand under the batch's number, and the sums of batch n are those of batch n - 1 and the counts of batch n. A batch that
runs again after a failure replaces its own folders and partitions by the same rows. Each batch costs its reads and
one row a marked place, however many batches came before.

Reads without a seed, below ``min_score`` or off the marked places count nowhere. Reads with null fields that name no contig are
left out. Files must arrive whole, and a file that changes after it was read is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._cli import log, main
from strandline.functions import genetics as G
from strandline.operators import align as A
from strandline.operators import amplicon as M
from strandline.plans import fixtures as X
from strandline.schemas import SeedParams
from strandline.shared import small

PATHS = {"events": "table of reads, or the folder where its files arrive", "nation": "table of contigs", "out": "folder of the calls", "checkpoint": "folder of the stream's progress and the sums"}

SITES = "position bigint, ref_base string, A bigint, C bigint, G bigint, T bigint, depth bigint, ref_count bigint, alt_base string, alt_count bigint, mean_quality double, allele_frequency double, genotype string, called boolean, chromosome string"


@dataclass(frozen=True)
class Settings:
    #: Files of a batch.
    max_files: int = 100
    k: int = 19
    stride: int = 6
    min_score: int = 1
    min_depth: int = 10
    min_allele_frequency: float = 0.01


def sites(piles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The output's rows: every pile with its call."""
    af = G.allele_frequency("alt_count", "depth")
    called = (F.col("depth") >= settings.min_depth) & (af >= settings.min_allele_frequency) & (F.col("alt_base") != "N")
    return piles.select(
        "position", "ref_base", "A", "C", "G", "T", "depth", "ref_count", "alt_base", "alt_count", F.round(F.col("quality_sum") / F.col("depth"), 6).alias("mean_quality"),
        F.round(af, 6).alias("allele_frequency"), F.when(called, G.genotype(af)).alias("genotype"), called.alias("called"), "chromosome",
    )


def run(spark: SparkSession, events: str, nation: str, out: str, checkpoint: str, settings: Settings = Settings()) -> int:
    """Bring ``out`` up to date and return the number of batches that took new files."""
    seeds = SeedParams(k=settings.k, stride=settings.stride)
    contigs = X.contigs_of(spark.read.parquet(nation))
    A.kmer_index(contigs, seeds).write.mode("overwrite").parquet(f"{checkpoint}/index")
    index = small(spark.read.parquet(f"{checkpoint}/index"))
    marks = small(X.markers_of(contigs))
    log.info("read %s: %d contigs", nation, contigs.count())
    done = []

    def body(batch: DataFrame, number: int) -> None:
        reads = X.reads_of(batch, contigs)
        placed = A.place_ungapped(reads, A.chain(A.seeds(reads, index, seeds), seeds), contigs).where(F.col("score") >= settings.min_score)
        placed = placed.select(F.col("contig").alias("chromosome"), "start", "sequence", "quality", F.lit(1).alias("read_count"))
        counts = f"{checkpoint}/counts/batch={number}"
        M.pileup(placed, marks).select("chromosome", "position", "ref_base", *M.PILE).write.mode("overwrite").parquet(counts)
        new = spark.read.parquet(counts)
        both = new if number == 0 else new.unionByName(spark.read.parquet(f"{checkpoint}/sums/batch={number - 1}"))
        sums = f"{checkpoint}/sums/batch={number}"
        M.merge_piles(both).select("chromosome", "position", "ref_base", *M.PILE).write.mode("overwrite").parquet(sums)
        touched = spark.read.parquet(sums).join(F.broadcast(new.select("chromosome").distinct()), "chromosome", "left_semi")  # at most a row a contig
        rows = sites(M.with_alternative(touched), settings)
        rows.repartition("chromosome").sortWithinPartitions("position").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chromosome").parquet(out)
        places, bases, chromosomes = new.agg(F.count("*"), F.sum("depth"), F.count_distinct("chromosome")).first()
        log.info("batch %d: %d aligned bases at %d marked places, wrote %d chromosomes to %s", number, bases or 0, places, chromosomes, out)
        done.append(number)

    path = events.rstrip("/")
    # as a pattern the path may name one file too, which a stream does not take as a path
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", settings.max_files).parquet(f"{path[:-1]}[{path[-1]}]")
    query = stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new reads of %s in %d batches", sum(p["numInputRows"] for p in query.recentProgress), events, len(done))
    return len(done)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The calls as they stand."""
    return spark.read.schema(SITES).parquet(out)


if __name__ == "__main__":
    main(__doc__, PATHS, Settings, run)
