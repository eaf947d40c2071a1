"""Structured Streaming over arriving sequencing files.

New files of a folder are the unit of arrival; ``trigger`` and ``maxFilesPerTrigger`` bound a batch.
State and progress live in the query's checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strandline.operators import amplicon as M
from strandline.schemas import READS, CallParams
from strandline.shared import small
from strandline.sources import sinks


def watch_reads(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Stream of Parquet reads (read_id, name, sequence, quality) as files arrive whole in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", max_files).parquet(folder)


def watch_fastq(spark: SparkSession, pattern: str, max_bytes: int = 8 << 20) -> DataFrame:
    """Stream of FASTQ records, of files that may still grow."""
    from strandline.sources.fastq import register

    register(spark)
    return spark.readStream.format("fastq_tail").option("maxBytesPerTrigger", max_bytes).load(pattern)


def totals(reads: DataFrame) -> DataFrame:
    """Running reads and bases; keeps one row of state."""
    return reads.groupBy().agg(F.count("*").alias("total_reads"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).cast("bigint").alias("total_bases"))


def coverage(assigned: DataFrame) -> DataFrame:
    """Running depth by amplicon of a stream with ``amplicon_id``."""
    return assigned.groupBy("amplicon_id").agg(F.count("*").alias("depth"))


def run_batches(reads: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second", available_now: bool = False) -> StreamingQuery:
    """Call ``body(batch, id)`` for every micro-batch. A body that writes under the id is exactly-once on replay."""
    writer = reads.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def count_coverage(reads: DataFrame, assign: Callable[[DataFrame], DataFrame], checkpoint: str, out: str, interval: str = "1 second", available_now: bool = False) -> StreamingQuery:
    """Write each batch's assigned counts to ``out``, under the batch's id. The caller stops the query once
    ``is_sufficient`` says so."""

    def body(batch: DataFrame, batch_id: int) -> None:
        counts = assign(batch).where("amplicon_id is not null").groupBy("amplicon_id").agg(F.count("*").alias("depth"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run_batches(reads, body, checkpoint, interval, available_now)


def call_stream(reads: DataFrame, panel: Callable[[DataFrame], DataFrame], checkpoint: str, out: str, call: CallParams = CallParams(), targets: DataFrame | None = None, on_variants: Callable[[DataFrame, int], None] | None = None, samples: tuple[str, ...] = ("sample_001",), interval: str = "1 second", available_now: bool = False) -> StreamingQuery:
    """Run the panel on every batch of reads and call variants from all batches so far.

    ``panel`` makes piles of a batch (``call_panel(...).piles``). A batch's piles and the VCF lines as of this batch are written
    under its id (``out``/piles, ``out``/vcf), so a replay replaces them; counts of batches add up, and reads collapse
    within their batch. ``on_variants`` gets the calls as of each batch.
    """
    key = ["chromosome", "position", "ref_base"]

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        panel(batch).select(*key, *M.PILE).write.mode("overwrite").parquet(f"{out}/piles/batch={batch_id}")
        kinds = ", ".join([f"{c} {'bigint' if c == 'position' else 'string'}" for c in key] + [f"{c} bigint" for c in M.PILE] + ["batch bigint"])
        piles = spark.read.schema(kinds).parquet(f"{out}/piles").where(F.col("batch") <= batch_id)
        calls = M.call_variants(M.merge_piles(piles), call)
        calls = M.annotate_variants(calls, targets) if targets is not None else calls.withColumn("amplicon_id", F.lit(None).cast("string")).withColumn("known", F.lit(False))
        sinks.vcf_lines(calls, list(samples)).write.mode("overwrite").text(f"{out}/vcf/batch={batch_id}")
        if on_variants:
            on_variants(calls, batch_id)

    return run_batches(reads, body, checkpoint, interval, available_now)


def is_sufficient(spark: SparkSession, out: str, expected: list[str], least: int) -> bool:
    """Whether every expected amplicon has the depth in what ``count_coverage`` wrote; false without amplicons."""
    depth = spark.read.schema("amplicon_id string, depth bigint, batch int").parquet(out).groupBy("amplicon_id").agg(F.sum("depth").alias("depth"))
    want = spark.createDataFrame([(x,) for x in expected], "amplicon_id string").join(depth, "amplicon_id", "left")
    row = want.agg(F.coalesce(F.bool_and(F.coalesce("depth", F.lit(0)) >= least), F.lit(False))).first()
    return bool(row[0])


CHANGED = "consensus_sequence string, consensus_quality string, read_count bigint, avg_quality double, old_quality string, old_count bigint"
_CLUSTER = "n bigint, first_id bigint, first_quality string, merged string"


def collapse_stream(reads: DataFrame) -> DataFrame:
    """Exact clusters over all batches, kept in the state store by sequence: what each batch changed, as of it.

    Rows are those of ``collapse_exact`` without ids, and the quality and count that the cluster had before (NULL and 0 for a new
    one), so that sums over clusters can be brought up to date. The state of a sequence is one count, its first read
    and the greatest qualities by length, whatever the number of its reads.
    """

    def update(key, batches, state):
        n, first, merged = 0, None, {}
        if state.exists:
            n, first_id, first_quality, held = state.get
            first, merged = (first_id, first_quality), json.loads(held)
        old_n, old_quality = n, merged.get(str(len(first[1]))) if first else None
        for b in batches:
            n += len(b)
            for row in zip(b["read_id"].tolist(), b["quality"].fillna("").tolist()):
                first = row if first is None else min(first, row)
                size = str(len(row[1]))
                merged[size] = "".join(map(max, merged[size], row[1])) if size in merged else row[1]
        state.update((n, first[0], first[1], json.dumps(merged)))
        codes = [ord(c) - 33 for c in first[1]]
        yield pd.DataFrame({"consensus_sequence": [key[0]], "consensus_quality": [merged[str(len(first[1]))]], "read_count": [n], "avg_quality": [sum(codes) / len(codes) if codes else 0.0], "old_quality": [old_quality], "old_count": [old_n]})

    rows = reads.where("sequence is not null").select("read_id", "sequence", "quality")
    return rows.groupBy("sequence").applyInPandasWithState(update, CHANGED, _CLUSTER, "update", "NoTimeout")


KEY = ["chromosome", "position", "ref_base"]


def call_clusters(reads: DataFrame, place: Callable[[DataFrame], DataFrame], markers: DataFrame, checkpoint: str, out: str, call: CallParams = CallParams(), interval: str = "1 second", available_now: bool = False) -> StreamingQuery:
    """Calls from clusters of all reads so far, by change: a batch reads the piles before it and writes those that it changed.

    ``place`` gives the clusters' places (chromosome, start, with the clusters' columns), as ``assign`` and the targets do. A changed
    cluster takes its old bases off the piles and adds its new ones, so N batches give the piles of one. ``out``/piles has the
    piles as of each batch and ``out``/calls the positions that it changed, with ``called``; both under the batch's number, so a replay replaces
    them. ``latest_calls`` gives what stands.
    """

    def body(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = place(batch)
        new = at.select("chromosome", "start", F.col("consensus_sequence").alias("sequence"), F.col("consensus_quality").alias("quality"), "read_count")
        old = at.where("old_count > 0").select("chromosome", "start", F.col("consensus_sequence").alias("sequence"), F.col("old_quality").alias("quality"), (-F.col("old_count")).alias("read_count"))
        M.pileup(new.unionByName(old), markers).select(*KEY, *M.PILE).write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        changes = spark.read.parquet(f"{out}/changes/batch={number}")
        piles = changes if number == 0 else changes.unionByName(spark.read.parquet(f"{out}/piles/batch={number - 1}"))
        M.merge_piles(piles).select(*KEY, *M.PILE).write.mode("overwrite").parquet(f"{out}/piles/batch={number}")
        touched = spark.read.parquet(f"{out}/piles/batch={number}").join(changes.select(*KEY).distinct(), KEY, "left_semi")
        found = M.call_variants(M.with_alternative(touched), call).select(*KEY, "alt_base", "allele_frequency", "genotype", "qual", F.lit(True).alias("called"))
        rows = touched.select(*KEY, "depth").join(found, KEY, "left").withColumn("called", F.coalesce("called", F.lit(False)))
        rows.write.mode("overwrite").parquet(f"{out}/calls/batch={number}")

    writer = collapse_stream(reads).writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def latest_calls(spark: SparkSession, out: str) -> DataFrame:
    """Each position as its last change left it."""
    kinds = "chromosome string, position bigint, ref_base string, depth bigint, alt_base string, allele_frequency double, genotype string, qual int, called boolean, batch int"
    rows = spark.read.schema(kinds).parquet(f"{out}/calls")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("depth", "alt_base", "allele_frequency", "genotype", "qual", "called"), "batch").alias("r"))
    return last.select(*KEY, "r.*")


class _Enough(StreamingQueryListener):
    """Stops a query once its observed depths suffice."""

    def __init__(self, spark: SparkSession, name: str, expected: int, least: int):
        self.spark, self.name, self.expected, self.least = spark, name, expected, least
        self.query: str | None = None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is not None and seen["n"] == self.expected > 0 and seen["least"] >= self.least:
            # a listener must not wait for the query that it is called by
            threading.Thread(target=self._stop, args=(str(p.id),), daemon=True).start()

    def _stop(self, own: str):
        for q in self.spark.streams.active:
            if str(q.id) == own:
                q.stop()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.id) == self.query:
            self.spark.streams.removeListener(self)


def count_until(assigned: DataFrame, expected: DataFrame, least: int, checkpoint: str, out: str, interval: str = "0 seconds") -> StreamingQuery:
    """Running depth of the amplicons ``expected`` (a column ``amplicon_id``), written to ``out`` whole after every batch; the query ends by itself when each of them
    has the depth ``least``. Depths are the state of an aggregate; what the listener sees are two numbers that the batch observed."""
    spark = assigned.sparkSession
    asked = small(expected.select("amplicon_id").distinct())
    name = f"depth_{uuid.uuid4().hex}"
    depth = coverage(assigned.join(asked, "amplicon_id")).observe(name, F.count("*").alias("n"), F.min("depth").alias("least"))
    enough = _Enough(spark, name, asked.count(), least)
    spark.streams.addListener(enough)
    writer = depth.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime=interval).start()
    enough.query = str(query.id)
    return query


class Progress(StreamingQueryListener):
    """Hands the rows and rows per second of each batch to a callback, and the end of the query to another."""

    def __init__(self, on_progress: Callable[[str, int, float], None], on_end: Callable[[str], None] | None = None):
        self.on_progress, self.on_end = on_progress, on_end

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.on_progress(str(p.id), p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.on_end:
            self.on_end(str(event.id))
