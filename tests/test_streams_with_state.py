"""Streams that keep state: clusters over all batches, calls by change, ends by depth, restarts of the tail."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from strandline.operators import amplicon as M
from strandline.schemas import READS, CallParams
from strandline.streaming import realtime as R


def some_reads(n=240, seed=3):
    rng = random.Random(seed)
    base = "ACGTTGCAACGGTTAACCGGATATCGCGAT"
    out = []
    for i in range(n):
        s = list(base)
        if rng.random() < 0.4:
            s[10] = "T"
        if rng.random() < 0.2:
            s[rng.randrange(30)] = rng.choice("ACGT")
        size = 30 if rng.random() < 0.9 else 20
        out.append((n - i, f"r{i}", "".join(s), "".join(chr(33 + rng.randrange(20, 40)) for _ in range(size))))
    return out


def write(spark, rows, path, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], READS).coalesce(1).write.mode("append").parquet(str(path))


def places(batch):
    return batch.withColumn("chromosome", F.lit("c")).withColumn("start", F.lit(100).cast("bigint"))


def run(spark, base, name, files):
    write(spark, some_reads(), base / name / "in", files)
    markers = spark.createDataFrame([("c", 110, "G"), ("c", 115, "A"), ("c", 500, "A")], "chromosome string, position bigint, ref_base string")
    q = R.call_clusters(R.watch_reads(spark, str(base / name / "in"), 1), places, markers, str(base / name / "state"), str(base / name / "out"), CallParams(10, 0.01), available_now=True)
    q.awaitTermination()
    return str(base / name / "out")


def test_batches_give_the_clusters_and_calls_of_one(spark, tmp_path):
    one, many = run(spark, tmp_path, "one", 1), run(spark, tmp_path, "many", 5)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(R.latest_calls(spark, one)) == rows(R.latest_calls(spark, many))
    last = lambda out: rows(spark.read.parquet(f"{out}/piles/batch={max(int(p.name[6:]) for p in Path(out, 'piles').glob('batch=*'))}"))
    assert last(one) == last(many)
    reads = spark.createDataFrame(some_reads(), READS)
    clusters = M.collapse_exact(reads, ids=False).selectExpr("'c' chromosome", "100L start", "consensus_sequence sequence", "consensus_quality quality", "read_count")
    markers = spark.createDataFrame([("c", 110, "G"), ("c", 115, "A"), ("c", 500, "A")], "chromosome string, position bigint, ref_base string")
    piles = M.pileup(clusters, markers)
    whole = M.call_variants(piles, CallParams(10, 0.01)).select("position", "alt_base", "allele_frequency", "genotype", "qual", "depth")
    got = R.latest_calls(spark, many).where("called").select("position", "alt_base", "allele_frequency", "genotype", "qual", "depth")
    assert rows(whole) == rows(got) and whole.count() >= 1
    sums = "chromosome", "position", *M.PILE
    assert rows(piles.select(*sums)) == rows(spark.read.parquet(f"{many}/piles/batch=4").select(*sums))


def test_clusters_in_state_are_those_of_all_reads(spark, tmp_path):
    write(spark, some_reads(), tmp_path / "in", 4)
    q = R.collapse_stream(R.watch_reads(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out")
    last = rows.groupBy("consensus_sequence").agg(F.max_by(F.struct("consensus_quality", "read_count", F.round("avg_quality", 6).alias("q")), "batch").alias("r")).select("consensus_sequence", "r.*")
    want = M.collapse_exact(spark.createDataFrame(some_reads(), READS), ids=False).select("consensus_sequence", "consensus_quality", "read_count", F.round("avg_quality", 6).alias("q"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_without_changes_at_a_position_does_not_write_it(spark, tmp_path):
    far = [(1000 + i, f"f{i}", "ACGTACGTAC", "IIIIIIIIII") for i in range(20)]
    spark.createDataFrame(some_reads(60), READS).coalesce(1).write.parquet(str(tmp_path / "in"))
    markers = spark.createDataFrame([("c", 110, "G"), ("d", 3, "C")], "chromosome string, position bigint, ref_base string")
    place = lambda b: b.withColumn("chromosome", F.when(F.length("consensus_sequence") == 30, "c").otherwise("d")).withColumn("start", F.when(F.length("consensus_sequence") == 30, 100).otherwise(0).cast("bigint"))

    def go():
        R.call_clusters(R.watch_reads(spark, str(tmp_path / "in"), 1), place, markers, str(tmp_path / "state"), str(tmp_path / "out"), CallParams(10, 0.01), available_now=True).awaitTermination()

    go()
    spark.createDataFrame(far, READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/calls/batch=1").select("chromosome", "position", "depth").collect()] == [("d", 3, 20)]
    assert {r.chromosome for r in R.latest_calls(spark, f"{tmp_path}/out").collect()} == {"c", "d"}


def test_a_query_ends_at_its_depth(spark, tmp_path):
    for i in range(40):
        spark.createDataFrame([(j, f"r{j}", "ACGT" if j % 2 else "TTTT", "IIII") for j in range(10)], READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    expected = spark.createDataFrame([("a",), ("b",)], "amplicon_id string")
    assigned = R.watch_reads(spark, str(tmp_path / "in"), 1).selectExpr("if(sequence = 'ACGT', 'a', 'b') amplicon_id")
    q = R.count_until(assigned, expected, 15, str(tmp_path / "state"), str(tmp_path / "out"))
    assert q.awaitTermination(180) and q.exception() is None
    depth = {r.amplicon_id: r.depth for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(depth) == {"a", "b"} and 15 <= min(depth.values()) < 200


def test_a_query_without_an_expected_amplicon_goes_on(spark, tmp_path):
    spark.createDataFrame([(j, f"r{j}", "ACGT", "IIII") for j in range(50)], READS).coalesce(1).write.parquet(str(tmp_path / "in"))
    expected = spark.createDataFrame([("a",), ("absent",)], "amplicon_id string")
    q = R.count_until(R.watch_reads(spark, str(tmp_path / "in"), 1).selectExpr("'a' amplicon_id"), expected, 5, str(tmp_path / "state"), str(tmp_path / "out"))
    q.processAllAvailable()
    time.sleep(2)
    assert q.isActive
    q.stop()


def test_a_restarted_tail_goes_on_where_it_stopped(spark, tmp_path):
    f = tmp_path / "in" / "a.fastq"
    f.parent.mkdir()
    f.write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(30)) + "@part\nAC")

    def go(more):
        q = R.watch_fastq(spark, str(f), 64).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
        with open(f, "a") as out:
            out.write(more)

    go("GT\n+\nIIII\n@new\nTT\n+\nII\n")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
    go("")
    names = [r.name for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(names) == sorted([f"r{i}" for i in range(30)] + ["part", "new"])
