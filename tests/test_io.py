import gzip
import time

import pytest

from strandline.operators import align as A
from strandline.operators import amplicon as M
from strandline.sources import config as C
from strandline.sources import fastq as Q
from strandline.sources import sinks
from strandline.streaming import realtime as R

RECORDS = "@r1 first\nACGT\n+\nIIII\n@r2\nGGCC\n+\n@@@@\n"


def test_fastq_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(RECORDS.replace("\n", "\r\n"))
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(RECORDS)
    rows = Q.read_fastq(spark, str(tmp_path)).orderBy("read_id").collect()
    assert [(r.name, r.sequence, r.quality) for r in rows] == [("r1 first", "ACGT", "IIII"), ("r2", "GGCC", "@@@@")] * 2
    assert [r.read_id for r in rows] == [0, 1, 1 << 40, (1 << 40) + 1]
    assert Q.count_reads(spark, f"{tmp_path}/a.fastq") == 2


@pytest.mark.parametrize("mode,n", [("truncate", 1), ("skip", 2)])
def test_malformed_fastq(spark, tmp_path, mode, n):
    (tmp_path / "a.fq").write_text("@r1\nAC\n+\nII\n@bad\nACGT\n+\nI\n@r3\nA\n+\nI\n")
    assert Q.read_fastq(spark, f"{tmp_path}/a.fq", mode).count() == n
    with pytest.raises(Exception, match="malformed"):
        Q.read_fastq(spark, f"{tmp_path}/a.fq").count()


def test_pairs_stop_at_the_shorter(spark, tmp_path):
    (tmp_path / "1.fq").write_text(RECORDS)
    (tmp_path / "2.fq").write_text("@m1\nTT\n+\nII\n")
    rows = A.interleave(Q.read_pairs(spark, f"{tmp_path}/1.fq", f"{tmp_path}/2.fq")).collect()
    assert [(r.pair_id, r.mate, r.name) for r in rows] == [(0, 1, "r1 first"), (0, 2, "m1")]


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 some text\nACGT\n\nAC\n>c2\nGG\n>c1 again\nTTT\n")
    assert [(r.name, r.ordinal, r.sequence) for r in Q.read_fasta(spark, f"{tmp_path}/r.fa").orderBy("ordinal").collect()] == [("c1", 0, "TTT"), ("c2", 1, "GG")]


def test_chunks_round_trip(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(10)))
    r = Q.read_fastq(spark, f"{tmp_path}/a.fq")
    for z in (None, "gzip"):
        sinks.write_chunks(r, 3, f"{tmp_path}/out{z}", z)
        found = sorted((tmp_path / f"out{z}").glob("chunk=*/part*"))
        assert {f.parent.name for f in found} == {"chunk=0", "chunk=1", "chunk=2"}
        back = [x for f in found for x in Q.parse_fastq(iter((gzip.open(f, "rt") if z else open(f)).read().splitlines()))]
        assert sorted(x[0] for x in back) == sorted(f"r{i}" for i in range(10))


def test_sam_and_vcf_files(spark, tmp_path):
    contigs = spark.createDataFrame([("b", 0, "ACGT"), ("a", 1, "AC")], "name string, ordinal int, sequence string")
    reads = spark.createDataFrame([(7, "", "AC", "II")], "read_id bigint, name string, sequence string, quality string")
    aligned = spark.createDataFrame([(7, "b", 2, 30, 2)], "read_id bigint, contig string, start bigint, mapq int, score int")
    sinks.write_sam(A.sam_rows(reads, aligned), contigs, f"{tmp_path}/sam")
    lines = [r.line for r in sinks.read_lines(spark, f"{tmp_path}/sam").collect()]
    assert lines[0].startswith("@HD\tVN:1.6\tSO:unsorted") and lines[1:3] == ["@SQ\tSN:a\tLN:2", "@SQ\tSN:b\tLN:4"]
    assert lines[-1] == "read_7\t0\tb\t3\t30\t2M\t*\t0\t0\tAC\tII\tAS:i:2"
    v = spark.createDataFrame([("S1", "AMP", "chr1", 12345, "A", "G", 0.5, 100), ("S2", "AMP", "chr1", 12345, "A", "G", 145 / 150, 150)], "sample_id string, amplicon_id string, chromosome string, position bigint, ref_allele string, alt_allele string, allele_frequency double, total_depth bigint")
    g = M.joint_genotypes(v, spark.createDataFrame([("S1",), ("S2",), ("S3",)], "sample_id string"))
    sinks.write_multi_vcf(g, M.allele_counts(g), f"{tmp_path}/vcf")
    lines = [r.line for r in sinks.read_lines(spark, f"{tmp_path}/vcf").collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[-2].endswith("FORMAT\tS1\tS2\tS3")
    assert lines[-1] == "chr1\t12346\tAMP\tA\tG\t60\tPASS\tAMP=AMP;AC=3;AN=4;AF=0.7500;DP=250;KNOWN\tGT:DP:AD:AF:GQ\t0/1:100:50,50:0.500:60\t1/1:150:5,145:0.967:60\t./.:0:0,0:0.000:0"


def test_panel_config_keeps_the_item_line(tmp_path):
    C.write_example(str(tmp_path / "p.yaml"))
    p = C.load_panel(str(tmp_path / "p.yaml"))
    assert p.is_valid() and p.targets[0].amplicon_id == "AMP_001" and p.targets[0].snp_positions == (1050, 1100) and p.call.min_depth == 100
    assert C.problems(p) == [] and C.problems(C.panel_from_string("targets:\n  - start: 5\n")) and not C.panel_from_string("").is_valid()


def test_pipeline_config_and_barcodes(spark, tmp_path):
    (tmp_path / "c.cfg").write_text("reference = r.fa  # comment\n\nbatch_size=500\nsort=false\n")
    assert C.load_pipeline(str(tmp_path / "c.cfg")) == {"reference": "r.fa", "batch_size": 500, "sort": False}
    (tmp_path / "bad.cfg").write_text("batch_size=0\n")
    with pytest.raises(ValueError):
        C.load_pipeline(str(tmp_path / "bad.cfg"))
    (tmp_path / "b.csv").write_text("sample_id,barcode,position\nS1,ATCG,0\nS2,GGGG\n")
    assert [(r.sample_id, r.reverse_complement, r.expected_position) for r in C.read_barcodes(spark, f"{tmp_path}/b.csv").orderBy("sample_id").collect()] == [("S1", "CGAT", 0), ("S2", "CCCC", None)]


def test_tail_of_a_growing_file(spark, tmp_path):
    f = tmp_path / "in" / "a.fastq"
    f.parent.mkdir()
    f.write_text(RECORDS[:30])  # the second record is incomplete
    name = "tail"
    q = R.watch_fastq(spark, str(f)).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for want, more in ((1, RECORDS[30:]), (2, "")):
            end = time.time() + 60
            while spark.table(name).count() < want and time.time() < end:
                q.processAllAvailable()
            assert spark.table(name).count() == want
            with open(f, "a") as out:
                out.write(more)
        assert [r.sequence for r in spark.table(name).orderBy("name").collect()] == ["ACGT", "GGCC"]
    finally:
        q.stop()


def test_streamed_coverage(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i}", "ACGT" if i % 2 else "TTTT", "IIII") for i in range(40)], "read_id bigint, name string, sequence string, quality string")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    q = R.count_coverage(R.watch_reads(spark, f"{tmp_path}/in", 1), lambda b: b.selectExpr("if(sequence = 'ACGT', 'a', 'b') amplicon_id"), f"{tmp_path}/state", f"{tmp_path}/out", available_now=True)
    q.awaitTermination()
    assert R.is_sufficient(spark, f"{tmp_path}/out", ["a", "b"], 20) and not R.is_sufficient(spark, f"{tmp_path}/out", ["a", "b"], 21)
    assert not R.is_sufficient(spark, f"{tmp_path}/out", ["a", "c"], 1) and not R.is_sufficient(spark, f"{tmp_path}/out", [], 1)


def test_stats_json(spark):
    assert sinks.stats_json(spark.sql("select 3 reads_in, 0.5D rate")).first()[0] == '{"reads_in":3,"rate":0.5}'
