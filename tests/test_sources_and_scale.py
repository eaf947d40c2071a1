"""Split sources, tiled references, paths for large panels against those for small ones, and the pieces around runs."""

import itertools
import random
import threading
import time

import numpy as np
import pytest

from strandline import shared
from strandline.__main__ import main
from strandline.functions import kernels as KN
from strandline.operators import align as A
from strandline.operators import amplicon as M
from strandline.plans import pipelines as P
from strandline.schemas import BandedParams, CallParams, ChimeraParams, LocalParams, TrimParams
from strandline.sources import fastq as Q
from strandline.sources import sinks
from strandline.streaming import monitor
from strandline.streaming import realtime as R

READS = "read_id bigint, name string, sequence string, quality string"


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def fastq(rng, n, end="\n"):
    """Records whose qualities hold @ and + at their starts."""
    out = []
    for i in range(n):
        s = bases(rng, rng.randrange(1, 30))
        out.append(end.join([f"@r{i}", s, rng.choice(["+", f"+r{i}"]), rng.choice("@+I") + "".join(rng.choice("@+5I") for _ in s[1:])]) + end)
    return out


# ---- sources

@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_byte_ranges_read_every_record_once(tmp_path, end):
    rng = random.Random(1)
    records = fastq(rng, 60, end)
    records[30] += end
    path = tmp_path / "a.fq"
    path.write_bytes("".join(records).encode())
    want = list(Q.parse_fastq(iter("".join(records).splitlines())))
    size = path.stat().st_size
    for step in (1, 7, 40, 97, 500, size, 2 * size):
        got = [r for at in range(0, size, step) for r in Q.read_range(str(path), at, min(at + step, size))]
        assert got == want, step
    for i in (0, 20, 59):
        bad = records[:i] + [records[i].replace("+", "-")] + records[i + 1 :]
        path.write_bytes("".join(bad).encode())
        for step in (33, 200):
            with pytest.raises(Q.Malformed):
                [r for at in range(0, size, step) for r in Q.read_range(str(path), at, min(at + step, size))]


def test_split_files_keep_ids_and_pairs(spark, tmp_path):
    rng = random.Random(2)
    for name in "ab":
        (tmp_path / f"{name}.fq").write_text("".join(fastq(rng, 50)))
    whole, split = (sorted(map(tuple, Q.read_fastq(spark, str(tmp_path), split=n).collect())) for n in (1 << 20, 100))
    assert whole == split and [r[0] for r in whole] == [*range(50), *(x + (1 << 40) for x in range(50))]
    assert Q.read_fastq(spark, f"{tmp_path}/a.fq", split=100).rdd.getNumPartitions() >= 1
    got = M.chunks(Q.read_fastq(spark, str(tmp_path), split=100), 3).collect()
    order = sorted(got, key=lambda r: r.read_id)
    assert [r.chunk for r in order] == [i // 34 for i in range(100)]
    sinks.write_chunks(Q.read_fastq(spark, str(tmp_path)), 7, f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("chunk=*"))) == 7


def test_tail_passes_large_and_malformed_records(tmp_path):
    rng = random.Random(3)
    big = bases(rng, 5000)
    text = f"@a\nAC\n+\nII\n@bad\nACG\n+\nI\n\n@big\n{big}\n+\n{'I' * 5000}\n@c\nGG\n+\nII\n@half\nAA\n"
    path = tmp_path / "a.fastq"
    path.write_text(text)
    size = len(text)

    def names(*cuts):
        edges = [0, *sorted(cuts), size]
        return [r[0] for a, b in zip(edges, edges[1:]) for r in Q.read_ended(str(path), a, b)]

    assert names() == ["a", "big", "c"]
    for cut in [*range(1, 60), 5000, *range(size - 40, size)]:  # wherever a range ends, records are read once
        assert names(cut) == ["a", "big", "c"] == names(cut, min(size, cut + 7))
    path.write_text(text + "+\nII\n")
    assert [r[0] for r in Q.read_ended(str(path), size, size + 5)] == ["half"]
    assert list(Q.read_ended(str(path), size, size + 4)) == []


def test_a_tail_plans_offsets_and_reads_ranges(tmp_path):
    for name, n in (("a", 50), ("b", 3)):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{name}{i}\nACGT\n+\nIIII\n" for i in range(n)))
    a, b = str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq")
    stream = Q.FastqStream({"path": str(tmp_path), "maxBytesPerTrigger": "100", "split": "30"})
    at, seen, batches = stream.initialOffset(), [], 0
    while (end := stream.latestOffset()) != at:
        assert all(end[p] - at.get(p, 0) <= 100 for p in end)
        parts = stream.partitions(at, end)
        assert all(p.end - p.start <= 30 for p in parts)
        rows = [r for p in parts for batch in stream.read(p) for r in batch.to_pylist()]
        again = [r for p in stream.partitions(at, end) for batch in stream.read(p) for r in batch.to_pylist()]
        assert rows == again
        seen, at, batches = seen + rows, end, batches + 1
    assert batches > 5 and sorted(r["name"] for r in seen) == sorted([f"a{i}" for i in range(50)] + [f"b{i}" for i in range(3)])
    restarted = Q.FastqStream({"path": str(tmp_path), "maxBytesPerTrigger": "100"})
    assert restarted.latestOffset() == at and restarted.partitions(at, at) == []
    with open(a, "a") as f:
        f.write("@late\nAC\n+\nII\n")
    end = restarted.latestOffset()
    assert end[b] == at[b] and [r["name"] for p in restarted.partitions(at, end) for x in restarted.read(p) for r in x.to_pylist()] == ["late"]


def test_fasta_of_many_files_has_rising_ordinals(tmp_path):
    (tmp_path / "x.fa").write_text(">a\nAC\n>b\nGT\n")
    reader = Q.FastaReader({"path": str(tmp_path)})
    rows = [r for i in (0, 127, 128, 5000) for r in reader.read(Q._File(f"{tmp_path}/x.fa", i))]
    assert [r[1] for r in rows] == sorted(r[1] for r in rows) and rows[-1][1] == (5000 << 32) + 1


# ---- the reference in tiles

def test_small_tiles_give_what_large_ones_give(spark):
    rng = random.Random(4)
    ref = [bases(rng, n) for n in (700, 333, 64, 20)]
    contigs = spark.createDataFrame([(f"c{i}", i, s) for i, s in enumerate(ref)], "name string, ordinal int, sequence string")
    cut = [s[a : a + 50] for s in ref[:3] for a in (0, 14, 15, 31, 100, 280) if len(s) >= a + 50]
    r = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s)) for i, s in enumerate([*cut, ref[0][680:], "ACGT" * 13])], READS)
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = A.kmer_index(contigs)
    assert rows(A.kmer_index(contigs, tile=64)) == rows(index) and {x.position: x.kmer for x in index.where("contig = 'c0'").collect()} == {i: ref[0][i : i + 19] for i in range(682)}
    assert rows(A.contains_exactly(r, contigs, tile=64)) == rows(A.contains_exactly(r, contigs)) and A.contains_exactly(r, contigs).count() == len(cut) + 1
    chained = A.chain(A.seeds(r, index))
    cols = ["read_id", "contig", "start", "score"]
    assert rows(A.place_ungapped(r, chained, contigs, tile=64).select(cols)) == rows(A.place_ungapped(r, chained, contigs).select(cols))
    assert rows(A.place_banded(r, chained, contigs, tile=256).select(cols)) == rows(A.place_banded(r, chained, contigs).select(cols))
    assert [(x.name, x.start, x.length) for x in A.contig_offsets(contigs).orderBy("ordinal").collect()] == [("c0", 0, 700), ("c1", 700, 333), ("c2", 1033, 64), ("c3", 1097, 20)]
    with pytest.raises(Exception, match="longer than a tile"):
        A.place_ungapped(r, chained, contigs, tile=40).select("window").collect()
    assert A.kmer_index(contigs.where("false")).count() == 0


def test_reads_of_the_other_strand_are_turned(spark):
    rng = random.Random(5)
    ref = bases(rng, 500)
    contigs = spark.createDataFrame([("c", 0, ref)], "name string, ordinal int, sequence string")
    turned = ref[100:180][::-1].translate(str.maketrans("ACGT", "TGCA"))
    quality = "".join(rng.choice("5I") for _ in range(80))
    r = spark.createDataFrame([(0, "f", ref[100:180], quality), (1, "b", turned, quality), (2, "n", "N" * 80, quality)], READS)
    for banded in (None, BandedParams()):
        sam = {x.qname: x for x in P.align_reads(r, contigs, banded=banded, both_strands=True).sam.collect()}
        assert (sam["f"].flag, sam["b"].flag, sam["n"].flag) == (0, 16, 4) and sam["f"].pos == sam["b"].pos == 101
        assert sam["b"].seq == ref[100:180] and sam["b"].qual == quality[::-1] and sam["f"].qual == quality


def test_duplicates_of_a_hot_position(spark):
    rng = random.Random(6)
    rows = [(i, o, rng.randrange(3), rng.randrange(4), 0) for i in range(60) for o in range(2)]
    df = spark.createDataFrame(rows, "read_id bigint, ord int, gpos bigint, mapq int, flag int")
    best = {g: min((-q, i, o) for i, o, x, q, _ in rows if x == g) for g in range(3)}
    got = A.mark_duplicates(df, "position")
    assert got.columns == df.columns or set(got.columns) == set(df.columns)
    assert {(x.read_id, x.ord): x.flag for x in got.collect()} == {(i, o): 0 if best[g] == (-q, i, o) else 1024 for i, o, g, q, _ in rows}


def test_clusters_without_lists_of_reads(spark):
    rng = random.Random(14)
    r = spark.createDataFrame([(i, f"r{i}", rng.choice(["ACGTACGT", "ACGTACGA", "TTTTTTTT"]), "I" * 8) for i in range(40)], READS)
    full, bare = (M.merge_similar(M.collapse_exact(r, ids), 1) for ids in (True, False))
    assert "read_ids" not in bare.columns and sorted(map(tuple, bare.collect())) == sorted(map(tuple, full.drop("read_ids").collect()))
    assert {(x.read_id, x.consensus_sequence) for x in M.members(r).collect()} == {(i, x.consensus_sequence) for x in M.collapse_exact(r).collect() for i in x.read_ids}


# ---- kernels against plain versions

def plain_align(query, target, p):
    n, m = len(query), len(target)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    came = [[0] * (m + 1) for _ in range(n + 1)]
    best, at = 0, (0, 0)
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        diag = score[i - 1][j - 1] + (p.match if query[i - 1] == target[j - 1] else p.mismatch)
        up = score[i - 1][j] + (p.gap_extend if came[i - 1][j] == 2 else p.gap_open)
        left = score[i][j - 1] + (p.gap_extend if came[i][j - 1] == 3 else p.gap_open)
        top = score[i][j] = max(0, diag, up, left)
        if top:
            came[i][j] = 1 if top == diag else 2 if top == up else 3
        if top > best:
            best, at = top, (i, j)
    (i, j), ops = at, ""
    while i and j and score[i][j] > 0:
        if came[i][j] == 1:
            ops, i, j = ("M" if query[i - 1] == target[j - 1] else "X") + ops, i - 1, j - 1
        elif came[i][j] == 2:
            ops, i = "D" + ops, i - 1
        else:
            ops, j = "I" + ops, j - 1
    return best, i, at[0], j, at[1], KN.run_lengths(ops)


def test_alignments_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(7)
    pairs = [(bases(rng, rng.randrange(0, 25)), bases(rng, rng.randrange(0, 30))) for _ in range(120)]
    pairs += [(s[:10] + s[12:], s) for s in (bases(rng, 40) for _ in range(10))]
    for cells in (1 << 21, 500):
        monkeypatch.setattr(KN, "CELLS", cells)
        for p in (LocalParams(), LocalParams(1, -1, -1, -1)):
            got = [(r["score"], r["query_start"], r["query_end"], r["target_start"], r["target_end"], r["cigar"]) for r in KN.local_align_many(pairs, p)]
            assert [g if g[0] else g[:1] for g in got] == [w if w[0] else w[:1] for w in (plain_align(q, t, p) for q, t in pairs)]


def test_large_panels_trim_and_judge_like_small_ones(spark, monkeypatch):
    rng = random.Random(8)
    panel = [(f"A{i}", bases(rng, rng.choice([8, 12, 20])), bases(rng, rng.choice([12, 15])), i) for i in range(6)]
    targets = spark.createDataFrame(panel, "amplicon_id string, primer_fwd string, primer_rev string, ord int")
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = []
    for _ in range(80):
        _, f, v, _ = rng.choice(panel)
        s = list(rng.choice(["", f, f[: len(f) - 1]]) + bases(rng, rng.randrange(5, 40)) + rng.choice(["", turn(v), turn(v) + "ACG"]))
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        seqs.append("".join(s))
    r = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s)) for i, s in enumerate([*seqs, "", "ACG"])], READS)
    trimmed = lambda: sorted(map(tuple, M.trim_primers(r, targets, TrimParams()).collect()))
    small = trimmed()
    monkeypatch.setattr(M, "MOST_PRIMERS", 0)
    assert trimmed() == small and sum(x[4] for x in small) > 10
    parents = spark.createDataFrame([(i, bases(rng, rng.choice([60, 80, 100])), rng.randrange(10, 500)) for i in range(7)], "ord int, sequence string, abundance bigint")
    p = [x.sequence for x in parents.collect()]
    q = spark.createDataFrame([(i, (rng.choice(p)[:40] + rng.choice(p)[40:])[: rng.choice([50, 75, 100])], rng.randrange(1, 300)) for i in range(40)], "id bigint, sequence string, abundance bigint")
    judged = lambda: [sorted(map(tuple, f(q, parents, ChimeraParams(edge=20)).collect()), key=str) for f in (M.chimera_de_novo, M.chimera_reference)]
    scanned = judged()
    monkeypatch.setattr(M, "MOST_PARENTS", 0)
    assert judged() == scanned and any(x[3] for x in scanned[0])


def test_assignment_against_plain_loops(spark):
    rng = random.Random(9)
    panel = [(f"A{i}", bases(rng, n), bases(rng, 12), e, i) for i, (n, e) in enumerate([(10, 60), (12, 90), (10, 60), (14, 45), (2, 300)])]
    turn = lambda s: s[::-1].translate(str.maketrans("ACGTacgtn", "TGCATGCAN"))
    clusters = set()
    for _ in range(150):
        _, f, v, e, _ = rng.choice(panel[:4])
        f = list(rng.choice([f, v]))
        for _ in range(rng.randrange(4)):
            f[rng.randrange(len(f))] = rng.choice("ACGT")
        s = bases(rng, rng.choice([0, 0, 5])) + "".join(f) + bases(rng, rng.randrange(5, 90))
        clusters.add(rng.choice([s, turn(s)]))
    clusters |= {"", "A", bases(rng, 310)}
    near = lambda t, p: any(sum(x != y for x, y in zip(t[o : o + len(p)], p)) <= 2 for o in range(len(t) - len(p) + 1))

    def choose(s):
        best = []
        for name, f, v, e, i in panel:
            if s.startswith((f, v)):
                best.append((1, 0.0, i, name))
            elif any(near(t, p) for t in (s, turn(s)) for p in (f, v)):
                best.append((2, 0.0, i, name))
            score = 1 - abs(len(s) - e) / e
            if abs(len(s) - e) <= 0.2 * e and score > 0.8:
                best.append((3, 1 - score, i, name))
        return min(best)[3] if best else None

    c = spark.createDataFrame([(s, 1) for s in clusters], "consensus_sequence string, read_count bigint")
    t = spark.createDataFrame(panel, "amplicon_id string, primer_fwd string, primer_rev string, expected_length int, ord int")
    got = {x.consensus_sequence: x.amplicon_id for x in M.assign(c, t).collect()}
    assert got == {s: choose(s) for s in clusters} and len(set(got.values())) >= 5
    plan = M.assign(c, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert M.assign(c, t.where("false")).where("amplicon_id is not null").count() == 0


# ---- sinks, streams, monitor, command line

def test_vcf_header_and_panel_statistics(spark):
    lines = sinks.vcf_header(["chr2", "chr1"], ["S"], reference="ref.fa", date="20260101")
    assert "##reference=ref.fa" in lines and sum(x.startswith("##FILTER=<ID=") for x in lines) == 3 and lines[-1].endswith("FORMAT\tS")
    assert not any(x.startswith("##reference") for x in sinks.vcf_header([], ["S"]))
    c = spark.createDataFrame([("A", 6), ("B", 3), ("C", 1), ("D", 0)], "consensus_sequence string, read_count bigint")
    a = c.withColumn("amplicon_id", c.read_count.cast("string")).replace({"0": None}, subset=["amplicon_id"])
    s = M.panel_stats(c, a, a.where("amplicon_id is not null").limit(2), spark.range(5)).first().asDict()
    assert s == {"total_reads": 10, "collapsed_clusters": 4, "collapse_ratio": 2.5, "assigned_clusters": 3, "assignment_rate": 0.75, "aligned_clusters": 2, "alignment_rate": 2 / 3, "variants_called": 5}
    none = M.panel_stats(c.where("false"), a.where("false"), a.where("false"), spark.range(0)).first()
    assert none.collapse_ratio == none.alignment_rate == 0 and none.total_reads == 0


def test_panel_on_a_stream(spark, tmp_path):
    rng = random.Random(11)
    ref = bases(rng, 600)
    alt = ref[:250] + ("A" if ref[250] != "A" else "C") + ref[251:]
    contigs = spark.createDataFrame([("chr1", 0, ref)], "name string, ordinal int, sequence string")
    targets = spark.createDataFrame([("AMP", "chr1", 200, 400, ref[200:220], "G" * 20, 200, [250], 0)], "amplicon_id string, chromosome string, start bigint, end bigint, primer_fwd string, primer_rev string, expected_length int, snp_positions array<bigint>, ord bigint")
    for k in range(3):
        rows = [(10 * k + i, f"r{i}", (alt if i % 2 else ref)[200:400], "I" * 200) for i in range(10)]
        spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    q = R.call_stream(R.watch_reads(spark, f"{tmp_path}/in", 1), lambda b: P.call_panel(b, targets, contigs, CallParams(1, 0.01), 0).piles, f"{tmp_path}/state", f"{tmp_path}/out", CallParams(1, 0.01), targets, lambda calls, i: seen.append((i, calls.first().depth)), available_now=True)
    q.awaitTermination()
    assert seen == [(0, 10), (1, 20), (2, 30)]
    lines = {r.batch: r.value.split("\t") for r in spark.read.text(f"{tmp_path}/out/vcf").collect()}
    assert lines[2][:5] == ["chr1", "251", "AMP", ref[250], alt[250]] and "DP=30" in lines[2][7] and "DP=10" in lines[0][7]


def test_monitor_and_file_events(tmp_path):
    now = [0.0]
    m = monitor.Monitor(200, lambda: now[0])
    assert m.left() == 0 and m.rate() == 0
    now[0] = 10.0
    m.advance(1)
    assert m.left() == 0
    m.advance(49)
    with m.stage("align"):
        now[0] = 12.0
    assert m.left() == pytest.approx(12 / 0.25 - 12) and m.rate() == pytest.approx(50 / 12) and m.timings() == {"align": (2.0, 2.0, 1)}
    assert m.to_json() == '{"elapsed_seconds": 12.0, "total_items": 200, "processed_items": 50}' and "50 of 200 (25.0 %)" in m.report() and "align" in m.report()
    seen: dict = {}
    (tmp_path / "a.fastq.gz").write_text("x")
    (tmp_path / "notes.txt").write_text("x")
    assert monitor.file_events(str(tmp_path), seen) == [("created", f"{tmp_path}/a.fastq.gz")] and monitor.file_events(str(tmp_path), seen) == []
    import os

    os.utime(tmp_path / "a.fastq.gz", (1, 1))
    assert monitor.file_events(str(tmp_path), seen) == [("modified", f"{tmp_path}/a.fastq.gz")]
    (tmp_path / "a.fastq.gz").unlink()
    assert monitor.file_events(str(tmp_path), seen) == [("deleted", f"{tmp_path}/a.fastq.gz")]


def test_jobs_can_be_cancelled(spark):
    with monitor.cancellable(spark, "slow") as cancel:
        threading.Timer(3, cancel).start()
        began = time.time()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 1 << 40, 1, 4).selectExpr("sum(id % 7)").collect()
    assert time.time() - began < 60 and spark.range(3).count() == 3


def test_command_line_multi_and_merge(spark, tmp_path):
    rng = random.Random(12)
    ref = bases(rng, 400)
    (tmp_path / "ref.fa").write_text(f">c\n{ref}\n")
    for k in range(2):
        (tmp_path / f"s{k}.fq").write_text("".join(f"@s{k}r{i}\n{ref[20 * i + k : 20 * i + k + 60]}\n+\n{'I' * 60}\n" for i in range(5)))
    assert main(["multi", "-r", f"{tmp_path}/ref.fa", "-i", f"{tmp_path}/s*.fq", "-o", f"{tmp_path}/out", "--ungapped"]) == 0
    assert main(["merge", "-i", f"{tmp_path}/out/*", "-o", f"{tmp_path}/all"]) == 0
    lines = [r.line for r in sinks.read_lines(spark, f"{tmp_path}/all").collect()]
    assert lines[0] == "@HD\tVN:1.6\tSO:coordinate" and lines[1] == "@SQ\tSN:c\tLN:400" and len(lines) == 3 + 10
    pos = [int(x.split("\t")[3]) for x in lines[3:]]
    assert pos == sorted(20 * i + k + 1 for i in range(5) for k in range(2)) and all(x.endswith("AS:i:60") for x in lines[3:])


def test_command_line_panel_stages(spark, tmp_path):
    rng = random.Random(13)
    ref = bases(rng, 600)
    alt = ref[:250] + ("A" if ref[250] != "A" else "C") + ref[251:]
    (tmp_path / "ref.fa").write_text(f">chr1\n{ref}\n")
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\nATCGATCG{(alt if i % 2 else ref)[200:400]}\n+\n{'I' * 208}\n" for i in range(20)) + f"@x\n{'T' * 100}\n+\n{'I' * 100}\n")
    (tmp_path / "b.csv").write_text("sample_id,barcode,position\nS1,ATCGATCG,0\n")
    (tmp_path / "p.yaml").write_text(f"variant_calling:\n  min_depth: 5\ncollapse:\n  max_distance: 0\ntargets:\n  - amplicon_id: AMP\n    chromosome: chr1\n    start: 200\n    end: 400\n    primer_fwd: {ref[200:220]}\n    primer_rev: GGGGGGGGGGGGGGGGGGGG\n    expected_length: 200\n    snp_positions: [250]\n")
    args = ["panel", "-c", f"{tmp_path}/p.yaml", "-i", f"{tmp_path}/r.fq", "-r", f"{tmp_path}/ref.fa", "--barcodes", f"{tmp_path}/b.csv", "--chimeras"]
    assert main([*args, "-o", f"{tmp_path}/vcf", "-s", f"{tmp_path}/stats"]) == 0
    lines = [r.line for r in sinks.read_lines(spark, f"{tmp_path}/vcf").collect()]
    assert f"##reference={tmp_path}/ref.fa" in lines and lines[-1].split("\t")[9].startswith("0/1:20:10,10")
    s = spark.read.json(f"{tmp_path}/stats").first()
    assert (s.total_reads, s.collapsed_clusters, s.assigned_clusters, s.aligned_clusters, s.variants_called, s.alignment_rate) == (20, 2, 2, 2, 1, 1.0)


def test_broadcasts_and_folders_are_checked(spark):
    import types

    assert "broadcast" in str(shared.small(spark.range(10))._jdf.queryExecution().logical()).lower()
    assert "broadcast" not in str(shared.small(spark.range(10), 5)._jdf.queryExecution().logical()).lower()
    assert "broadcast" not in str(shared.small(spark.range(10).selectExpr("repeat('x', 100) s"), text="s", most_bytes=99)._jdf.queryExecution().logical()).lower()
    conf = types.SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared.shared_folder(types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: conf, master="yarn"), conf=conf))
    assert np.array_equal(KN._two_sides(np.array([[0, 5]]), np.array([[0, 9]])), [5])


def test_reads_of_one_sequence_are_placed_once(spark):
    """Every different sequence is seeded, chained and placed once, and each of its reads gets the row that it gets on its own."""
    rng = random.Random(23)
    contigs = spark.createDataFrame([(f"c{i}", i, bases(rng, 900)) for i in range(3)], "name string, ordinal int, sequence string")
    cuts = [r.sequence[at : at + 100] for r in contigs.collect() for at in (0, 311, 700)]
    seqs = [rng.choice(cuts) for _ in range(60)] + [cuts[0][:40] + "A" + cuts[0][41:], cuts[1][:50] + cuts[1][52:], "N" * 100, "ACGT", None]
    reads = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s or "")) for i, s in enumerate(seqs)] + [(None, "none", cuts[0], "I" * 100)], READS)
    index = A.kmer_index(contigs)
    seen = []

    def counted(texts, chained, c):
        seen.append(sorted(r.sequence for r in texts.collect()))
        return A.place_ungapped(texts, chained, c)

    cols = ["read_id", "name", "contig", "start", "gpos", "n_seeds", "mismatches", "score", "mapq"]
    one = A.place_ungapped(reads, A.chain(A.seeds(reads, index)), contigs).select(cols)
    two = A.place_each_once(reads, contigs, counted).select(cols)
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, one.collect()))
    assert seen == [sorted({s for s in seqs if s})]
    sam = A.sam_of(A.place_each_once(reads, contigs, how="left"))
    assert sorted(map(tuple, sam.collect()), key=str) == sorted(map(tuple, A.sam_rows(reads, A.place_ungapped(reads, A.chain(A.seeds(reads, index)), contigs)).collect()), key=str)
    banded = lambda *of: A.place_banded(*of, BandedParams(band=8), trace=True)
    cols = ["read_id", "contig", "start", "score", "cigar", "edits"]
    assert sorted(map(tuple, A.place_each_once(reads, contigs, banded).select(cols).collect())) == sorted(map(tuple, banded(reads, A.chain(A.seeds(reads, index)), contigs).select(cols).collect()))


def test_ranges_of_many_bytes_are_bounded_in_number(tmp_path):
    rng = random.Random(24)
    for name in "ab":
        (tmp_path / f"{name}.fq").write_text("".join(fastq(rng, 1500)))
    found = Q.FastqReader({"path": str(tmp_path), "split": "10"}).partitions()
    assert Q.PARTS // 2 < len(found) <= Q.PARTS + 2
    for p in (tmp_path / "a.fq", tmp_path / "b.fq"):
        own = [x for x in found if x.path == str(p)]
        got = [r for x in own for r in Q.read_range(x.path, x.start, x.end)]
        assert got == list(Q.parse_fastq(iter(p.read_text().splitlines()))) and [x.part for x in own] == list(range(len(own)))
