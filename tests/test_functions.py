import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import genetics as G
from strandline.functions import kernels as KN
from strandline.functions import sequence as S
from strandline.schemas import BandedParams


def one(spark, *cols, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


@pytest.mark.parametrize("s,want", [("ACGT", "ACGT"), ("AAAATTTT", "AAAATTTT"), ("ACGTACGT", "ACGTACGT"), ("ATCG", "CGAT"), ("", "")])
def test_reverse_complement(spark, s, want):
    assert one(spark, S.reverse_complement("s"), s=s)[0] == want


def test_reverse_complement_variants(spark):
    r = one(spark, S.reverse_complement("s"), S.reverse_complement_keep_case("s"), S.reverse_complement_strict("s"), s="aCgtNx")
    assert tuple(r) == ("XNACGT", "xNACGT", "NNACGT")


def test_distances(spark):
    r = one(spark, S.hamming("a", "b"), S.hamming("a", F.lit("AC")), S.hamming_ignore_case(F.lower("a"), "b"), S.prefix_distance("a", F.lit("AC")), S.match_fraction("a", "b"), a="ACGT", b="ACCA")
    assert tuple(r) == (2, None, 2, 2, 0.5)
    assert one(spark, S.hamming("a", "b"), a="", b="")[0] == 0


def test_fuzzy_search(spark):
    r = one(spark, S.contains_within("t", F.lit("ACGA")), S.contains_within("t", F.lit("CCCCCC")), S.contains_within("t", F.lit("")), S.find_first("t", F.lit("GTA"), 0), S.find_first("t", F.lit("CCC"), 0), t="TTACGTATT")
    assert tuple(r) == (True, False, True, 4, -1)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ACGN", max_size=30), st.text("ACG", min_size=1, max_size=6)), min_size=1, max_size=20))
def test_find_barcode_agrees_with_a_scan(spark, rows):
    got = spark.createDataFrame(rows, "t string, b string").select("t", "b", S.find_barcode("t", "b", 1, 20).alias("f")).collect()
    for t, b, f in got:
        tries = [(sum(x != y and "N" not in (x, y) for x, y in zip(t[:20][i : i + len(b)], b)), i) for i in range(len(t[:20]) - len(b) + 1)]
        want = min((x for x in tries if x[0] <= 1), default=None)
        assert (tuple(f) if f else None) == want


def test_primer_may_pass_the_end(spark):
    r = one(spark, S.find_primer("t", F.lit("ACGTACGTACGTAC"), 2, 10), S.find_primer("t", F.lit("ACGT"), 2, 10), t="GACGTACGTACG")
    assert (r[0]["mm"], r[0]["pos"]) == (0, 1) and r[1] is None


def test_fnv1a(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for c in s.encode():
            h = (h ^ c) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    for s in ("", "A", "ACGT", "foobar", "ACGT" * 20):
        assert one(spark, S.fnv1a("s"), s=s)[0] == fnv(s)


def test_codes_kmers_counts_qualities(spark):
    r = one(spark, S.base_codes("s"), S.bases_of_codes(S.base_codes("s")), S.kmers("s", 4, 2), S.base_count("s", "A"), S.truncate("s", 3), s="ACGTNAACC")
    assert r[0] == "012340011" and r[1] == "ACGTNAACC" and [tuple(x) for x in r[2]] == [(0, "ACGT")] and r[3] == 3 and r[4] == "ACG"
    assert one(spark, S.kmers("s", 19, 6), s="ACGT")[0] == []
    q = one(spark, S.mean_quality("q"), S.region_quality("q", 1, 2), S.merge_qualities("q", F.lit("!~!")), S.merge_qualities("q", F.lit("~")), q="I5!")
    assert q[0] == pytest.approx(20.0) and q[1] == pytest.approx(10.0) and q[2] == "I~!" and q[3] == "I5!"
    assert one(spark, S.mean_quality("q"), q="")[0] == 0.0


@pytest.mark.parametrize("af,want", [(0.05, "0/0"), (0.25, "0/1"), (0.5, "0/1"), (0.75, "0/1"), (0.95, "1/1")])
def test_genotype(spark, af, want):
    assert one(spark, G.genotype("a"), a=af)[0] == want


def test_mapping_quality_and_rates(spark):
    r = one(spark, G.mapping_quality("s"), G.mapping_quality(-F.col("s")), G.allele_frequency(F.lit(1), F.lit(0)), G.identity(F.lit(9), F.lit(1), F.lit(0)), G.length_score(F.lit(90), F.lit(100)), s=99)
    assert tuple(r) == (60, 0, 0.0, 90.0, pytest.approx(0.9))


def test_variant_quality_against_binomials():
    for n in (1, 10, 100, 1000):
        for k in {0, 1, n // 3, n // 2, n}:
            like = sorted(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for p in (0.01, 0.5, 0.99))
            want = 10 * math.log10(like[2] / like[1]) if like[1] > 1e-10 else 10 * math.log10(n)
            assert G.quality_of(np.array([k]), np.array([n]))[0] == int(min(60, max(0, want)))
    assert G.quality_of(np.array([0]), np.array([0]))[0] == 0 and len(G.quality_of(np.array([]), np.array([]))) == 0


def test_local_alignment():
    same = KN.local_align("ACGTACGTACGT", "ACGTACGTACGT")
    assert (same["matches"], same["mismatches"], same["identity"], same["cigar"], same["score"]) == (12, 0, 100.0, "12M", 24)
    one_off = KN.local_align("ACGTACGTACGT", "ACGTACTTACGT")
    assert one_off["mismatches"] >= 1 and 90 <= one_off["identity"] < 100
    gap = KN.local_align("ACGTACGTTTGGCCAATT", "ACGTACGTGGCCAATT")
    assert gap["cigar"] == "8M2D8M" or gap["gaps"] == 2
    assert gap["cigar_sam"] == gap["cigar"].replace("D", "I") and KN.local_align("", "ACGT")["cigar"] == "0M"


@settings(max_examples=40, deadline=None)
@given(st.text("ACG", min_size=1, max_size=12), st.text("ACG", min_size=1, max_size=12))
def test_banded_scores_against_plain_dynamic_programming(q, t):
    p = BandedParams(band=32)
    score, _ = KN.banded_scores([q], [t], np.array([0]), p)
    best, h = 0, [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (p.match if q[i - 1] == t[j - 1] else p.mismatch), h[i - 1][j] + p.gap, h[i][j - 1] + p.gap)
            best = max(best, h[i][j])
    assert score[0] == best


def test_banded_start():
    ref = "TTTTTTTTTTACGATCGATCGGATTTTTTTTT"
    score, start = KN.banded_scores(["ACGATCGATCGGA"], [ref], np.array([10]))
    assert (score[0], start[0]) == (13, 10)
    assert len(KN.banded_scores([], [], np.array([], int))[0]) == 0


def _plain_banded(q, t, diagonal, p):
    """Score and the alignment of one read by plain loops: (cigar without clips, edits, first row, first column)."""
    h = {}
    at = lambda i, j: h.get((i, j), 0)
    inside = lambda i, j: 0 <= j < len(t) and abs(j - i - diagonal) <= p.band
    best = (0, 0, 0)
    for i in range(len(q)):
        for j in range(max(0, i + diagonal - p.band), min(len(t), i + diagonal + p.band + 1)):
            same = q[i] == t[j] or "N" in (q[i], t[j])
            ways = [(at(i - 1, j - 1) + (p.match if same else p.mismatch), "M"), (at(i - 1, j) + p.gap if inside(i - 1, j) else 0, "I"), (at(i, j - 1) + p.gap if inside(i, j - 1) else 0, "D")]
            score = max(0, *(w for w, _ in ways))
            h[i, j] = score
            if score > 0:
                h[i, j, "by"] = next(op for w, op in ways if w == score)
            if score > best[0]:
                best = (score, i, j)
    score, i, j = best
    ops, edits = "", 0
    first = (0, 0)
    while score and (i, j, "by") in h:
        op, first = h[i, j, "by"], (i, j)
        edits += op != "M" or not (q[i] == t[j] or "N" in (q[i], t[j]))
        ops, i, j = op + ops, i - (op != "D"), j - (op != "I")
    return best, ops, edits, first


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ACGN", max_size=24), st.text("ACGN", max_size=30), st.integers(-3, 6)), min_size=1, max_size=6), st.sampled_from([1, 3, 16]), st.sampled_from([(1, -4, -6), (2, -1, -1), (5000, -4, -3)]))
def test_banded_traces_against_plain_dynamic_programming(cases, band, scores):
    p = BandedParams(*scores, band=band)
    q, t, d = (list(x) for x in zip(*cases))
    got = KN.banded_traces(q, t, np.array(d), p)
    score, start = KN.banded_scores(q, t, np.array(d), p)
    assert score.tolist() == got["score"].tolist() and start.tolist() == got["start"].tolist()
    for (a, b, diagonal), row in zip(cases, got.itertuples()):
        best, ops, edits, first = _plain_banded(a, b, diagonal, p)
        assert row.score == best[0]
        if not best[0]:
            assert (row.cigar, row.edits, row.read_start, row.read_end) == ("*", 0, 0, 0)
            continue
        clip = lambda n: f"{n}S" if n else ""
        assert row.cigar == clip(first[0]) + KN.run_lengths(ops) + clip(len(a) - best[1] - 1)
        assert (row.edits, row.read_start, row.read_end, row.window_start) == (edits, first[0], best[1] + 1, first[1])


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=40), st.text("ACGT", min_size=1, max_size=60), st.integers(0, 8))
def test_a_cigar_replays_to_its_score(q, t, diagonal):
    import re

    p = BandedParams(2, -3, -4, band=10, max_length=30)
    row = KN.banded_traces([q], [t], np.array([diagonal]), p).iloc[0]
    i, j, score, edits = 0, row.window_start, 0, 0
    for n, op in re.findall(r"(\d+)([MIDS])", row.cigar):
        for _ in range(int(n)):
            if op == "M":
                score, edits = score + (p.match if q[i] == t[j] else p.mismatch), edits + (q[i] != t[j])
            elif op in "ID":
                score, edits = score + p.gap, edits + 1
            i, j = i + (op in "MIS"), j + (op in "MD")
    assert score == row.score and edits == row.edits and (i == len(q) or row.score == 0)


def test_traces_in_parts_are_the_same(monkeypatch):
    import random

    rnd = random.Random(3)
    ref = "".join(rnd.choice("ACGT") for _ in range(400))
    reads = [ref[a : a + n // 2] + "AC" * (n % 3) + ref[a + n // 2 + n % 5 : a + n] for a in range(0, 300, 7) for n in (20, 57, 90)]
    windows = [ref[max(0, a - 20) : a + 120] for a in range(0, 300, 7) for _ in range(3)]
    d = np.array([min(a, 20) for a in range(0, 300, 7) for _ in range(3)])
    whole = KN.banded_traces(reads, windows, d)
    monkeypatch.setattr(KN, "BAND_CELLS", 20_000)
    assert whole.equals(KN.banded_traces(reads, windows, d)) and whole["cigar"].str.contains("[ID]").any()


def test_parents_shorter_than_the_query_take_no_part():
    """A right side, and de novo a left side too, comes from a parent that reaches to the query's end."""
    import random

    from strandline.schemas import ChimeraParams

    p = ChimeraParams()
    query = "A" * 50 + "C" * 50
    parents = [(0, "A" * 100, 50), (1, "C" * 95, 50), (2, "G" * 100, 50)]
    for references in (False, True):
        d, _ = KN.best_joins([query], [1], parents, p, references)
        assert d[0] >= 50
    rnd = random.Random(5)
    base = lambda n: "".join(rnd.choice("AC") for _ in range(n))
    parents = [(i, base(rnd.choice([60, 80, 95, 100, 120])), rnd.randrange(5, 60)) for i in range(6)]
    queries = [(base(rnd.choice([60, 80, 100])), rnd.randrange(1, 30)) for _ in range(60)]
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    for references in (False, True):
        got = KN.best_joins([q for q, _ in queries], [a for _, a in queries], parents, p, references)
        for (q, a), d, bp in zip(queries, *got):
            best = None
            own = [x for x in parents if references or x[2] >= p.abundance_ratio * a]
            for at in range(p.edge, len(q) - p.edge + 1, p.step):
                lefts = {i: far(q[:at], s[:at]) for i, s, _ in own if len(s) >= (at if references else len(q))}
                rights = {i: far(q[at:], s[at:]) for i, s, _ in own if len(s) >= len(q)}
                sums = [lefts[i] + rights[j] for i in lefts for j in rights if i != j or not references]
                if len(own) >= 2 and sums and (best is None or min(sums) < best[0]):
                    best = (min(sums), at)
            assert (d, bp) == (best or (-1, -1))
