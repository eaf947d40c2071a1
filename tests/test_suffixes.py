"""The suffix order and searches of patterns of any length against plain Python."""

import random

import pytest

from strandline.operators import suffixes

CONTIGS = "name string, ordinal int, sequence string"


def build(spark, tmp_path, texts, **more):
    contigs = spark.createDataFrame([(f"c{i}", i, s) for i, s in enumerate(texts)], CONTIGS)
    return contigs, suffixes.build_suffix_index(contigs, str(tmp_path / "index"), **more)


def places(texts, pattern):
    return {(pattern, f"c{i}", p) for i, s in enumerate(texts) for p in range(len(s)) if s.startswith(pattern, p)}


REPEATS = ["ACGT" * 40 + "A" * 70, "A" * 150, "GATTACA" + "ACGT" * 30, "", "T", "ACGTTGCA" * 9 + "C"]


@pytest.mark.parametrize("first, tile", [(4, 1 << 16), (16, 64)])
def test_order_is_that_of_the_suffixes(spark, tmp_path, first, tile):
    contigs, index = build(spark, tmp_path, REPEATS, first=first, tile=tile)
    got = index.order(spark).collect()
    spots = [(f"c{i}", p) for i, s in enumerate(REPEATS) for p in range(len(s))]
    text = {f"c{i}": s for i, s in enumerate(REPEATS)}
    assert sorted((r.contig, r.position) for r in got) == sorted(spots)
    by_rank: dict = {}
    for r in got:
        by_rank.setdefault(r.rank, []).append(text[r.contig][r.position :])
    assert all(len(set(same)) == 1 for same in by_rank.values())  # equal suffixes of different contigs share a rank
    ordered = sorted(text[c][p:] for c, p in spots)
    assert all(ordered[rank] == same[0] and ordered[rank + len(same) - 1] == same[0] for rank, same in by_rank.items())


def test_patterns_of_any_length(spark, tmp_path):
    rng = random.Random(4)
    texts = [*REPEATS, "".join(rng.choice("ACGT") for _ in range(500)), "".join(rng.choice("ACGT") for _ in range(90)) + "ACGT" * 20]
    contigs, index = build(spark, tmp_path, texts, tile=256)
    asked = ["A", "T", "ACGT", "A" * 69, "A" * 70, "A" * 71, "A" * 100, "ACGT" * 10, "CGTA" * 20, "ACGT" * 35, "GATTACA", "GATTACAACGTACGTACGTA", "N", "ACGN" * 10, "T" * 40, "", None, "A"]
    for t in texts:
        for _ in range(25):
            if t:
                a = rng.randrange(len(t))
                asked.append(t[a : a + rng.randrange(1, 101)])
    asked += [x[:-1] + "C" for x in asked if x and len(x) > 17][:20] + [texts[6][:40] + texts[6][60:100], texts[6][400:] + texts[7][:30]]
    frame = spark.createDataFrame([(x,) for x in asked], "pattern string")
    want = {x for p in set(asked) if p for x in places(texts, p)}
    got = suffixes.search(frame, index, contigs, tile=256).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    counts = {r.pattern: r.n for r in suffixes.count(frame, index, contigs, tile=256).collect()}
    assert counts == {p: len(places(texts, p)) for p in set(asked) if p}


def test_a_saved_index_is_read_again(spark, tmp_path):
    contigs, index = build(spark, tmp_path, ["ACGTACGTTTGACCAGTACGATCAGGATCC"])
    again = suffixes.SuffixIndex(index.folder, index.levels)
    got = suffixes.search(spark.createDataFrame([("ACG",), ("GATC",)], "pattern string"), again, contigs).collect()
    assert sorted((r.pattern, r.position) for r in got) == [("ACG", 0), ("ACG", 4), ("ACG", 17), ("GATC", 19), ("GATC", 25)]


def test_nothing_to_search(spark, tmp_path):
    contigs, index = build(spark, tmp_path, [""])
    asked = spark.createDataFrame([("ACG",), ("ACGT" * 9,)], "pattern string")
    assert suffixes.search(asked, index, contigs).count() == 0
    assert {r.n for r in suffixes.count(asked, index, contigs).collect()} == {0}
