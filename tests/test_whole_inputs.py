"""Queries over all reads, clusters and contigs, against plain Python."""

import collections
import os

import pytest

from strandline.plans import fixtures as X
from strandline.plans import registry

SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("driver tables are absent", allow_module_level=True)


def test_all_reads_are_paired(spark):
    names = dict(X.reads(spark, SF).select("read_id", "name").collect())
    got = registry.queries()["paired_reads"](spark, SF).collect()
    assert len(names) > 900 and {r.read_id: r.name for r in got} == {i: n for i, n in names.items() if i ^ 1 in names} and len(got) == len({r.read_id for r in got})
    assert all((r.pair_id, r.mate) == (r.read_id // 2, r.read_id % 2 + 1) for r in got)


def test_chimeras_of_all_clusters(spark):
    n, first = collections.Counter(), {}
    for r in X.reads(spark, SF).select("read_id", "sequence").collect():
        n[r.sequence] += 1
        first[r.sequence] = min(r.read_id, first.get(r.sequence, r.read_id))
    parents = sorted(n, key=lambda s: (-n[s], s))[:100]
    novo, ref = {}, {}
    for q in n:
        sides = []
        for p in parents:
            run = [0]
            for x, y in zip(q, p):
                run.append(run[-1] + (x != y))
            sides.append((p, run))
        best_n, best_r = [], []
        for bp in range(30, 71, 5):
            many = [(run[bp], run[-1] - run[bp]) for p, run in sides if n[p] >= 2 * n[q]]
            if len(many) > 1:
                best_n.append((min(x for x, _ in many) + min(y for _, y in many), bp))
            left = sorted((run[bp], p) for p, run in sides)[:2]
            right = sorted((run[-1] - run[bp], p) for p, run in sides)[:2]
            best_r.append((min(x + y for x, a in left for y, b in right if a != b), bp))
        for out, best in ((novo, best_n), (ref, best_r)):
            d, bp = min(best, default=(-1, -1))
            out[first[q]] = (d, bp, 0 <= d < 10)
    run = lambda name: registry.queries()[name](spark, SF).collect()
    assert len(n) > 24
    assert {r.id: (r.distance, r.breakpoint, r.is_chimera) for r in run("chimera_de_novo")} == novo
    assert {r.id: (r.distance, r.breakpoint, r.is_chimera) for r in run("chimera_reference")} == ref
    assert {r.id: r.abundance for r in run("chimera_filter")} == {i: n[s] for s, i in first.items() if not (novo[i][2] or ref[i][2])}
    s = run("chimera_stats")[0]
    assert (s.checked, s.de_novo, s.reference) == (len(n), sum(x[2] for x in novo.values()), sum(ref[i][2] and not novo[i][2] for i in ref)) and s.found == s.de_novo + s.reference


def test_local_alignment_over_all_contigs(spark):
    names = {r.ordinal: r.name for r in X.contigs(spark, SF).collect()}
    got = registry.queries()["sw_local"](spark, SF).collect()
    assert len(names) == 25 and {r.query_id: r.target_id for r in got} == names and all(r.score >= 150 for r in got)


def test_strings_that_share_a_primer_are_not_all_candidates(spark):
    """A hot segment, and two: candidates grow with the strings, and no pair within the distance is lost."""
    import random

    from strandline.operators import amplicon as M

    rng = random.Random(6)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))

    def reads(n, head, tail):
        inner = [base(40) for _ in range(n)]
        near = [x[:i] + rng.choice("ACGT") + x[i + 1 : 30] + rng.choice("ACGT") + x[31:] for x in inner[: n // 10] for i in (3,)]
        return sorted({head + x + tail for x in inner + near})

    for head, tail in ((base(30), ""), (base(25), base(25))):
        counts = []
        for n in (200, 800):
            texts = reads(n, head, tail)
            frame = spark.createDataFrame([(x,) for x in texts], "s string")
            counts.append(M.near_candidates(frame, 2, 16).count())
            got = {tuple(r) for r in M.near_pairs(frame, 2, 16).collect()}
            far = lambda a, b: sum(x != y for x, y in zip(a, b))
            cores = {}
            for t in texts:
                cores.setdefault(t[len(head) :][:20], []).append(t)
                cores.setdefault(t[len(head) + 20 :][:20], []).append(t)
            if n == 200:
                assert got == {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if far(a, b) <= 2}
            assert len(got) >= n // 20
        assert counts[0] < 4 * 200 and counts[1] < 4 * 800  # all pairs would be some 24,000 and 380,000
    assert M.near_pairs(spark.createDataFrame([("ACG",), ("ACT",), ("",), ("A",), ("C",)], "s string"), 2).count() == 2
