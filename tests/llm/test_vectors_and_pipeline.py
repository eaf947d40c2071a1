import glob
import os

import numpy as np
import pytest

from strandline.llm import hilbert_ann

SF = "/root/testdata/sf0.001"


def brute(ids, x, k, every):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = hilbert_ann.exact(np.repeat(x[i : i + 1], len(x), 0), x)
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(o)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [0, 5])
def test_neighbours_against_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    if clusters:
        x = 0.1 * x + 3 * rng.standard_normal((clusters, 16)).astype(np.float32)[np.arange(700) % clusters]
    x[300:420] = x[7]  # one vector that many rows share
    ids = rng.permutation(2000)[:700].astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert_ann.nearest(df, k=10, every=20).collect())
    assert got == brute(ids, x.astype(float), 10, 20)
    near = {(r.query_id, r.vec_id) for r in hilbert_ann.nearest(df, k=10, every=20, exact=False).collect()}
    if clusters:
        assert len(near & {(a, c) for a, _, c, _ in got}) > 0.5 * len(got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [], 1), (1, [0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert_ann.nearest(df).collect())
    assert {(q, v, s) for q, _, v, s in got} == {(0, 1, 0.5), (0, 20, 0.0), (20, 1, 0.5), (20, 0, 0.0)}
    assert hilbert_ann.nearest(df.where("false")).count() == 0


def test_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        place = hilbert_ann.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@needs_data
def test_registered_queries_and_sql(spark):
    import __spark_entry__ as e
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    names = sorted(n for n in e.queries() if n.startswith("op") and n[2].isdigit())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 13))
    df = e.queries()["op3_mixing_weights"](spark, SF)
    rel = con.sql(e.oracle_sql()["op3_mixing_weights"])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.select(cols).fetchall())


@needs_data
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_weights", "token_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, "s", 0), (-2, "x " * 40_000, "en", "s", 80_000)], docs.schema)
    docs = docs.union(odd)
    steps = dict(P.STAGES)
    clean = steps["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() <= docs.count()
    one = steps["ngram_jaccard_join"](spark, docs, SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in one.collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows.items()}
    for i in set(rows) - kept:
        assert any(j is not None and j < i and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75 for j in rows if j != i), i
    for i in kept - {None}:
        assert not any(j is not None and j != i and sets[j] and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in kept)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in steps["benchmark_decontamination"](spark, docs, SF).collect()}
    assert not any(b in (rows[i] or "") for i in left for b in bench) and {i for i, t in rows.items() if not any(b[:40] in (t or "") for b in bench)} <= left
    mixed = steps["mixing_weights"](spark, docs, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(rows)
    assert {x for r in steps["token_packing"](spark, docs, SF).collect() for x in r.doc_ids} == set(rows)


@needs_data
def test_toxic_stage_against_documents_scored_one_by_one(spark):
    import corpus_pipeline as P
    import pyarrow as pa

    from strandline.llm import _kernel as K
    from strandline.llm import toxicity

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in dict(P.STAGES)["toxicity"](spark, docs, SF).select("doc_id").collect()}
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for i, text in texts.items():
        data, offsets = K.raw_text(pa.array([text], pa.string()))
        assert (model.score(model.features(K.LOWER[data[: offsets[-1]]], offsets))[0] < 0.5) == (i in kept), i
    known = {r.doc_id: bool(r.toxic) for r in labels.where("toxic is not null").collect() if r.doc_id in texts}
    assert any(known.values()) and sum((i in kept) == bad for i, bad in known.items()) <= 0.05 * len(known)
