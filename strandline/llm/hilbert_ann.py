"""Nearest neighbours by inner product over shifted Hilbert curves.

Vectors are projected to a few dimensions by fixed random directions, once per ordering, shifted,
and numbered along a Hilbert curve. Spark range-partitions each ordering by that key; a query's
neighbours within ``window`` places on either side are reranked by their inner product on the
original vectors, and the orderings' lists merge. That gives each query a floor: the ``k``-th best
score found so far.

Vectors without structure (nearly orthogonal neighbours) put most true neighbours outside of any
narrow window, so windows are then merged outwards: the vectors and the queries, each in blocks along
the first curve, are compared by the blocks' centres and radii first, and only those pairs of blocks
are joined that may hold a neighbour above some query's floor; clustered data skip most. What is not
skipped is scored, so the result is exact. This compares a stated query set with all rows, in blocks of
bounded size. Only block summaries are broadcast, ``PAGE`` of them at a time; nothing of the data is
gathered on the driver. ``exact=False`` stops after the windows.

Vectors that are null, zero, hold nulls or non-finite components, or have another length than most
take no part, nor do rows with a null id. Rows with the query's own id are not its neighbours; of
rows that repeat an id each counts. Ties go to the smaller id. Scores are double-precision sums in
one fixed order, so equal vectors have equal scores. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._spark import Scratch, table

DIMS = 8
BITS = 7
#: Vectors of a block, queries of a block, and block summaries (a vector each) that are broadcast at once.
ROWS = 2048
QUERIES = 4096
PAGE = 50_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n, d) along the Hilbert curve of ``bits`` bits a dimension (transposed Gray code form)."""
    x = cells.astype(np.uint32).copy()
    n, d = x.shape
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(d):
            on = (x[:, i] & q) > 0
            x[on, 0] ^= p
            t = np.where(on, np.uint32(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= t
            x[:, i] ^= t
        q = np.uint32(q >> 1)
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.uint32)
    q = top
    while q > 1:
        t = np.where((x[:, d - 1] & q) > 0, t ^ np.uint32(q - 1), t)
        q = np.uint32(q >> 1)
    x ^= t[:, None]
    out = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[:, i] >> np.uint32(b)) & 1).astype(np.uint64)
    return out.view(np.int64)


def directions(ordering: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions and shifts of an ordering; the same everywhere."""
    rng = np.random.Generator(np.random.PCG64([ordering, size, 77]))
    q, _ = np.linalg.qr(rng.standard_normal((size, max(min(DIMS, size), 1))))
    return q, rng.random(q.shape[1])


def keys(x: np.ndarray, ordering: int) -> np.ndarray:
    """Curve keys of unit-length copies of the rows of x, projected and shifted."""
    q, shift = directions(ordering, x.shape[1])
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ q
    # the grid is wider than the data by half, so that a shift keeps all within it
    span = 3.0 / np.sqrt(x.shape[1])
    cells = np.clip((y / span + 1) / 3 + shift / 3, 0, 1 - 1e-9) * (1 << BITS)
    return hilbert(cells.astype(np.int64), BITS)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for part in (a.astype(np.float64) * b.astype(np.float64)).T:
        out += part
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and the length of their vectors."""
    v = f"cast({vec_col} as array<double>)"
    good = vectors.selectExpr(f"cast({id_col} as bigint) vec_id", f"{v} v").where("vec_id is not null and v is not null and size(v) > 0")
    good = good.where("forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('infinity')) and exists(v, x -> x <> 0)")
    first = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = first[0] if first else 1
    return good.where(F.size("v") == size), size


def _top(q_ids, q, ids, x, floor, k, prelim=None):
    """(query row, id, score): the best k of x for each row of q that reach its floor, ids of its own left out."""
    s = q @ x.T if prelim is None else prelim
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        edge = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        floor = np.maximum(floor, edge)
    row, col = np.nonzero(s >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
    live = np.isfinite(s[row, col])
    row, col = row[live], col[live]
    score = exact(q[row], x[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    start = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], ids[col[keep]], score[keep]


def _emit(q_ids, row, ids, score):
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


_HIT = "query_id long, vec_id long, score double"


def _windows(keyed: DataFrame, size: int, window: int, k: int, every: int) -> DataFrame:
    """Best neighbours of each query among ``window`` places on either side in each ordering."""

    def work(ids, x, order, lo, hi):
        for i in range(lo, hi):
            if ids[i] % every == 0:
                a, b = max(0, i - window), min(len(ids), i + window + 1)
                same = np.flatnonzero(order[a:b] == order[i]) + a
                row, found, score = _top(ids[i : i + 1], x[i : i + 1], ids[same], x[same], np.array([-np.inf]), k)
                if len(row):
                    yield _emit(ids[i : i + 1], row, found, score)

    def scan(batches):
        ids, order, x = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, size))
        done = 0
        for b in batches:
            order = np.concatenate((order, b.column(0).to_numpy()))
            ids = np.concatenate((ids, b.column(2).to_numpy()))
            x = np.vstack((x, _matrix(b.column(3), size)))
            ready = max(done, len(ids) - window)  # the rest waits for its right-hand neighbours
            yield from work(ids, x, order, done, ready)
            cut = max(0, ready - window)
            ids, order, x, done = ids[cut:], order[cut:], x[cut:], ready - cut
        yield from work(ids, x, order, done, len(ids))

    parts = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # ids split places that many equal vectors share
    dealt = keyed.repartitionByRange(int(parts), "ordering", "key", "vec_id").sortWithinPartitions("ordering", "key", "vec_id")
    return dealt.select("ordering", "key", "vec_id", "v").mapInArrow(scan, _HIT)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, orderings: int = 4, window: int = 64, exact: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    good, size = valid_vectors(vectors, id_col, vec_col)

    def place(batches):
        for b in batches:
            x = _matrix(b.column(1), size)
            for o in range(orderings):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o)), pa.array(keys(x, o)), b.column(0), b.column(1)], ["ordering", "key", "vec_id", "v"])

    keyed = scratch.put(good.mapInArrow(place, "ordering long, key long, vec_id long, v array<double>"))
    hits = scratch.put(_windows(keyed, size, window, k, every))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if exact:
        hits = scratch.put(_complete(keyed.where("ordering = 0"), hits, size, k, every, scratch))
    else:
        hits = hits.distinct()
    return hits.withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _blocks(rows: DataFrame, size: int, most: int, parts: int) -> DataFrame:
    """Blocks of at most ``most`` rows (vec_id, key, v, floor) in order of the curve, as bytes, with their centre and radius."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), _matrix(b.column(1), size), b.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            while n >= most:
                ids, x, floor = (np.concatenate([h[i] for h in held]) for i in range(3))
                yield out(ids[:most], x[:most], floor[:most])
                held, n = [(ids[most:], x[most:], floor[most:])], n - most
        if n:
            yield out(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    def out(ids, x, floor):
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        return pa.RecordBatch.from_arrays([*(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, floor, centre)), pa.array([radius])], ["ids", "x", "floor", "centre", "radius"])

    # few rows must not make many small blocks
    parts = max(1, min(parts, -(-rows.count() // most)))
    dealt = rows.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id").coalesce(parts)
    kind = "ids binary, x binary, floor binary, centre binary, radius double"
    return dealt.select("vec_id", "v", "floor").mapInArrow(run, kind).withColumn("block", F.monotonically_increasing_id())


def _may_meet(q: DataFrame, d: DataFrame, size: int, scratch: Scratch, page: int = PAGE) -> DataFrame:
    """(qb, db): pairs of a query block and a block that may hold a vector above the floor of one of its queries."""
    sc, n = q.sparkSession.sparkContext, d.count()
    out = None
    for at in range(-(-n // page) or 1):
        part = d.select("block", "centre", "radius").where(F.pmod(F.xxhash64("block"), F.lit(-(-n // page) or 1)) == at).toArrow()
        centres = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(-1, size)
        shared = sc.broadcast((part.column(0).to_numpy(), centres, part.column(2).to_numpy()))

        def scan(batches, shared=shared):
            blocks, centres, radius = shared.value
            for b in batches:
                for block, qx, floor in zip(*(c.to_pylist() for c in b.columns)):
                    qx, floor = np.frombuffer(qx).reshape(-1, size), np.frombuffer(floor)
                    need = np.zeros(len(blocks), bool)
                    for lo in range(0, len(qx), 64):
                        need |= (_reach(qx[lo : lo + 64], centres, radius) >= floor[lo : lo + 64, None]).any(0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(need.sum()), block)), pa.array(blocks[need])], ["qb", "db"])

        found = scratch.put(q.select("block", "x", "floor").mapInArrow(scan, "qb long, db long"), [shared])
        out = found if out is None else out.union(found)
    return out


def _reach(q: np.ndarray, centres: np.ndarray, radius) -> np.ndarray:
    """Upper bounds of the inner products of each query with the vectors of each block."""
    return (q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radius) * (1 + 1e-9) + 1e-9 * (1 + np.abs(q @ centres.T))


def _complete(keyed: DataFrame, hits: DataFrame, size: int, k: int, every: int, scratch: Scratch) -> DataFrame:
    """Hits of all blocks that may hold a better neighbour than a query's floor."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = hits.distinct().withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    floors = best.where(f"r = {k}").selectExpr("query_id", "score floor")
    queries = scratch.put(keyed.where(f"vec_id % {every} = 0").join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "key", "v", "floor"))
    # written, so that the blocks' numbers stay
    q = scratch.put(_blocks(queries, size, QUERIES, parts))
    d = scratch.put(_blocks(keyed.selectExpr("vec_id", "key", "v", "cast(null as double) floor"), size, ROWS, parts))
    pairs = _may_meet(q, d, size, scratch)

    def meet(batches):
        for b in batches:
            for qids, qx, floor, ids, x, centre, radius in zip(*(c.to_pylist() for c in b.columns)):
                qids, ids = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                qx, x = np.frombuffer(qx).reshape(-1, size), np.frombuffer(x).reshape(-1, size)
                floor = np.frombuffer(floor)
                on = np.flatnonzero(_reach(qx, np.frombuffer(centre)[None], radius)[:, 0] >= floor)
                for lo in range(0, len(on), 256):
                    at = on[lo : lo + 256]
                    row, found, score = _top(qids[at], qx[at], ids, x, floor[at], k)
                    if len(row):
                        yield _emit(qids[at], row, found, score)

    # a query block goes once to each group of blocks that it meets, a block once to each query block that it meets
    groups = max(1, -(-d.count() // max(1, min(64, d.count() * q.count() // (4 * parts)))))
    cells = pairs.withColumn("cell", F.expr(f"pmod(xxhash64(db), {groups})"))
    left = cells.select("qb", "cell").distinct().join(q.selectExpr("block qb", "ids qids", "x qx", "floor"), "qb")
    right = cells.join(d.selectExpr("block db", "ids", "x", "centre", "radius"), "db")
    met = left.join(right, ["qb", "cell"])
    return met.select("qids", "qx", "floor", "ids", "x", "centre", "radius").mapInArrow(meet, _HIT)


def query(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


#: Every query against every other vector.
ORACLE_SQL = """WITH w AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT * FROM w WHERE len(e) = (SELECT len(e) FROM w GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
s AS (SELECT q.vec_id query_id, v.vec_id, list_inner_product(q.e, v.e) score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 20"""
