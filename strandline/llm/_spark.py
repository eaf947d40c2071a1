"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master or ""
    if master == "local" or master.startswith("local["):
        return "/tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: Bytes of one Arrow batch between the JVM and a Python worker; rows of long texts then come in small batches.
BATCH_BYTES = 4 << 20
#: Rows that the Parquet reader decodes at once. A column's rows lie in one array of doubling size, so thousands of long texts
#: at once would make arrays of many MB, for which an executor's heap grows.
READ_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` and the reader's batches to ``READ_ROWS`` unless the session holds them lower; memory of a
    worker and of a scan follows from them."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(key, None)
        if not now or not str(now).isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def trim_driver(spark: SparkSession) -> None:
    """Give the driver's freed native memory back to the system. Every exchange and task starts threads of the driver's
    JVM, whose allocator keeps what they have freed; a long pipeline would otherwise grow by it from stage to stage."""
    with contextlib.suppress(Exception):  # another JVM than HotSpot on Linux
        jvm = spark.sparkContext._jvm
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        beans.invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None)


class Scratch:
    """Tables written to the shared folder to end lineage: a lost executor costs no recomputation behind them.

    ``drop`` removes tables that nothing reads any more, ``clear`` all of them; what is left goes when the driver
    exits, since returned DataFrames may still read it. ``put`` ends broadcasts handed to ``after``, which only
    the table that it writes has used.
    """

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/strandline-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)

    def put(self, df: DataFrame, after=()) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        for shared in after:
            shared.destroy()
        if self.n % 8 == 0:
            trim_driver(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = t.__dict__.get("_scratch_path")
            if path and path.startswith(self.root):
                self._remove(path)

    def clear(self) -> None:
        self._remove(self.root)
        atexit.unregister(self.clear)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):
            sc = self.spark.sparkContext
            if sc._jsc is not None:
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def lean(scan):
    """``scan`` as the function of tasks that give their freed memory back at their end. Python workers are reused from stage to
    stage, so what one stage keeps adds to what the next one needs."""

    def run(batches):
        yield from scan(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(Exception):  # another C library than glibc
            import ctypes

            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def tidy_driver(spark: SparkSession) -> None:
    """Let go of the plans that the driver's Python still holds in cycles, and of its freed native memory."""
    gc.collect()
    trim_driver(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is. It is counted, so give a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def without(docs: DataFrame, gone: DataFrame, scratch: Scratch, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (doc_id bigint); rows with a null id stay.

    Few ids are broadcast. Of more, a Bloom filter of 16 bits an id, 128 MB at most, lets the rows pass that are certainly
    not among them, and only the others are joined: texts that stay are hardly shuffled.
    """
    gone = scratch.put(gone.where("doc_id is not null").distinct())
    n = gone.count()
    same = docs["doc_id"].cast("bigint") == gone["doc_id"]
    if n <= most:
        return docs.join(F.broadcast(gone), same, "left_anti")
    bits = min(30, max(20, (16 * n).bit_length()))

    def cells(ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.stack([(h >> np.uint64(s)).astype(np.int64) & ((1 << bits) - 1) for s in (0, 17, 34)])

    shared = docs.sparkSession.sparkContext.broadcast(bit_table(gone, "doc_id", bits, cells))
    at = docs.columns.index("doc_id")

    def part(wanted: bool):
        def scan(batches):
            words = shared.value
            for b in batches:
                ids = b.column(at).cast(pa.int64())
                hit = ids.is_valid().to_numpy(zero_copy_only=False)
                for place in cells(ids.fill_null(0).to_numpy(zero_copy_only=False)):
                    hit &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
                yield b.filter(pa.array(hit == wanted))

        return docs.mapInArrow(scan, docs.schema)

    maybe = part(True)
    return part(False).union(maybe.join(gone, maybe["doc_id"].cast("bigint") == gone["doc_id"], "left_anti"))


#: A task's forest is sent on when it has so many nodes, which bounds its memory.
FOREST = 500_000


def _forest(batches):
    """Edges (a, b) of a task to edges from every node to the least node that it reaches in the task."""
    up: dict = {}

    def root(x):
        top = x
        while (after := up.get(top, top)) != top:
            top = after
        while (after := up.get(x, x)) != top:
            up[x] = top
            x = after
        return top

    def out(kind):
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        up.clear()
        for lo in range(0, len(pairs), 65_536):
            cols = []
            for values in zip(*pairs[lo : lo + 65_536]):
                if pa.types.is_struct(kind):
                    fields = list(kind)
                    cols.append(pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*values), fields)], fields=fields))
                else:
                    cols.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(cols, ["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        a, b = (zip(*(f.to_pylist() for f in c.flatten())) if pa.types.is_struct(c.type) else c.to_pylist() for c in batch.columns)
        for x, y in zip(a, b):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST:
            yield from out(kind)
    if up:
        yield from out(kind)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: smallest node reachable.

    Each task first replaces its edges by a forest, which bounds what follows by the number of nodes. Large-star and
    small-star steps then alternate until the edges are stars, however many rounds that takes. Each step is one
    aggregate and one join on the node; no neighbour list is gathered, so hubs are safe, and every round is written
    to the shared folder. Null nodes are not among the edges.
    """
    kind = f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['b'].dataType.simpleString()}"
    e = scratch.put(edges.where("a <> b").select("a", "b").mapInArrow(lean(_forest), kind).selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    while not _stars(e):
        both = e.union(e.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        e1 = both.where("b > a").join(least, "a").selectExpr("b a", "m b")
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        stars = e1.join(low, "a").selectExpr("b a", "m b").where("a <> b").union(low.selectExpr("a", "m b"))
        old, e = e, scratch.put(stars.selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
        scratch.drop(old)
    return e.selectExpr("a node", "b component").union(e.selectExpr("b node", "b component").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to its centre: then each component is one star."""
    roles = e.selectExpr("a node", "1 child", "0 centre").union(e.selectExpr("b node", "0 child", "1 centre"))
    roles = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
    return roles.where("child > 1 or child = 1 and centre = 1").isEmpty()


def bit_table(wanted: DataFrame, column: str, bits: int, cells) -> np.ndarray:
    """2**``bits`` bits as words, those of ``cells(values)`` set for every value of a long column: fixed size at any input."""

    def mark(batches):
        for b in batches:
            at = np.unique(cells(b.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "mask"])

    got = wanted.select(column).mapInArrow(lean(mark), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out
