"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id and text checksum and never changes. Bytes are summed per slot,
and a map of at most ``SLOTS`` rows says which shard holds each slot. ``plan`` builds version 1,
``rebalance`` edits a map (for new sizes or another shard count) and moves only the slots it must.
Maps are DataFrames of (version, slot, shard, bytes) and are stored by appending versions.

The law of ``assign`` is ``bytes``: sizes of the shards are near equal. Under it, records of equal
texts (a group) may lie in several shards: a group that holds a third of all bytes must be split for
the sizes to be near equal, so a slot hashes the id with the text. Null texts have size 1; null ids
hash by their text. Rows that repeat id and text share a slot, and are numbered in it in any order.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm._spark import Scratch, table

#: Fixed number of virtual slots: bounds the map and everything that is gathered or broadcast here.
SLOTS = 8192

_MAP = "version int, slot int, shard int, bytes long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row."""
    crc = "crc32(cast(coalesce(text, '') as binary))"
    base = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(octet_length(text), 0) + 1L size", f"{crc} text_crc32")
    return base.withColumn("vslot", F.expr(f"cast(pmod(xxhash64(doc_id, text_crc32), {slots}) as int)"))


def slot_bytes(found: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most ``SLOTS`` rows reach the driver."""
    return {r[0]: (r[1], r[2]) for r in found.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()}


def plan(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Largest slot first, each to the shard with the fewest bytes so far (ties: lowest shard)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return out


def rebalance(old: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """An edited map: slots of shards that are gone, and the fewest others that bring every shard within
    ``tolerance`` of the mean (or as near as whole slots allow), go to the emptiest shards."""
    out = {slot: shard for slot, shard in old.items() if shard < shards}
    held = [0] * shards
    for slot, shard in out.items():
        held[shard] += sizes.get(slot, 0)
    mean = sum(sizes.values()) / shards
    moving = [slot for slot in set(sizes) | set(old) if slot not in out]
    for shard in range(shards):
        if held[shard] <= mean * (1 + tolerance):
            continue
        for slot in sorted((s for s, x in out.items() if x == shard), key=lambda s: (-sizes.get(s, 0), s)):
            if held[shard] - sizes.get(slot, 0) >= mean:  # down to the mean, largest slots first
                held[shard] -= sizes.get(slot, 0)
                moving.append(slot)
    for slot in moving:
        out.pop(slot, None)
    heap = [(held[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-sizes.get(s, 0), s)):
        size, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + sizes.get(slot, 0), shard))
    return out


def as_map(spark: SparkSession, assigned: dict[int, int], sizes: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, slot, shard, sizes.get(slot, 0)) for slot, shard in sorted(assigned.items())], _MAP)


def store(slot_map: DataFrame, path: str) -> None:
    """Append a version; earlier ones stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given or the latest version of a stored map."""
    maps = spark.read.schema(_MAP).parquet(path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == version)


def assign(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Every row with its shard and its place in the shard, counted from 0 in order of virtual slot and id."""
    spark = docs.sparkSession
    found = Scratch(spark).put(records(docs, slots))
    stats = slot_bytes(found)
    assigned = plan({s: b for s, (b, _) in stats.items()}, shards)
    base, rows = [0] * shards, []
    for slot in sorted(assigned):
        rows.append((slot, assigned[slot], base[assigned[slot]]))
        base[assigned[slot]] += stats[slot][1]
    places = F.broadcast(spark.createDataFrame(rows, "vslot int, shard int, base long"))
    inner = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = found.withColumn("place", F.row_number().over(inner) - 1).join(places, "vslot")
    return placed.selectExpr("doc_id", "size", "text_crc32", "'bytes' law", "shard", "base + place slot", "cast(null as int) grown_shard", "vslot")


def query(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))
