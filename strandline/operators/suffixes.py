"""A suffix order of the reference by prefix doubling, and searches of patterns of any length by equi-joins.

Positions are first ranked by their next ``FIRST`` bases. A position whose rank no other has is settled; the others are
ranked by pairs of ranks, their own and that of the position as far behind as bases are ranked already, so the ranked length doubles each round until
all ranks differ. A rank is the number of positions with a smaller prefix, and so the place in the suffix order at the end. Suffixes end
with their contig; equal ones, of different contigs, share their rank. Running counts come from range partitions and their totals, so that no rank, however many positions share it, is one
task's work, and rounds after the first look at unsettled positions only.

What each round names is kept: the prefix or pair of a rank, and the positions that it ranked. A pattern is cut into blocks of ``FIRST``
bases, whose ranks are joined to ranks of twice the length as in the rounds, so its longest prefix of such a length leads to
candidates that share at least half of the pattern, whatever repeats the reference has; the candidates' windows are compared
with the pattern by tile. Patterns shorter than ``FIRST`` are prefixes of the first round's names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import align as A

#: Bases that the first round ranks.
FIRST = 16


@dataclass(frozen=True)
class SuffixIndex:
    """Where the tables of an index are; ``levels`` are the lengths that its rounds ranked."""

    folder: str
    levels: tuple[int, ...]

    def names(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/names/{level}")

    def ranked(self, spark: SparkSession, level: int) -> DataFrame:
        """contig, position, rank, n of the positions that a round ranked; n positions share the rank."""
        return spark.read.parquet(f"{self.folder}/ranked/{level}")

    def order(self, spark: SparkSession) -> DataFrame:
        """contig, position, rank of all positions: the suffix array."""
        return spark.read.parquet(f"{self.folder}/now/{self.levels[-1]}").select("contig", "position", "rank")


def _counted_before(groups: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """``groups`` (keys, n) with ``before``: the sum of n over all smaller keys.

    Range partitions are written once with their number, summed each, and the sums (one row a partition) lead to every partition's start.
    """
    spark = groups.sparkSession
    groups.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()).write.parquet(folder)
    parts = spark.read.parquet(folder)
    sums = parts.groupBy("part").agg(F.sum("n").alias("s"))
    starts = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = parts.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return within.join(F.broadcast(starts), "part").withColumn("before", F.col("start") + F.col("within")).drop("part", "start", "within")


def build_suffix_index(contigs: DataFrame, folder: str, first: int = FIRST, tile: int = A.TILE) -> SuffixIndex:
    """Rank all positions of ``contigs`` and write the index's tables into a new folder."""
    spark = contigs.sparkSession
    pieces = A.tiles(contigs, tile)
    spots = pieces.select("name", "tile", "piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(tile), F.length("piece")))).alias("at")).where("at <= length(piece)")
    keyed = spots.select(F.col("name").alias("contig"), (F.col("tile").cast("bigint") * tile + F.col("at") - 1).alias("position"), F.substr("piece", F.col("at"), F.lit(first)).alias("key"))
    # the last tile's overlap is empty, so its windows end with the contig as they should
    counted = _counted_before(keyed.groupBy("key").agg(F.count("*").alias("n")), ["key"], f"{folder}/sorted/{first}")
    counted.select("key", F.col("before").alias("rank"), "n").write.parquet(f"{folder}/names/{first}")
    now = keyed.join(spark.read.parquet(f"{folder}/names/{first}"), "key").select("contig", "position", "rank", "n", (F.col("n") > 1).alias("open"))
    now.write.parquet(f"{folder}/ranked/{first}")
    now = spark.read.parquet(f"{folder}/ranked/{first}")
    now.write.parquet(f"{folder}/now/{first}")
    levels = [first]
    while not (open_ := now.where("open")).isEmpty():
        level = levels[-1]
        behind = now.select("contig", (F.col("position") - level).alias("position"), F.col("rank").alias("next"))
        pairs = open_.drop("n", "open").join(behind, ["contig", "position"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("bigint")))
        counted = _counted_before(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")), ["rank", "next"], f"{folder}/sorted/{2 * level}")
        least = counted.groupBy("rank").agg(F.min("before").alias("least"))
        named = counted.join(least, "rank").select(F.col("rank").alias("head"), "next", (F.col("rank") + F.col("before") - F.col("least")).alias("rank"), "n")
        named.write.parquet(f"{folder}/names/{2 * level}")
        named = spark.read.parquet(f"{folder}/names/{2 * level}")
        again = pairs.withColumnRenamed("rank", "head").join(named, ["head", "next"]).select("contig", "position", "rank", "n", F.expr("n > 1 and next >= 0").alias("open"))
        again.write.parquet(f"{folder}/ranked/{2 * level}")
        now.where("not open").unionByName(spark.read.parquet(f"{folder}/ranked/{2 * level}")).write.parquet(f"{folder}/now/{2 * level}")
        now = spark.read.parquet(f"{folder}/now/{2 * level}")
        levels.append(2 * level)
    return SuffixIndex(folder, tuple(levels))


def _anchors(patterns: DataFrame, index: SuffixIndex) -> list[tuple[int, DataFrame]]:
    """(level, rows) with pattern, rank and n of the longest prefix of each pattern that a round could rank."""
    spark, first = patterns.sparkSession, index.levels[0]
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"length(pattern) div {first}") - 1), lambda i: F.substr("pattern", i * first + 1, F.lit(first)))
    blocks = patterns.where(F.length("pattern") >= first).select("pattern", F.posexplode(cut).alias("i", "key")).join(index.names(spark, first), "key")
    # a pattern without one of its blocks stands nowhere
    blocks = blocks.withColumn("found", F.count("*").over(Window.partitionBy("pattern"))).where(F.col("found") == F.expr(f"length(pattern) div {first}")).select("pattern", "i", "rank", "n")
    out = []
    for k, level in enumerate(index.levels):
        last = k + 1 == len(index.levels)
        ends = F.lit(True) if last else F.length("pattern") < 2 * level
        out.append((level, blocks.where((F.col("i") == 0) & ends).select("pattern", "rank", "n")))
        if last:
            break
        two = blocks.where(~ends).groupBy("pattern", F.expr("i div 2").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("rank"))).alias("head"), F.max(F.when(F.col("i") % 2 == 1, F.col("rank"))).alias("next"), F.max(F.when(F.col("i") % 2 == 0, F.col("n"))).alias("alone"))
        two = two.where("next is not null")
        named = index.names(spark, index.levels[k + 1])
        # a rank that only one position has stays; what follows it is compared in the end
        blocks = two.where("alone = 1").selectExpr("pattern", "i", "head rank", "alone n").unionByName(two.where("alone > 1").join(named, ["head", "next"]).select("pattern", "i", "rank", "n"))
    return out


def _short(patterns: DataFrame, index: SuffixIndex) -> DataFrame:
    """pattern, rank, n of the first round's names that begin with a pattern shorter than they are."""
    spark, first = patterns.sparkSession, index.levels[0]
    short = patterns.where(F.length("pattern").between(1, first - 1))
    names = index.names(spark, first)
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(first - 1), F.length("key"))), lambda i: F.substr("key", F.lit(1), i))
    return names.select("rank", "n", F.explode(heads).alias("pattern")).join(short, "pattern").select("pattern", "rank", "n")


def search(patterns: DataFrame, index: SuffixIndex, contigs: DataFrame, tile: int = A.TILE) -> DataFrame:
    """pattern, contig, position: every place of every pattern (a column ``pattern``; repeated, null and empty ones count once, not at all and not at all)."""
    spark, first = patterns.sparkSession, index.levels[0]
    asked = patterns.select("pattern").where("pattern <> ''").distinct()
    short = _short(asked, index).join(index.ranked(spark, first).select("contig", "position", "rank"), "rank").select("pattern", "contig", "position")
    near = None
    order = index.order(spark)
    for level, rows in _anchors(asked, index):
        alone = rows.where("n = 1").join(order, "rank")
        many = rows.where("n > 1").join(index.ranked(spark, level).select("contig", "position", "rank"), "rank")
        part = alone.select("pattern", "contig", "position").unionByName(many.select("pattern", "contig", "position"))
        near = part if near is None else near.unionByName(part)
    met = A.at_windows(near, contigs, "position", F.length("pattern"), tile).where("window = pattern")
    return short.unionByName(met.select("pattern", "contig", "position"))


def count(patterns: DataFrame, index: SuffixIndex, contigs: DataFrame, tile: int = A.TILE) -> DataFrame:
    """pattern, n: the number of places of every pattern, 0 without one. Short patterns are counted by names, not by places."""
    asked = patterns.select("pattern").where("pattern <> ''").distinct()
    short = F.length("pattern") < index.levels[0]
    few = _short(asked, index).groupBy("pattern").agg(F.sum("n").alias("n"))
    more = search(asked.where(~short), index, contigs, tile).groupBy("pattern").agg(F.count("*").alias("n"))
    return asked.join(few.unionByName(more), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
