"""Seeding, chaining, alignment and the filters, statistics and order of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import genetics as G
from strandline.functions import kernels as KN
from strandline.functions import sequence as S
from strandline.schemas import DUPLICATE, PAIRED, PROPER, READ1, READ2, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED, BandedParams, FilterParams, SeedParams
from strandline.shared import scratch_folder, small


#: Bases of a tile of the reference. Windows up to this length lie in one tile and its overlap.
TILE = 1 << 16


def contig_starts(contigs: DataFrame) -> DataFrame:
    """name, ordinal, length, start: the one window over all rows holds lengths, not sequences."""
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    if "tile" in contigs.columns:
        rows = contigs.where("tile = 0").select("name", "ordinal", "length")
    else:
        rows = contigs.select("name", "ordinal", F.length("sequence").cast("bigint").alias("length"))
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")))


def contig_offsets(contigs: DataFrame) -> DataFrame:
    """Contigs with ``length`` and ``start``, their place in the reference that joins them in order."""
    if "tile" in contigs.columns:
        return contig_starts(contigs)
    return contigs.join(contig_starts(contigs), ["name", "ordinal"])


def tiles(contigs: DataFrame, size: int = TILE) -> DataFrame:
    """name, tile, piece: the bases of a contig from tile * size on, ``size`` of them and the next tile's.

    Seeds, windows and searches join on (name, tile), so a read carries two tiles at most and never a chromosome. ``contigs`` may be
    tiles already, as ``read_fasta_tiles`` gives them; they must be of this size.
    """
    if "tile" in contigs.columns:
        piece = F.when(F.col("tile_size") == size, F.col("piece")).otherwise(F.raise_error(F.lit(f"the reference has tiles of another size than {size}")))
        return contigs.select("name", "tile", piece.alias("piece"))
    cut = contigs.select("name", F.regexp_extract_all("sequence", F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1)).alias("cut"))
    both = F.transform("cut", lambda p, i: F.concat(p, F.coalesce(F.get("cut", i + 1), F.lit(""))))
    return cut.select("name", F.posexplode(both).alias("tile", "piece"))


def at_windows(rows: DataFrame, contigs: DataFrame, start: str, length, size: int) -> DataFrame:
    """``rows`` (contig, ...) with ``window``: the bases from their ``start`` on. Longer windows than a tile are an error."""
    at = rows.withColumn("tile", F.expr(f"cast(`{start}` div {size} as int)"))
    met = at.join(tiles(contigs, size).withColumnRenamed("name", "contig"), ["contig", "tile"])
    part = F.substr("piece", (F.col(start) - F.col("tile") * size + 1).cast("int"), length)
    return met.withColumn("window", F.when(length <= size, part).otherwise(F.raise_error(F.lit("a window is longer than a tile")))).drop("piece", "tile")


def kmer_index(contigs: DataFrame, params: SeedParams = SeedParams(), tile: int = TILE) -> DataFrame:
    """kmer, contig, position, gpos, hits: all k-mers of every contig with at most ``max_hits`` places.

    Repetitive k-mers leave the index, so they cannot skew the seed join. Windows do not span contigs. No row holds more
    than a tile's k-mers.
    """
    part = tiles(contigs, tile).withColumn("part", F.substr("piece", F.lit(1), F.lit(tile + params.k - 1))).select("name", "tile", "part")
    found = part.select("name", "tile", F.explode(S.kmers("part", params.k, 1, params.letters)).alias("m")).select("name", F.col("m.kmer").alias("kmer"), (F.col("tile").cast("bigint") * tile + F.col("m.offset")).alias("position"))
    placed = found.join(contig_starts(contigs).select("name", "start"), "name").select("kmer", F.col("name").alias("contig"), "position", (F.col("start") + F.col("position")).alias("gpos"))
    hits = placed.groupBy("kmer").agg(F.count("*").alias("hits")).where(f"hits <= {params.max_hits}")
    return placed.join(hits, "kmer")


def save_index(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Persist an index bucketed by k-mer, so that seed joins read it without a shuffle."""
    index.write.bucketBy(buckets, "kmer").sortBy("kmer").mode("overwrite").saveAsTable(table)


def count_kmer(index: DataFrame, kmers: DataFrame) -> DataFrame:
    """kmer, n: places of each asked k-mer, 0 if there is none."""
    found = index.groupBy("kmer").agg(F.count("*").alias("n"))
    return kmers.select("kmer").distinct().join(found, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def search_kmer(index: DataFrame, kmers: DataFrame, max_results: int = 1024) -> DataFrame:
    """kmer, gpos: up to ``max_results`` places of each asked k-mer, lowest first."""
    w = Window.partitionBy("kmer").orderBy("gpos")
    return index.join(kmers.select("kmer").distinct(), "kmer").withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_results).select("kmer", "gpos")


def seeds(reads: DataFrame, index: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """read_id, read_offset, contig, position, gpos, ord: hits of the reads' k-mers, at most ``max_seeds`` a read."""
    asked = reads.select("read_id", F.explode(S.kmers("sequence", params.k, params.stride, params.letters)).alias("m")).select("read_id", F.col("m.offset").alias("read_offset"), F.col("m.kmer").alias("kmer"))
    met = asked.join(index.select("kmer", "contig", "position", "gpos"), "kmer")
    w = Window.partitionBy("read_id").orderBy("read_offset", "gpos")
    return met.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= params.max_seeds).select("read_id", "read_offset", "contig", "position", "gpos", "ord")


def seed_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("read_id").agg(F.count("*").alias("n_seeds"))


def chain(found: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """Best-supported seed of each read: its length plus 0.4 of each earlier seed's that is collinear within 100 bases.

    A read has at most ``max_seeds`` seeds, so its seeds fit in one array: one aggregate and no self-join.
    """
    own = found.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("ord", "read_offset", "gpos", "contig", "position"))).alias("z"))

    def support(x):
        def adds(y):
            by, ry = x["gpos"] - y["gpos"], x["read_offset"] - y["read_offset"]
            return (y["ord"] < x["ord"]) & (by > 0) & (ry > 0) & (F.abs(by - ry) < 100)

        n = F.size(F.filter("z", adds))
        return F.struct((n * 4 * params.k + 10 * params.k).alias("tenths"), (-x["ord"]).alias("neg"), x["read_offset"].alias("read_offset"), x["contig"].alias("contig"), x["position"].alias("position"), x["gpos"].alias("gpos"))

    best = own.select("read_id", F.array_max(F.transform("z", support)).alias("b"), F.size("z").alias("n_seeds"))
    return best.select("read_id", "n_seeds", (F.col("b.tenths") / 10).alias("chain_score"), "b.read_offset", "b.contig", "b.position", "b.gpos")


def place_ungapped(reads: DataFrame, chained: DataFrame, contigs: DataFrame, tile: int = TILE) -> DataFrame:
    """Reads at their seed's diagonal without gaps: start in the contig, mismatches, score (match 1, mismatch -4) and MAPQ.

    Tiles are joined after the one seed a read keeps, and only the read's window is carried on.
    """
    at = chained.withColumn("start", F.greatest(F.lit(0).cast("bigint"), F.col("position") - F.col("read_offset")))
    out = at_windows(reads.join(at, "read_id"), contigs, "start", F.length("sequence"), tile)
    out = out.withColumn("mismatches", S.prefix_distance("sequence", "window"))
    score = F.length("sequence") - 5 * F.col("mismatches")
    return out.withColumn("score", F.greatest(F.lit(0), score).cast("int")).withColumn("mapq", G.mapping_quality("score"))


def place_banded(reads: DataFrame, chained: DataFrame, contigs: DataFrame, params: BandedParams = BandedParams(), tile: int = TILE, trace: bool = False) -> DataFrame:
    """Banded local alignment of each read around its seed's diagonal: score, start in the contig and MAPQ.

    With ``trace`` also the alignment: ``cigar``, ``edits`` and the read's aligned bases (read_start, read_end), and ``start`` is
    where the first aligned base lies; without it, it is the best cell's diagonal.
    """
    at = chained.withColumn("from", F.greatest(F.lit(0).cast("bigint"), F.col("position") - F.col("read_offset") - params.flank))
    read = S.truncate("sequence", params.max_length)
    out = at_windows(reads.join(at, "read_id"), contigs, "from", F.length(read) + 2 * params.flank, tile)
    diagonal = F.col("position") - F.col("read_offset") - F.col("from")
    kernel = KN.banded_traces_udf(params) if trace else KN.banded_udf(params)
    out = out.withColumn("sw", kernel(F.col("sequence") if trace else read, F.col("window"), diagonal))
    more = ["sw.cigar", "sw.edits", "sw.read_start", "sw.read_end"] if trace else []
    start = F.col("sw.window_start") if trace else F.col("sw.start")
    out = out.select("*", F.col("sw.score").alias("score"), (F.col("from") + start).alias("start"), *more).drop("sw", "window", "from")
    return out.withColumn("mapq", G.mapping_quality("score"))


def place_each_once(reads: DataFrame, contigs: DataFrame, place=place_ungapped, params: SeedParams = SeedParams(), index: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``reads`` with the columns of ``place(texts, chained, contigs)``, where every different sequence is seeded, chained and placed once.

    Seeds, windows and alignments depend on the sequence alone, so reads of one sequence share them: what is exploded and shuffled
    grows with the different sequences, and the reads take one pass and one join, with a broadcast while the sequences are few. They and
    their places are written to the shared folder. Ids of reads must be unique; with ``how`` left, reads without a place (and those
    without an id) stay with nulls.
    """
    spark = reads.sparkSession
    folder = scratch_folder(spark, "sequences")
    reads.where("read_id is not null and sequence is not null").select("sequence").distinct().withColumn("read_id", F.monotonically_increasing_id()).write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    found = seeds(texts, kmer_index(contigs, params) if index is None else index, params)
    place(texts, chain(found, params), contigs).drop("read_id").withColumnRenamed("sequence", "text").write.parquet(f"{folder}/placed")
    placed = small(spark.read.parquet(f"{folder}/placed"), text="text")
    return reads.join(placed, (F.col("sequence") == F.col("text")) & F.col("read_id").isNotNull(), how).drop("text")


def locate(positions: DataFrame, contigs: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """Contig and offset of global positions ``gpos``; unmatched ones are NULL. An equi-join on bins, not a range scan."""
    spans = contig_starts(contigs).select(F.col("name").alias("contig"), F.col("start").alias("c_start"), "length")
    spans = spans.withColumn("bin", F.explode(F.sequence(F.expr(f"c_start div {bin_size}"), F.expr(f"(c_start + length - 1) div {bin_size}"))))
    hit = (positions["bin"] == spans["bin"]) & (F.col("gpos") >= F.col("c_start")) & (F.col("gpos") < F.col("c_start") + F.col("length")) if "bin" in positions.columns else None
    if hit is None:
        positions = positions.withColumn("bin", F.expr(f"gpos div {bin_size}"))
        hit = (positions["bin"] == spans["bin"]) & (F.col("gpos") >= F.col("c_start")) & (F.col("gpos") < F.col("c_start") + F.col("length"))
    return positions.join(spans, hit, "left").drop("bin", "length").withColumn("offset", F.col("gpos") - F.col("c_start")).drop("c_start")


def subsequence(contigs: DataFrame, start: int, length: int, tile: int = TILE) -> DataFrame:
    """One row: bases of the joined reference from a global start, clamped at its end. Only tiles in reach are read."""
    own = tiles(contigs, tile).join(contig_starts(contigs).select("name", F.col("start").alias("c_start")), "name")
    own = own.withColumn("at", F.col("c_start") + F.col("tile").cast("bigint") * tile).withColumn("bases", F.substr("piece", F.lit(1), F.lit(tile)))
    reach = own.where((F.col("at") < start + length) & (F.col("at") + F.length("bases") > start))
    part = F.substr("bases", (F.greatest(F.lit(start) - F.col("at"), F.lit(0)) + 1).cast("int"), (F.lit(start + length) - F.greatest(F.lit(start), F.col("at"))).cast("int"))
    return reach.select("at", part.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("sequence"))


def contains_exactly(reads: DataFrame, contigs: DataFrame, anchor: int = 16, tile: int = TILE) -> DataFrame:
    """read_id, contig, position of the first contig (by name) that contains the read; MAPQ 60. Reads without one are left out.

    Candidates come from an equi-join on the read's first bases, and only they meet the reference again, by tile.
    """
    cut = tiles(contigs, tile)
    places = F.sequence(F.lit(1), F.greatest(F.least(F.lit(tile), F.length("piece") - anchor + 1), F.lit(1)))
    spots = cut.select("name", "tile", "piece", F.explode(places).alias("at")).select("name", (F.col("tile").cast("bigint") * tile + F.col("at") - 1).alias("position"), F.substr("piece", F.col("at"), F.lit(anchor)).alias("key"))
    asked = reads.where(F.length("sequence") >= anchor).select("read_id", F.col("sequence").alias("read"), F.substr("sequence", F.lit(1), F.lit(anchor)).alias("key"))
    near = asked.join(spots, "key").withColumnRenamed("name", "contig").drop("key")
    near = at_windows(near, contigs, "position", F.length("read"), tile).where("window = read")
    best = near.groupBy("read_id").agg(F.min(F.struct("contig", "position")).alias("b"))
    return best.select("read_id", "b.contig", "b.position", F.lit(60).alias("mapq"))


def passes(params: FilterParams = FilterParams()) -> Column:
    """Predicate of the quality filter over mapq, score and flag. Scores compare as signed numbers."""
    ok = (F.col("mapq") >= params.min_mapq) & (F.col("score") >= params.min_score)
    if params.filter_secondary:
        ok = ok & (F.col("flag").bitwiseAND(SECONDARY) == 0)
    if params.filter_supplementary:
        ok = ok & (F.col("flag").bitwiseAND(SUPPLEMENTARY) == 0)
    return ok


def filter_by_quality(rows: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    return rows.where(passes(params))


def count_passing(rows: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    return rows.agg(F.count_if(passes(params)).alias("n_passing"))


def compact(rows: DataFrame) -> DataFrame:
    """Rows with a score that are not duplicates."""
    return rows.where((F.col("score") != 0) & (F.col("flag").bitwiseAND(DUPLICATE) == 0))


def mapped(rows: DataFrame) -> DataFrame:
    return rows.where("score > 0")


def statistics(rows: DataFrame) -> DataFrame:
    secondary = F.col("flag").bitwiseAND(SECONDARY) != 0
    return rows.agg(
        F.count("*").alias("total"), F.count_if(~secondary).alias("primary_n"), F.count_if(secondary).alias("secondary_n"), F.count_if(F.col("flag").bitwiseAND(DUPLICATE) != 0).alias("duplicates"),
        F.coalesce(F.avg("mapq"), F.lit(0.0)).alias("mean_mapq"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
    )


def run_metrics(rows: DataFrame) -> DataFrame:
    """Reads, aligned reads, mean MAPQ of the aligned and the share aligned."""
    out = rows.agg(F.count("*").alias("total_reads"), F.count_if(F.col("score") > 0).alias("aligned_reads"), F.avg(F.when(F.col("score") > 0, F.col("mapq"))).alias("m"))
    return out.select("total_reads", "aligned_reads", F.coalesce("m", F.lit(0.0)).alias("mean_mapq"), F.when(F.col("total_reads") == 0, 0.0).otherwise(F.col("aligned_reads") / F.col("total_reads")).alias("alignment_rate"))


def reads_per_contig(rows: DataFrame) -> DataFrame:
    return mapped(rows).groupBy("contig").agg(F.count("*").alias("n_reads"))


def mark_duplicates(rows: DataFrame, by: str = "read") -> DataFrame:
    """Set the duplicate flag.

    ``read``: a row is a duplicate if the row before it by (position, read) has the same position and
    read and a strictly higher MAPQ. ``position``: every row but the best of its position, which is found by an
    aggregate, so that a position of very many reads is no single task's window.
    """
    if by == "read":
        w = Window.partitionBy("gpos", "read_id").orderBy(F.desc("mapq"), "ord")
        dup = F.lag("mapq").over(w) > F.col("mapq")
    else:
        own = F.struct((-F.col("mapq")).alias("m"), "read_id", "ord")
        rows = rows.join(rows.groupBy("gpos").agg(F.min(own).alias("best")), "gpos")
        dup = own != F.col("best")
    return rows.withColumn("flag", F.when(dup, F.col("flag").bitwiseOR(DUPLICATE)).otherwise(F.col("flag"))).drop("best")


def coordinate_sort(rows: DataFrame) -> DataFrame:
    return rows.orderBy("gpos", "read_id")


def validate_pairs(rows: DataFrame, least: int = 100, most: int = 1000) -> DataFrame:
    """Mates (pair_id, mate 1 and 2, gpos, score, flag) with the proper-pair flag on both where their distance fits.

    One window over the pair instead of a self-join.
    """
    pair = Window.partitionBy("pair_id")
    first, second = (F.max(F.when(F.col("mate") == m, F.col("gpos"))).over(pair) for m in (1, 2))
    both = F.min("score").over(pair) > 0
    apart = F.abs(first - second)
    proper = (F.count("*").over(pair) == 2) & both & apart.between(least, most)
    return rows.withColumn("insert_size", apart).withColumn("proper", F.coalesce(proper, F.lit(False))).withColumn("flag", F.when(F.col("proper"), F.col("flag").bitwiseOR(PROPER)).otherwise(F.col("flag")))


def sam_rows(reads: DataFrame, aligned: DataFrame) -> DataFrame:
    """The eleven SAM columns and the score of every read; reads without alignment are unmapped.

    Where ``aligned`` has a column ``strand``, a read of strand 1 is written as its reverse complement with the flag for it. Where it has
    ``cigar``, that is the alignment's; else the whole read counts as aligned without gaps.
    """
    strand = F.col("strand") if "strand" in aligned.columns else F.lit(0)
    cols = aligned.select("read_id", "contig", "start", "mapq", "score", strand.cast("int").alias("strand"), *(["cigar"] if "cigar" in aligned.columns else []))
    return sam_of(reads.join(cols, "read_id", "left"))


def sam_of(out: DataFrame) -> DataFrame:
    """The rows of ``sam_rows`` of reads that carry their alignment, or nulls."""
    traced = "cigar" in out.columns
    turned = F.col("strand") == 1 if "strand" in out.columns else F.lit(False)
    hit = F.coalesce(F.col("score") > 0, F.lit(False))
    back = hit & turned
    mate = F.col("mate") if "mate" in out.columns else F.lit(None).cast("int")
    paired = F.when(mate == 1, PAIRED | READ1).when(mate == 2, PAIRED | READ2).otherwise(0)
    name = F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.concat(F.lit("read_"), F.col("read_id"))).otherwise(F.col("name"))
    return out.select(
        "read_id", name.alias("qname"), F.when(back, paired.bitwiseOR(REVERSE)).when(hit, paired).otherwise(paired.bitwiseOR(UNMAPPED)).alias("flag"), F.when(hit, F.col("contig")).otherwise("*").alias("rname"),
        F.when(hit, F.col("start") + 1).otherwise(0).cast("bigint").alias("pos"), F.when(hit, F.col("mapq")).otherwise(0).alias("mapq"),
        F.when(hit, F.col("cigar") if traced else F.concat(F.length("sequence"), F.lit("M"))).otherwise("*").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        F.when(back, S.reverse_complement("sequence")).otherwise(F.col("sequence")).alias("seq"), F.when(back, F.reverse("quality")).otherwise(F.col("quality")).alias("qual"), F.when(hit, F.col("score")).otherwise(0).alias("score"),
    )


def pair_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two read tables, paired by ordinal, as rows with pair_id and mate; ends with the shorter."""
    both = first.select("read_id").join(second.select("read_id"), "read_id").withColumnRenamed("read_id", "pair_id")
    tag = lambda t, m: t.join(both, t["read_id"] == both["pair_id"], "left_semi").withColumn("pair_id", F.col("read_id")).withColumn("mate", F.lit(m)).withColumn("read_id", 2 * F.col("read_id") + m - 1)
    return tag(first, 1).unionByName(tag(second, 2))


def interleave(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("pair_id", "mate")
