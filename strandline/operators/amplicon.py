"""Amplicon operators: collapse, assign, demultiplex, trim, chimeras, pileup, calls, joint genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import genetics as G
from strandline.functions import kernels as KN
from strandline.functions import sequence as S
from strandline.schemas import CallParams, ChimeraParams, DemuxParams, LocalParams, TrimParams
from strandline.shared import shared_folder, small


# ---- collapse

def collapse_exact(reads: DataFrame, ids: bool = True) -> DataFrame:
    """One row for each distinct sequence: count, ids, best quality at each place and mean quality of the first read.

    Qualities merge from per-place maxima. Reads of another quality length than the first do not take part in that.
    Without ``ids`` no row lists its reads, so a sequence may have any number of them; ``members`` has them as rows.
    """
    listed = [F.sort_array(F.collect_list("read_id")).alias("read_ids")] if ids else []
    per = reads.groupBy("sequence").agg(F.count("*").alias("read_count"), F.min(F.struct("read_id", "quality")).alias("first"), *listed)
    firsts = per.select("sequence", F.length("first.quality").alias("n"))
    # places of a sequence aggregate apart from each other, so a frequent sequence is no single task's work
    fits = reads.select("sequence", "quality").distinct().join(firsts, "sequence").where(F.length("quality") == F.col("n"))
    places = fits.select("sequence", F.posexplode(F.split("quality", "")).alias("pos", "q")).groupBy("sequence", "pos").agg(F.max("q").alias("q"))
    merged = places.groupBy("sequence").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"]), "").alias("consensus_quality"))
    return per.join(merged, "sequence", "left").select(
        F.col("sequence").alias("consensus_sequence"), F.coalesce("consensus_quality", F.lit("")).alias("consensus_quality"), "read_count", *(["read_ids"] if ids else []), S.mean_quality("first.quality").alias("avg_quality"))


def members(reads: DataFrame) -> DataFrame:
    """read_id, consensus_sequence: the exact cluster of each read, as rows."""
    return reads.select("read_id", F.col("sequence").alias("consensus_sequence"))


#: A posting of more strings than this is split by another segment, at most so often, while segments keep so many places.
LONG, ROUNDS, LEAST = 64, 5, 4


def near_candidates(sequences: DataFrame, distance: int, long: int = LONG) -> DataFrame:
    """(a, b), a < b: pairs of distinct equal-length strings ``s`` that share a short posting, among them all within the distance.

    Strings that differ in at most d places agree on one of d + 1 segments, so candidates meet by equi-join. Where many
    strings share a segment, as reads of one amplicon share their primer, they agree on one of d + 1 segments of what is left too, and
    meet on both; and so on.
    """
    n = distance + 1
    at = lambda i: (F.length("rest") * i / n).cast("int")
    cut = lambda i: F.struct(F.concat("key", F.lit(f"{i}:"), F.substr("rest", at(i) + 1, at(i + 1) - at(i)), F.lit("|")).alias("key"), F.concat(F.substr("rest", F.lit(1), at(i)), F.substr("rest", at(i + 1) + 1, F.length("rest"))).alias("rest"))
    rows, out = sequences.select("s", F.length("s").alias("n"), F.lit("").alias("key"), F.col("s").alias("rest")), None
    for depth in range(ROUNDS):
        keyed = rows.select("s", "n", F.explode(F.array(*map(cut, range(n)))).alias("k")).select("s", "n", "k.key", "k.rest")
        shared = keyed.groupBy("n", "key").agg(F.count("*").alias("held")).where("held > 1")
        met = _cut(keyed.join(shared, ["n", "key"]))
        more = (F.col("held") > long) & (F.length("rest") >= n * LEAST) & F.lit(depth + 1 < ROUNDS)
        now = met.where(~more)
        pairs = now.selectExpr("n", "key", "s a").join(now.selectExpr("n", "key", "s b"), ["n", "key"]).where("a < b").select("a", "b")
        out = pairs if out is None else out.union(pairs)
        rows = met.where(more).select("s", "n", "key", "rest")
        if rows.isEmpty():
            break
    return out.distinct()


def near_pairs(sequences: DataFrame, distance: int, long: int = LONG) -> DataFrame:
    """(a, b), a < b: pairs of distinct equal-length strings ``s`` within a Hamming distance."""
    return near_candidates(sequences, distance, long).where(S.hamming("a", "b") <= distance)


def merge_similar(clusters: DataFrame, distance: int = 2) -> DataFrame:
    """Greedy star clustering in the order (read_count descending, sequence): each cluster absorbs the later ones within
    the Hamming distance that no earlier one took. Its consensus stays.

    Candidate pairs are found by equi-joins; the greedy order is resolved in rounds. In a round every cluster whose
    earlier neighbours are all absorbed becomes a centre and absorbs what is left of its later neighbours, so rounds
    follow the longest chain of neighbours and no component is gathered in one place.
    """
    base = clusters.select(F.col("consensus_sequence").alias("s"), "read_count")
    pairs = near_pairs(base.select("s"), distance)
    size = base.withColumnRenamed("read_count", "n")
    links = pairs.join(size.selectExpr("s a", "n na"), "a").join(size.selectExpr("s b", "n nb"), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    links = _cut(links.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(first, F.struct((-F.col("na")).alias("k"), F.col("a").alias("s"))).otherwise(F.struct((-F.col("nb")).alias("k"), F.col("b").alias("s"))).alias("rank")))
    open_links, taken = links, None
    while not open_links.isEmpty():
        # centres: no open link leads to them
        centres = open_links.select("u").distinct().join(open_links.selectExpr("v u").distinct(), "u", "left_anti")
        won = open_links.join(centres, "u").groupBy("v").agg(F.min("rank").alias("r")).selectExpr("v", "r.s centre")
        won = _cut(won)
        taken = won if taken is None else taken.union(won)
        gone = won.select("v").union(centres.selectExpr("u v"))
        # links of absorbed clusters and of finished centres end
        open_links = open_links.join(gone.selectExpr("v u"), "u", "left_anti").join(won.select("v"), "v", "left_anti")
        open_links = _cut(open_links)
    if taken is None:
        return clusters
    mapped = clusters.join(taken.selectExpr("v consensus_sequence", "centre"), "consensus_sequence", "left").withColumn("centre", F.coalesce("centre", "consensus_sequence"))
    ids = ["read_ids"] if "read_ids" in clusters.columns else []
    merged = mapped.groupBy("centre").agg(F.sum("read_count").alias("read_count"), *(F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ids))
    own = clusters.select(F.col("consensus_sequence").alias("centre"), "consensus_quality", "avg_quality")
    return merged.join(own, "centre").select(F.col("centre").alias("consensus_sequence"), "consensus_quality", "read_count", *ids, "avg_quality")


def _cut(df: DataFrame) -> DataFrame:
    """End the lineage of a loop's table: checkpoint() in the cluster's folder, or in one of the session's own where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def collapse_stats(reads: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: reads in, clusters out, their ratio and mean cluster size."""
    n = clusters.agg(F.coalesce(F.sum("read_count"), F.lit(0)).cast("bigint").alias("reads_in"), F.count("*").alias("clusters_out"))
    ratio = F.col("reads_in") / F.greatest(F.col("clusters_out"), F.lit(1))
    return n.select("reads_in", "clusters_out", ratio.alias("compression_ratio"), F.when(F.col("clusters_out") == 0, 0.0).otherwise(ratio).alias("avg_cluster_size"))


# ---- assignment

def assign(clusters: DataFrame, targets: DataFrame, tolerance: float = 0.2, mismatches: int = 2) -> DataFrame:
    """Clusters with ``amplicon_id``: exact primer prefix, else a primer anywhere on either strand, else the best length.

    Every stage is an equi-join, whatever the panel's size: on prefixes of the primers' lengths, on exact pieces of the
    primers (with so many mismatches one of ``mismatches`` + 1 pieces is exact), and on lengths within the tolerance.
    """
    panel = targets.withColumn("ord", F.monotonically_increasing_id()) if "ord" not in targets.columns else targets
    panel = panel.select("ord", "amplicon_id", "primer_fwd", "primer_rev", "expected_length")
    own = clusters.select("consensus_sequence").distinct()
    s = F.col("consensus_sequence")
    rank = lambda stage, far: F.struct(F.lit(stage).alias("stage"), far.alias("far"), F.col("ord")).alias("rank")
    primers = panel.select("ord", "amplicon_id", F.explode(F.array("primer_fwd", "primer_rev")).alias("p")).where("p is not null")

    lengths = [r[0] for r in primers.select(F.length("p")).distinct().collect()]  # of primers: a few
    heads = own.select(s, F.explode(F.array(*(F.substr(s, F.lit(1), F.lit(n)) for n in lengths))).alias("p")) if lengths else own.select(s, F.lit(None).cast("string").alias("p"))
    exact = heads.join(primers, "p").select(s, rank(1, F.lit(0.0)), "amplicon_id")

    n = mismatches + 1
    cut = lambda i: F.substr("p", (F.length("p") * i / n).cast("int") + 1, (F.length("p") * (i + 1) / n).cast("int") - (F.length("p") * i / n).cast("int"))
    pieces = primers.select("ord", "amplicon_id", "p", F.explode(F.array(*map(cut, range(n)))).alias("piece"))
    sizes = [r[0] for r in pieces.select(F.length("piece")).distinct().collect()]
    rest = own.join(exact.select("consensus_sequence").distinct(), "consensus_sequence", "left_anti")
    both = rest.select(s, F.explode(F.array(s, S.reverse_complement_keep_case(s))).alias("t"))
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - k + 1, F.lit(1))), lambda i: F.substr("t", i, F.lit(k)))
    spots = both.select(s, "t", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, sizes))))).alias("piece")) if sizes else both.select(s, "t", F.lit(None).cast("string").alias("piece"))
    maybe = spots.join(pieces, "piece").select(s, "t", "p", "ord", "amplicon_id").distinct()
    near = maybe.where(KN.contains_udf(mismatches)("t", "p")).select(s, rank(2, F.lit(0.0)), "amplicon_id")

    e = F.col("expected_length")
    fits = panel.where(e > 0).withColumn("n", F.explode(F.sequence(F.floor(e * (1 - tolerance)).cast("int"), F.ceil(e * (1 + tolerance)).cast("int"))))
    score = G.length_score(F.col("n"), e)
    fits = fits.where((F.abs(F.col("n") - e) <= tolerance * e) & (score > 0.8)).groupBy("n").agg(F.min_by(F.struct("ord", "amplicon_id"), F.struct(1 - score, F.col("ord"))).alias("b"), F.min(1 - score).alias("far"))
    sized = own.withColumn("n", F.length(s)).join(fits, "n").select(s, F.struct(F.lit(3).alias("stage"), F.col("far"), F.col("b.ord")).alias("rank"), "b.amplicon_id")

    best = exact.union(near).union(sized).groupBy("consensus_sequence").agg(F.min_by("amplicon_id", "rank").alias("amplicon_id"))
    return clusters.drop("amplicon_id").join(best, "consensus_sequence", "left")


def amplicon_counts(assigned: DataFrame) -> DataFrame:
    return assigned.where("amplicon_id is not null").groupBy("amplicon_id").agg(F.count("*").alias("n_clusters"), F.sum("read_count").alias("n_reads"))


def assignment_rate(assigned: DataFrame) -> DataFrame:
    out = assigned.agg(F.count("*").alias("clusters"), F.count("amplicon_id").alias("assigned_clusters"))
    return out.withColumn("assignment_rate", F.when(F.col("clusters") == 0, 0.0).otherwise(F.col("assigned_clusters") / F.col("clusters")))


# ---- demultiplexing

#: Barcodes and their complements up to this many are scanned together; more are joined.
MOST_CODES = 2000


def _barcode_hits(reads: DataFrame, barcodes: DataFrame, seq: str, params: DemuxParams) -> DataFrame:
    """Best barcode of each read: fewest mismatches on either strand; several equally good entries are ambiguous."""
    ends = barcodes.select("sample_id", F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col("barcode").alias("code")), F.struct(F.lit(1).alias("strand"), S.reverse_complement("barcode").alias("code")))).alias("e")).select("sample_id", "e.strand", "e.code")
    few = ends.orderBy("sample_id", "strand", "code").limit(MOST_CODES + 1).collect()
    if len(few) <= MOST_CODES:
        # a panel of checked size goes into one vectorised scan of each read's first bases
        found = reads.select("read_id", KN.barcode_udf([r["code"] or "" for r in few], params.max_mismatches, params.region)(F.col(seq)).alias("f")).where("f.which >= 0")
        of = lambda i: F.get(F.array(*(F.struct(F.lit(r["sample_id"]).alias("sample_id"), F.lit(r["strand"]).alias("strand"), F.lit(len(r["code"] or "")).alias("len")) for r in few)), i)
        return found.select("read_id", F.col("f.mm").alias("mismatches"), of(F.col("f.which")).alias("c"), F.col("f.pos").alias("pos"), F.col("f.ties").alias("ties")).select("read_id", "mismatches", "c.sample_id", "c.strand", "pos", "c.len", "ties") if few else reads.select("read_id").where("false").selectExpr("read_id", "0 mismatches", "'' sample_id", "0 strand", "0 pos", "0 len", "0 ties")
    met = reads.select("read_id", F.col(seq).alias("s")).join(ends).withColumn("f", S.find_barcode("s", "code", params.max_mismatches, params.region)).where("f is not null")
    best = met.groupBy("read_id").agg(F.min(F.struct(F.col("f.mm").alias("mm"), F.col("sample_id"), F.col("strand"), F.col("f.pos").alias("pos"), F.length("code").alias("len"))).alias("b"), F.sort_array(F.collect_list("f.mm")).alias("mms"))
    return best.select("read_id", F.col("b.mm").alias("mismatches"), "b.sample_id", "b.strand", "b.pos", "b.len", F.size(F.filter("mms", lambda x: x == F.get("mms", F.lit(0)))).alias("ties"))


def demultiplex(reads: DataFrame, barcodes: DataFrame, params: DemuxParams = DemuxParams(), seq: str = "sequence", qual: str = "quality") -> DataFrame:
    """Reads with status (assigned, unassigned, ambiguous, qc_failed), sample_id (NULL unless assigned), mismatches, and
    the bases after the barcode in ``trimmed``."""
    out = reads.join(_barcode_hits(reads, barcodes, seq, params), "read_id", "left")
    good = S.region_quality(qual, F.col("pos"), F.col("len")) >= params.min_quality
    status = F.when(F.col("ties").isNull(), "unassigned").when(F.col("ties") > 1, "ambiguous").when(~good, "qc_failed").otherwise("assigned")
    out = out.withColumn("status", status)
    ok = F.col("status") == "assigned"
    cut = F.when(ok, F.substr(F.col(seq), F.col("pos") + F.col("len") + 1, F.length(seq))).otherwise(F.col(seq))
    return out.withColumn("trimmed", cut).withColumn("sample_id", F.when(ok, F.col("sample_id"))).drop("ties", "strand", "len")


def demultiplex_dual(reads: DataFrame, i7: DataFrame, i5: DataFrame, params: DemuxParams = DemuxParams()) -> DataFrame:
    """Reads with ``sequence`` and ``sequence2``: the best entry of each index must name the same sample."""
    a = _barcode_hits(reads, i7, "sequence", params).selectExpr("read_id", "sample_id s7")
    b = _barcode_hits(reads, i5, "sequence2", params).selectExpr("read_id", "sample_id s5")
    out = reads.join(a, "read_id", "left").join(b, "read_id", "left")
    both = F.col("s7").isNotNull() & F.col("s5").isNotNull()
    status = F.when(both & (F.col("s7") == F.col("s5")), "assigned").when(both, "ambiguous").otherwise("unassigned")
    return out.withColumn("status", status).withColumn("sample_id", F.when(F.col("status") == "assigned", F.col("s7"))).drop("s7", "s5")


def demultiplex_either(reads: DataFrame, barcodes: DataFrame, params: DemuxParams = DemuxParams()) -> DataFrame:
    """Mates with one index: the first mate's answer, or else the second's."""
    one = demultiplex(reads, barcodes, params).select("read_id", F.col("sample_id").alias("s1"))
    two = demultiplex(reads, barcodes, params, "sequence2", "quality2").select("read_id", F.col("sample_id").alias("s2"))
    return reads.join(one, "read_id").join(two, "read_id").withColumn("sample_id", F.coalesce("s1", "s2")).drop("s1", "s2")


def demux_stats(rows: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = rows.agg(F.count("*").alias("total"), is_("assigned").alias("assigned"), is_("unassigned").alias("unassigned"), is_("ambiguous").alias("ambiguous"), is_("qc_failed").alias("qc_failed"))
    return out.withColumn("assignment_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("assigned") / F.col("total")))


def reads_per_bin(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("sample_id", F.lit("unassigned")).alias("bin")).agg(F.count("*").alias("n_reads"))


# ---- primers

#: Targets up to this number are scanned together for primers; more are joined.
MOST_PRIMERS = 2000


def _primer_cuts(reads: DataFrame, targets: DataFrame, params: TrimParams) -> DataFrame:
    """read_id, fwd, rev: where the best forward primer ends and the best reverse one begins, NULL without one."""
    panel = targets.withColumn("ord", F.monotonically_increasing_id()) if "ord" not in targets.columns else targets
    panel = panel.select("ord", "primer_fwd", S.reverse_complement("primer_rev").alias("rev"))
    few = panel.orderBy("ord").limit(MOST_PRIMERS + 1).collect()
    if len(few) <= MOST_PRIMERS:
        # a panel of checked size goes into one vectorised scan of the reads' ends
        found = reads.select("read_id", KN.primer_udf([(r["ord"], r["primer_fwd"] or "", r["rev"] or "") for r in few], params)(F.col("sequence")).alias("c"))
        return found.selectExpr("read_id", "nullif(c.fwd, -1) fwd", "nullif(c.rev, -1) rev")
    met = reads.select("read_id", "sequence").join(panel)
    fwd = S.find_primer("sequence", "primer_fwd", params.max_mismatches, params.min_overlap, 1)
    tail_at = F.greatest(F.length("sequence") - F.length("rev") - 10, F.lit(0))
    rev = S.find_primer(F.substr(F.col("sequence"), tail_at + 1, F.length("sequence")), "rev", params.max_mismatches, params.min_overlap, 11)
    met = met.withColumn("f", fwd).withColumn("r", rev).withColumn("tail_at", tail_at)
    best_f = F.min(F.when(F.col("f").isNotNull(), F.struct(F.col("f.mm").alias("mm"), F.col("ord"), F.length("primer_fwd").alias("cut")))).alias("bf")
    best_r = F.min(F.when(F.col("r").isNotNull(), F.struct(F.col("r.mm").alias("mm"), F.col("ord"), (F.col("tail_at") + F.col("r.pos")).alias("cut")))).alias("br")
    return met.groupBy("read_id").agg(best_f, best_r).selectExpr("read_id", "bf.cut fwd", "br.cut rev")


def trim_primers(reads: DataFrame, targets: DataFrame, params: TrimParams = TrimParams()) -> DataFrame:
    """Reads with the best target's forward primer cut from the start and reverse primer (its complement) from the end.

    Adds fwd_found, rev_found, bases_trimmed, and trimmed sequence and quality; overlapping cuts leave a read whole.
    """
    out = reads.join(_primer_cuts(reads, targets, params).selectExpr("read_id", "fwd cut_f", "rev cut_r"), "read_id", "left")
    start = F.coalesce(F.col("cut_f"), F.lit(0))
    end = F.coalesce(F.col("cut_r"), F.length("sequence"))
    ok = start < end
    out = out.withColumn("fwd_found", F.col("cut_f").isNotNull()).withColumn("rev_found", F.col("cut_r").isNotNull())
    for c in ("sequence", "quality"):
        out = out.withColumn(f"trimmed_{c}", F.when(ok, F.substr(F.col(c), start + 1, end - start)).otherwise(F.col(c)))
    return out.withColumn("bases_trimmed", F.length("sequence") - F.length("trimmed_sequence")).drop("cut_f", "cut_r")


def trim_stats(rows: DataFrame) -> DataFrame:
    f, r = F.col("fwd_found"), F.col("rev_found")
    return rows.agg(F.count("*").alias("total"), F.count_if(f).alias("fwd"), F.count_if(r).alias("rev"), F.count_if(f & r).alias("both"), F.count_if(~f & ~r).alias("neither"), F.coalesce(F.sum("bases_trimmed"), F.lit(0)).cast("bigint").alias("bases_trimmed"))


# ---- chimeras

def chimera_parents(clusters: DataFrame, params: ChimeraParams = ChimeraParams()) -> DataFrame:
    """The most abundant clusters, as (ord, sequence, abundance); a top-k, bounded by ``parents`` rows."""
    top = clusters.orderBy(F.desc("read_count"), "consensus_sequence").limit(params.parents)
    w = Window.orderBy(F.desc("read_count"), "consensus_sequence")
    return top.select(F.row_number().over(w).alias("ord"), F.col("consensus_sequence").alias("sequence"), F.col("read_count").alias("abundance"))


#: Parents or references up to this number and so many bases are scanned together; more are joined.
MOST_PARENTS, MOST_BASES = 10_000, 32 << 20


def _joins(queries: DataFrame, parents: DataFrame, params: ChimeraParams, references: bool) -> DataFrame | None:
    """id, distance, breakpoint of each query's best join of two parents; None for more parents than a scan may hold."""
    n, bases = parents.agg(F.count("*"), F.sum(F.length("sequence"))).first()
    if n > MOST_PARENTS or (bases or 0) > MOST_BASES:
        return None
    panel = [(r[0], r[1], r[2]) for r in parents.select("ord", "sequence", "abundance").collect()]
    best = KN.joins_udf(panel, params, references)("sequence", F.lit(0) if references else F.col("abundance"))
    return queries.select("id", best.alias("b")).select("id", "b.distance", "b.breakpoint")


def _sides(queries: DataFrame, parents: DataFrame, params: ChimeraParams) -> DataFrame:
    """id, bp, parent, abundance: distances of both sides of every breakpoint to every parent; NULL on the left where it ends before
    the breakpoint, and on the right where it ends before the query."""
    cut = queries.where(F.length("sequence") >= params.min_length).withColumn("bp", F.explode(F.sequence(F.lit(params.edge), F.length("sequence") - params.edge, F.lit(params.step))))
    met = cut.join(parents.selectExpr("ord parent", "sequence p", "abundance pa"))
    n = F.length("sequence")
    left = S.prefix_distance(F.substr("sequence", F.lit(1), F.col("bp")), F.substr("p", F.lit(1), F.col("bp")))
    right = S.prefix_distance(F.substr("sequence", F.col("bp") + 1, n), F.substr("p", F.col("bp") + 1, n - F.col("bp")))
    left, right = F.when(F.length("p") >= F.col("bp"), left), F.when(F.length("p") >= n, right)
    return met.select("id", "abundance", "bp", "parent", "pa", left.alias("dl"), right.alias("dr"))


def _verdict(queries: DataFrame, best: DataFrame, params: ChimeraParams) -> DataFrame:
    out = queries.select("id").join(best, "id", "left")
    return out.select("id", "distance", "breakpoint", F.coalesce(F.col("distance") < params.max_distance, F.lit(False)).alias("is_chimera"))


def chimera_de_novo(queries: DataFrame, parents: DataFrame, params: ChimeraParams = ChimeraParams()) -> DataFrame:
    """id, distance, breakpoint, is_chimera for queries (id, sequence, abundance): best left and right sides among
    parents at least twice as abundant, if there are two of them."""
    best = _joins(queries, parents, params, False)
    if best is None:
        sides = _sides(queries, parents, params).where(F.col("pa") >= params.abundance_ratio * F.col("abundance"))
        # two parents at least, of which each side takes one as long as the query
        per = sides.groupBy("id", "bp").agg((F.min(F.expr("if(dr is not null, dl, null)")) + F.min("dr")).alias("d"), F.count("*").alias("k")).where("k >= 2 and d is not null")
        best = per.groupBy("id").agg(F.min(F.struct("d", "bp")).alias("b")).selectExpr("id", "b.d distance", "b.bp breakpoint")
    return _verdict(queries, best, params)


def chimera_reference(queries: DataFrame, references: DataFrame, params: ChimeraParams = ChimeraParams()) -> DataFrame:
    """id, distance, breakpoint, is_chimera: left side from one reference and right side from another.

    The best pair of distinct references follows from the two best of each side, so no pairs are formed.
    """
    best = _joins(queries, references, params, True)
    if best is None:
        sides = _sides(queries.withColumn("abundance", F.lit(0)), references, params)
        two = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(c, "parent")))
        first = sides.groupBy("id", "bp").agg(two("dl").alias("l"), two("dr").alias("r"))
        # the best of each side without the best one's parent: aggregates again, no list of references is gathered
        more = sides.join(first, ["id", "bp"]).groupBy("id", "bp").agg(F.first("l").alias("l"), F.first("r").alias("r"), F.min(F.when((F.col("parent") != F.col("l.parent")) & F.col("dl").isNotNull(), F.struct("dl", "parent"))).alias("l2"), F.min(F.when((F.col("parent") != F.col("r.parent")) & F.col("dr").isNotNull(), F.struct("dr", "parent"))).alias("r2"))
        apart = [F.when(F.col(f"{x}.parent") != F.col(f"{y}.parent"), F.col(f"{x}.dl") + F.col(f"{y}.dr")) for x in ("l", "l2") for y in ("r", "r2")]
        per = more.select("id", "bp", F.array_min(F.array(*apart)).alias("d")).where("d is not null")
        best = per.groupBy("id").agg(F.min(F.struct("d", "bp")).alias("b")).selectExpr("id", "b.d distance", "b.bp breakpoint")
    return _verdict(queries, best, params)


def detect_chimeras(queries: DataFrame, parents: DataFrame, references: DataFrame | None = None, params: ChimeraParams = ChimeraParams()) -> DataFrame:
    """id, is_chimera, method, confidence: de novo first (0.95), then against references (0.90)."""
    out = chimera_de_novo(queries, parents, params).selectExpr("id", "is_chimera d")
    if references is not None:
        out = out.join(chimera_reference(queries, references, params).selectExpr("id", "is_chimera r"), "id")
    else:
        out = out.withColumn("r", F.lit(False))
    return out.selectExpr("id", "d or r is_chimera", "case when d then 'de_novo' when r then 'reference' end method", "case when d then 0.95D when r then 0.90D else 0D end confidence")


def filter_chimeras(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.where("is_chimera").select("id"), "id", "left_anti")


def chimera_stats(found: DataFrame) -> DataFrame:
    out = found.agg(F.count("*").alias("checked"), F.count_if("is_chimera").alias("found"), F.count_if(F.col("method") == "de_novo").alias("de_novo"), F.count_if(F.col("method") == "reference").alias("reference"))
    return out.withColumn("chimera_rate", F.when(F.col("checked") == 0, 0.0).otherwise(F.col("found") / F.col("checked")))


# ---- best target by alignment

def best_alignment(queries: DataFrame, targets: DataFrame, params: LocalParams = LocalParams(), max_results: int | None = None) -> DataFrame:
    """query_id, target_id, score of the best-scoring target of each query, first of equals; NULL without a positive score."""
    queries = queries if max_results is None else queries.orderBy("query_id").limit(max_results)
    met = queries.join(small(targets.selectExpr("target_id", "ord", "sequence target"), text="target"))
    scored = met.withColumn("sw", KN.local_udf(params)("sequence", "target"))
    best = scored.where("sw.score > 0").groupBy("query_id").agg(F.max_by(F.struct("target_id", "sw"), F.struct(F.col("sw.score"), -F.col("ord"))).alias("b"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "b.target_id", F.col("b.sw.score").alias("score"), F.col("b.sw.identity").alias("identity"), F.col("b.sw.cigar").alias("cigar"))


# ---- pileup and calls

def pileup(alignments: DataFrame, markers: DataFrame, bin_size: int = 512) -> DataFrame:
    """Base counts at markers (chromosome, position, ref_base) from alignments (chromosome, start, sequence, quality,
    read_count), weighted by read_count. A bin key turns the interval join into an equi-join."""
    span = alignments.withColumn("stop", F.col("start") + F.length("sequence") - 1)
    span = span.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {bin_size}"), F.expr(f"stop div {bin_size}"))))
    keyed = markers.withColumn("bin", F.expr(f"position div {bin_size}"))
    met = span.join(keyed, ["chromosome", "bin"]).where("position between start and stop")
    place = (F.col("position") - F.col("start") + 1).cast("int")
    met = met.select("chromosome", "position", "ref_base", "read_count", F.upper(F.substr("sequence", place, F.lit(1))).alias("b"), (F.ascii(F.substr("quality", place, F.lit(1))) - 33).alias("q"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("read_count"))), F.lit(0)).cast("bigint")
    counts = [n(F.col("b") == x).alias(x) for x in "ACGT"]
    out = met.groupBy("chromosome", "position", "ref_base").agg(*counts, F.sum("read_count").cast("bigint").alias("depth"), n(F.col("b") == F.col("ref_base")).alias("ref_count"), F.sum(F.col("q") * F.col("read_count")).cast("bigint").alias("quality_sum"))
    return with_alternative(out)


PILE = ["A", "C", "G", "T", "depth", "ref_count", "quality_sum"]


def with_alternative(piles: DataFrame) -> DataFrame:
    """Piles with the most frequent base that is not the reference; ties go to the earlier letter."""
    choice = F.array_max(F.array(*(F.when((F.col(x) > 0) & (F.col("ref_base") != x), F.struct(F.col(x).alias("n"), F.lit(-i).alias("o"), F.lit(x).alias("b"))) for i, x in enumerate("ACGT"))))
    out = piles.withColumn("top", choice).withColumn("alt_base", F.coalesce("top.b", F.lit("N"))).withColumn("alt_count", F.coalesce("top.n", F.lit(0).cast("bigint")))
    return out.withColumn("other_count", F.col("depth") - F.col("ref_count") - F.col("alt_count")).drop("top")


def merge_piles(piles: DataFrame) -> DataFrame:
    """One pile a marker of the piles of several batches: counts add up."""
    return with_alternative(piles.groupBy("chromosome", "position", "ref_base").agg(*(F.sum(c).alias(c) for c in PILE)))


def call_variants(piles: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Positions with enough depth and allele frequency, with genotype and quality; quality runs on these rows only."""
    out = piles.withColumn("allele_frequency", G.allele_frequency("alt_count", "depth"))
    out = out.where((F.col("depth") >= params.min_depth) & (F.col("allele_frequency") >= params.min_allele_frequency) & (F.col("alt_base") != "N") & (F.col("alt_base") != F.col("ref_base")))
    return out.withColumn("genotype", G.genotype("allele_frequency")).withColumn("qual", G.variant_quality("alt_count", "depth"))


def annotate_variants(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls with the amplicon whose marker they are and ``known``; of targets that share a marker the last wins."""
    panel = targets.withColumn("ord", F.monotonically_increasing_id()) if "ord" not in targets.columns else targets
    marks = panel.select("ord", "amplicon_id", "chromosome", F.explode("snp_positions").alias("position")).groupBy("chromosome", "position").agg(F.max_by("amplicon_id", "ord").alias("amplicon_id"))
    return calls.join(marks, ["chromosome", "position"], "left").withColumn("known", F.col("amplicon_id").isNotNull())


def amplicon_stats(coverage: DataFrame, calls: DataFrame) -> DataFrame:
    """Per amplicon: mean, least and greatest depth, uniformity (deviation over mean) and variants called."""
    per = coverage.groupBy("amplicon_id").agg(F.avg("depth").alias("mean_depth"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.stddev_pop("depth").alias("sd"))
    n = calls.where("amplicon_id is not null").groupBy("amplicon_id").agg(F.count("*").alias("variants_called"))
    return per.join(n, "amplicon_id", "left").select("amplicon_id", "mean_depth", "min_depth", "max_depth", F.when(F.col("mean_depth") == 0, 0.0).otherwise(F.col("sd") / F.col("mean_depth")).alias("uniformity"), F.coalesce("variants_called", F.lit(0).cast("bigint")).alias("variants_called"))


# ---- several samples

def joint_genotypes(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """Every (chromosome, position) of any sample, with each sample's genotype there or a missing one.

    ref and alt are those of the first sample by id that has the position.
    """
    sites = variants.groupBy("chromosome", "position").agg(F.min(F.struct("sample_id", "ref_allele", "alt_allele", F.coalesce("amplicon_id", F.lit("")).alias("amplicon_id"))).alias("s"))
    sites = sites.select("chromosome", "position", "s.ref_allele", "s.alt_allele", "s.amplicon_id")
    grid = sites.join(small(samples.select("sample_id")))  # the result has every site of every sample
    own = variants.groupBy("chromosome", "position", "sample_id").agg(F.min(F.struct("allele_frequency", "total_depth")).alias("v"))
    out = grid.join(own, ["chromosome", "position", "sample_id"], "left")
    gt = F.when(F.col("v").isNull(), "./.").otherwise(G.genotype("v.allele_frequency"))
    alt = F.round(F.col("v.allele_frequency") * F.col("v.total_depth")).cast("bigint")
    return out.select("chromosome", "position", "ref_allele", "alt_allele", "amplicon_id", "sample_id", gt.alias("genotype"), F.coalesce("v.total_depth", F.lit(0).cast("bigint")).alias("depth"), F.coalesce(alt, F.lit(0).cast("bigint")).alias("alt_depth"), F.coalesce("v.allele_frequency", F.lit(0.0)).alias("allele_frequency"))


def allele_counts(genotypes: DataFrame) -> DataFrame:
    """AC, AN, AF and DP over the samples of each position; missing genotypes add no alleles."""
    g = F.col("genotype")
    out = genotypes.groupBy("chromosome", "position").agg(
        F.sum(F.when(g.isin("0/1", "1/0"), 1).when(g == "1/1", 2).otherwise(0)).alias("ac"), F.sum(F.when(g.isin("0/0", "0/1", "1/0", "1/1"), 2).otherwise(0)).alias("an"), F.sum("depth").alias("dp"))
    return out.withColumn("af", F.when(F.col("an") == 0, 0.0).otherwise(F.col("ac") / F.col("an")))


def genotype_stats(genotypes: DataFrame) -> DataFrame:
    """Genotypes, missing ones and variant ones of each sample."""
    g = F.col("genotype")
    return genotypes.groupBy("sample_id").agg(F.count("*").alias("genotypes"), F.count_if(g == "./.").alias("missing"), F.count_if(g.isin("0/1", "1/0", "1/1")).alias("variants"))


def panel_stats(clusters: DataFrame, assigned: DataFrame, placed: DataFrame, calls: DataFrame) -> DataFrame:
    """One row with the eight statistics of a panel run: reads, clusters and their ratio, clusters assigned of all, clusters
    aligned (placed at their target) of the assigned, and variants. Rates are 0 without rows to share."""
    n = clusters.agg(F.coalesce(F.sum("read_count"), F.lit(0)).cast("bigint").alias("total_reads"), F.count("*").alias("collapsed_clusters"))
    one = [assigned.agg(F.count("amplicon_id").alias("assigned_clusters")), placed.agg(F.count("*").alias("aligned_clusters")), calls.agg(F.count("*").alias("variants_called"))]
    for x in one:
        n = n.join(x)  # one row each
    share = lambda a, b: f"if({b} = 0, 0D, {a} / {b})"
    return n.selectExpr("total_reads", "collapsed_clusters", f"{share('total_reads', 'collapsed_clusters')} collapse_ratio", "assigned_clusters", f"{share('assigned_clusters', 'collapsed_clusters')} assignment_rate", "aligned_clusters", f"{share('aligned_clusters', 'assigned_clusters')} alignment_rate", "variants_called")


def has_coverage(coverage: DataFrame, least: int = 1000) -> DataFrame:
    """One row: whether every amplicon has the depth; false without amplicons."""
    return coverage.agg(F.coalesce(F.bool_and(F.col("depth") >= least), F.lit(False)).alias("sufficient"), F.coalesce(F.min("depth"), F.lit(0).cast("bigint")).alias("least"), F.coalesce(F.max("depth"), F.lit(0).cast("bigint")).alias("most"))


# ---- work split

def even_split(total: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of contiguous parts; the first ones take one more."""
    size, rest = divmod(total, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i < rest)
        out.append((at, n))
        at += n
    return out


def weighted_split(total: int, weights: list[float]) -> list[tuple[int, int]]:
    """(start, size) of contiguous parts by weight; the last takes the remainder."""
    whole, out, at = sum(weights), [], 0
    for i, w in enumerate(weights):
        n = total - at if i == len(weights) - 1 else int(total * w / whole)
        out.append((at, n))
        at += n
    return out


#: Ids of a FASTQ input are the file's place times this, and the ordinal in the file.
FILE_IDS = 1 << 40


def chunks(reads: DataFrame, n: int) -> DataFrame:
    """Reads with the number of their contiguous chunk of ceil(total / n) reads, over all files in order.

    Ids are dense from 0 in each file; the reads before a file are counted by file, so no table is sorted.
    """
    file = F.expr(f"read_id div {FILE_IDS}")
    per = reads.groupBy(file.alias("file")).agg(F.count("*").alias("k"))
    base = per.select("file", F.coalesce(F.sum("k").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = per.agg(F.sum("k")).first()[0] or 0
    size = max(1, -(-total // n))
    out = reads.withColumn("file", file).join(small(base), "file")
    return out.withColumn("chunk", F.expr(f"cast((base + read_id % {FILE_IDS}) div {size} as int)")).drop("file", "base")
