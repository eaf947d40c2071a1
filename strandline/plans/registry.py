"""Queries of the sequencing operators over data derived from the driver tables, and their DuckDB SQL.

The SQL is written on its own from the definitions, not generated from the plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import genetics as G
from strandline.functions import sequence as S
from strandline.operators import align as A
from strandline.operators import amplicon as M
from strandline.plans import fixtures as X
from strandline.schemas import BandedParams, CallParams, ChimeraParams, DemuxParams, FilterParams, TrimParams
from strandline.shared import scratch_folder
from strandline.sources import sinks

CALL = CallParams(min_depth=10, min_allele_frequency=0.01)

_queries: dict = {}
_oracles: dict[str, str] = {}
_slow: dict[str, str] = {}


def _counts(sql: str) -> str:
    """DuckDB's count_if is a 128-bit number; the queries count in 64 bits."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += f"{sql[at:i]}({sql[i:j]})::BIGINT"
        at = j
    return out + sql[at:]


def query(sql: str | None = None, recursive: bool = False, slow: bool = False):
    """Register a query. ``slow`` SQL is for small tables only: tests use it, ``oracle_sql`` does not give it."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            (_slow if slow else _oracles)[f.__name__] = f"{'WITH RECURSIVE' if recursive else 'WITH'} {X.CTE}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{_counts(sql)}"
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def small_sql() -> dict[str, str]:
    """SQL of queries for which it takes too long on whole tables of any size."""
    return dict(_slow)


# ---- sources, index, seeds, chains

@query("SELECT read_id, name, sequence, quality FROM reads")
def fastq_reads(spark: SparkSession, d: str) -> DataFrame:
    return X.reads(spark, d)


def _folder(spark) -> str:
    return scratch_folder(spark, "files")


#: Reads of one written FASTQ file.
FILE_READS = 250_000


def _written_reads(spark, d) -> str:
    """A folder of the reads as FASTQ files in order of their ids, at least three. Events are dealt, and reads derived in their order."""
    events = X.events(spark, d)
    files = max(3, -(-events.count() // FILE_READS))
    folder = _folder(spark)
    dealt = events.repartitionByRange(files, "event_id").sortWithinPartitions("event_id")
    sinks.fastq_lines(X.reads_of(dealt, X.contigs(spark, d))).write.text(folder)
    return folder


@query("SELECT read_id, name, sequence, quality FROM reads")
def fastq_source(spark, d):
    """The reads written as FASTQ files in order of their ids, and read by the source in byte ranges."""
    from strandline.sources import fastq

    folder = _written_reads(spark, d)
    found = fastq.read_fastq(spark, f"{folder.removeprefix('file:')}/part-*", split=1 << 18)
    # ids of the files' order and place; the names carry the reads' own
    return found.selectExpr("cast(substr(name, 3) as bigint) read_id", "name", "sequence", "quality")


@query("SELECT name, ordinal::BIGINT AS ordinal, sequence FROM contigs")
def fasta_source(spark, d):
    from strandline.sources import fastq

    folder = _folder(spark)
    sinks.fasta_lines(X.contigs(spark, d).repartitionByRange(1, "ordinal").sortWithinPartitions("ordinal")).write.text(folder)
    return fastq.read_fasta(spark, f"{folder.removeprefix('file:')}/part-*").select("name", "ordinal", "sequence")


def _reference_files(spark, d, tile: int, split: int):
    """The contigs as FASTA in lines of 60 bases, read in byte ranges that cut lines and headers."""
    from strandline.sources import fastq

    folder = scratch_folder(spark, "reference")
    lines = F.array_join(F.regexp_extract_all("sequence", F.lit("(.{1,60})"), F.lit(1)), "\n")
    text = X.contigs(spark, d).select("ordinal", F.concat(F.lit(">"), "name", F.lit(" of hashes\n"), lines).alias("value"))
    text.repartitionByRange(2, "ordinal").sortWithinPartitions("ordinal").select("value").write.text(f"{folder}/text")
    return fastq.read_fasta_tiles(spark, f"{folder.removeprefix('file:')}/text/part-*", folder, tile, split)


@query("SELECT name, t::INT AS tile, 1024::BIGINT AS length, substr(sequence, t::INT * 100 + 1, 200) AS piece FROM contigs, range(11) g(t)")
def reference_tiles(spark, d):
    return _reference_files(spark, d, 100, 777).select("name", "tile", "length", "piece")


@query("SELECT count(*) AS n, count(DISTINCT read_id) AS n_ids, count_if(length(sequence) = length(quality)) AS n_equal_lengths FROM reads")
def read_invariants(spark, d):
    return X.reads(spark, d).agg(F.count("*").alias("n"), F.countDistinct("read_id").alias("n_ids"), F.count_if(F.length("sequence") == F.length("quality")).alias("n_equal_lengths"))


@query("SELECT name, ordinal, length(sequence)::BIGINT AS length, coalesce(sum(length(sequence)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM contigs")
def contig_offsets(spark, d):
    return A.contig_offsets(X.contigs(spark, d)).select("name", "ordinal", "length", "start")


_INDEX = """places AS (SELECT name contig, i AS position, ordinal * 1024 + i AS gpos, substr(sequence, i + 1, 19) kmer FROM contigs, range(1006) g(i)),
idx AS (SELECT contig, position, gpos, kmer, hits FROM (SELECT *, count(*) OVER (PARTITION BY kmer) hits FROM places) WHERE hits <= 8)"""


@query(_INDEX + " SELECT kmer, contig, position, gpos, hits FROM idx")
def kmer_index(spark, d):
    return A.kmer_index(X.contigs(spark, d)).select("kmer", "contig", "position", "gpos", "hits")


@query(_INDEX + ", asked AS (SELECT DISTINCT substr(sequence, 1, 19) kmer FROM reads) SELECT a.kmer, count(i.kmer) AS n FROM asked a LEFT JOIN idx i ON a.kmer = i.kmer GROUP BY ALL")
def kmer_count(spark, d):
    return A.count_kmer(A.kmer_index(X.contigs(spark, d)), X.reads(spark, d).select(F.substring("sequence", 1, 19).alias("kmer")))


@query(_INDEX + """, asked AS (SELECT DISTINCT substr(sequence, 1, 19) kmer FROM reads)
SELECT kmer, gpos FROM (SELECT i.kmer, i.gpos, row_number() OVER (PARTITION BY i.kmer ORDER BY i.gpos) r FROM idx i SEMI JOIN asked a ON a.kmer = i.kmer) WHERE r <= 1024""")
def kmer_search(spark, d):
    return A.search_kmer(A.kmer_index(X.contigs(spark, d)), X.reads(spark, d).select(F.substring("sequence", 1, 19).alias("kmer")))


_ASKED_ANY = """asked AS (SELECT DISTINCT substr(sequence, (read_id % 17)::INT + 1, {n}) AS pattern FROM reads), places AS (SELECT pattern, name AS contig, unnest([i FOR i IN range(1024) IF substr(sequence, i::INT + 1, length(pattern)) = pattern]) AS position FROM asked, contigs WHERE contains(sequence, pattern))"""


def _any_patterns(spark, d, length: str):
    return X.reads(spark, d).select(F.expr(f"substr(sequence, cast(read_id % 17 as int) + 1, {length})").alias("pattern"))


def _suffixes(spark, d):
    from strandline.operators import suffixes

    return suffixes.build_suffix_index(X.contigs(spark, d), scratch_folder(spark, "suffixes"))


@query(_ASKED_ANY.format(n="(1 + read_id % 100)::INT") + " SELECT a.pattern, count(p.pattern) AS n FROM asked a LEFT JOIN places p ON a.pattern = p.pattern GROUP BY 1")
def pattern_count(spark, d):
    """Places of patterns of 1 to 100 bases, cut from all reads, in all contigs."""
    from strandline.operators import suffixes

    return suffixes.count(_any_patterns(spark, d, "cast(1 + read_id % 100 as int)"), _suffixes(spark, d), X.contigs(spark, d))


@query(_ASKED_ANY.format(n="(8 + read_id % 93)::INT") + " SELECT pattern, contig, position FROM places")
def pattern_search(spark, d):
    from strandline.operators import suffixes

    return suffixes.search(_any_patterns(spark, d, "cast(8 + read_id % 93 as int)"), _suffixes(spark, d), X.contigs(spark, d))


@query("SELECT name AS contig, i AS position, rank() OVER (ORDER BY substr(sequence, i::INT + 1)) - 1 AS rank FROM contigs, range(1024) g(i)")
def suffix_order(spark, d):
    """The suffix array of all contigs; equal suffixes of different contigs share their rank."""
    return _suffixes(spark, d).order(spark)


_SEEDS = _INDEX + """, asked AS (SELECT read_id, (o * 6)::INT read_offset, substr(sequence, o * 6 + 1, 19) kmer FROM reads, range(14) g(o)),
seeds AS (SELECT * FROM (SELECT read_id, read_offset, contig, position, gpos, row_number() OVER (PARTITION BY read_id ORDER BY read_offset, gpos)::INT ord FROM asked JOIN idx USING (kmer)) WHERE ord <= 64)"""


def _seeds(spark, d):
    return A.seeds(X.reads(spark, d), A.kmer_index(X.contigs(spark, d)))


@query(_SEEDS + " SELECT read_id, read_offset, contig, position, gpos, ord FROM seeds")
def seed_hits(spark, d):
    return _seeds(spark, d)


@query(_SEEDS + " SELECT read_id, count(*) AS n_seeds FROM seeds GROUP BY 1")
def seed_counts(spark, d):
    return A.seed_counts(_seeds(spark, d))


_CHAIN = _SEEDS + """, supported AS (SELECT a.read_id, a.ord, any_value(a.read_offset) read_offset, any_value(a.contig) contig, any_value(a.position) position, any_value(a.gpos) gpos,
 count(b.ord) k FROM seeds a LEFT JOIN seeds b ON a.read_id = b.read_id AND b.ord < a.ord AND a.gpos > b.gpos AND a.read_offset > b.read_offset
 AND abs((a.gpos - b.gpos) - (a.read_offset - b.read_offset)) < 100 GROUP BY a.read_id, a.ord),
chained AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY k DESC, ord) r, count(*) OVER (PARTITION BY read_id)::INT n_seeds FROM supported) WHERE r = 1)"""


def _chained(spark, d):
    return A.chain(_seeds(spark, d))


@query(_CHAIN + " SELECT read_id, n_seeds, (k * 76 + 190) / 10.0::DOUBLE AS chain_score, read_offset, contig, position, gpos FROM chained")
def chain_best_seed(spark, d):
    return _chained(spark, d)


@query(_CHAIN + " SELECT count(*) AS n, count_if(c.contig = g.name AND c.position - c.read_offset = t.start) AS n_at_truth FROM chained c JOIN truth t USING (read_id) JOIN contigs g USING (ordinal)")
def chain_recovers_truth(spark, d):
    t = X.truth(spark, d).join(X.contigs(spark, d).select("ordinal", "name"), "ordinal")
    return _chained(spark, d).join(t, "read_id").agg(F.count("*").alias("n"), F.count_if((F.col("contig") == F.col("name")) & (F.col("position") - F.col("read_offset") == F.col("start"))).alias("n_at_truth"))


# ---- alignments

_HAMMING = "(SELECT count(*) FROM range(least(length(sequence), length(win))::BIGINT) h(j) WHERE substr(sequence, j + 1, 1) <> substr(win, j + 1, 1)) + abs(length(sequence) - length(win))"
_ALIGN = _CHAIN + f""", placed0 AS (SELECT r.read_id, r.name, r.sequence, r.quality, c.contig, c.gpos, c.read_offset, greatest(0, c.position - c.read_offset) AS start,
 substr(g.sequence, greatest(0, c.position - c.read_offset)::INT + 1, length(r.sequence)) win FROM reads r JOIN chained c USING (read_id) JOIN contigs g ON g.name = c.contig),
aligned AS MATERIALIZED (SELECT *, greatest(0, length(sequence) - 5 * mismatches)::INT score, greatest(0, least(60, length(sequence) - 5 * mismatches))::INT mapq FROM (SELECT *, CASE WHEN length(sequence) = length(win) THEN hamming(sequence, win) ELSE {_HAMMING} END mismatches FROM placed0))"""


def _aligned(spark, d):
    return A.place_each_once(X.reads(spark, d), X.contigs(spark, d))


@query(_ALIGN + " SELECT read_id, contig, start, mismatches::INT AS mismatches, score, mapq FROM aligned")
def ungapped_align(spark, d):
    return _aligned(spark, d).select("read_id", "contig", "start", "mismatches", "score", "mapq")


#: Reads with two bases left out in every fifth and two put in in some of every seventh.
_BENT = """bent AS (SELECT read_id, name, CASE WHEN read_id % 5 = 1 THEN left(sequence, 50) || substr(sequence, 53) WHEN read_id % 7 = 2 THEN left(sequence, 60) || 'AC' || substr(sequence, 61) ELSE sequence END AS sequence, quality FROM reads),
""" + _CHAIN.replace("FROM reads", "FROM bent")


def _bent(spark, d):
    s, i = F.col("sequence"), F.col("read_id")
    cut = F.when(i % 5 == 1, F.concat(F.substring(s, 1, 50), F.substring(s, 53, 100))).when(i % 7 == 2, F.concat(F.substring(s, 1, 60), F.lit("AC"), F.substring(s, 61, 100))).otherwise(s)
    return X.reads(spark, d).withColumn("sequence", cut)


def _band_sql(chained: str, of: str, band: int) -> str:
    """The banded dynamic programming of the reads ``of``, a read's row of lanes at a time, and the way back from the best cell."""
    width, lanes = 2 * band + 1, f"range({2 * band + 1})"
    # gaps along a row: lanes reach one, two, four, ... to the right
    steps, shift = "", 1
    while shift < width:
        steps = f"SELECT read_id, i, len, d, win, inside, [CASE WHEN inside[b + 1] THEN greatest(h[b + 1], CASE WHEN b >= {shift} THEN h[b + 1 - {shift}] - {6 * shift} ELSE 0 END) ELSE 0 END FOR b IN {lanes}] AS h FROM ({steps or 'BASE'})"
        shift *= 2
    c = f"substr(win, (i + 1 + d - {band} + b)::INT + 1, 1)"
    base = f"""SELECT read_id, i + 1 AS i, len, d, win, inside, [CASE WHEN inside[b + 1] THEN greatest(0, h[b + 1] + CASE WHEN substr(sequence, i::INT + 2, 1) = {c} THEN 1 ELSE -4 END, coalesce(h[b + 2], 0) - 6) ELSE 0 END FOR b IN {lanes}] AS h
 FROM (SELECT *, [i + 1 + d - {band} + b >= 0 AND i + 1 + d - {band} + b < length(win) FOR b IN {lanes}] AS inside FROM dp JOIN (SELECT read_id, sequence FROM {of}) USING (read_id) WHERE i + 1 < len)"""
    return chained + f""", faced AS MATERIALIZED (SELECT r.read_id, r.sequence, c.contig, greatest(0, c.position - c.read_offset - 100) AS from_, c.position - c.read_offset - greatest(0, c.position - c.read_offset - 100) AS d,
 substr(g.sequence, greatest(0, c.position - c.read_offset - 100)::INT + 1, length(r.sequence) + 200) AS win FROM {of} r JOIN chained c USING (read_id) JOIN contigs g ON g.name = c.contig),
dp AS (SELECT read_id, -1::BIGINT AS i, length(sequence) AS len, d, win, [0 FOR b IN {lanes}] AS h FROM faced UNION ALL SELECT read_id, i, len, d, win, h FROM ({steps.replace('BASE', base)})),
cells AS MATERIALIZED (SELECT read_id, i, h, list_max(h) AS top FROM dp),
best AS (SELECT read_id, max(top) AS score, arg_max(i, top * 1000 - i) AS i FROM cells GROUP BY 1 HAVING max(top) > 0),
back AS (SELECT b.read_id, b.score, b.i, list_position(c.h, b.score) - 1 AS lane, '' AS ops, 0 AS edits, b.i AS last_i, b.i AS first_i, 0::BIGINT AS first_col, false AS done FROM best b JOIN cells c ON c.read_id = b.read_id AND c.i = b.i
 UNION ALL SELECT read_id, score, CASE WHEN v = 0 OR step = 'D' THEN i ELSE i - 1 END, CASE WHEN v = 0 THEN lane WHEN step = 'I' THEN lane + 1 WHEN step = 'D' THEN lane - 1 ELSE lane END, CASE WHEN v = 0 THEN ops ELSE step || ops END,
  edits + CASE WHEN v > 0 AND (step <> 'M' OR NOT same) THEN 1 ELSE 0 END, last_i, CASE WHEN v = 0 THEN first_i ELSE i END, CASE WHEN v = 0 THEN first_col ELSE col END, v = 0
  FROM (SELECT *, CASE WHEN v = diag THEN 'M' WHEN v = up THEN 'I' ELSE 'D' END AS step FROM
  (SELECT k.*, c.h[k.lane + 1] AS v, k.i + a.d - {band} + k.lane AS col, substr(a.sequence, k.i::INT + 1, 1) = substr(a.win, (k.i + a.d - {band} + k.lane)::INT + 1, 1) AS same,
   p.h[k.lane + 1] + CASE WHEN substr(a.sequence, k.i::INT + 1, 1) = substr(a.win, (k.i + a.d - {band} + k.lane)::INT + 1, 1) THEN 1 ELSE -4 END AS diag, coalesce(p.h[k.lane + 2], 0) - 6 AS up
   FROM back k JOIN cells c ON c.read_id = k.read_id AND c.i = k.i JOIN cells p ON p.read_id = k.read_id AND p.i = k.i - 1 JOIN faced a ON a.read_id = k.read_id WHERE NOT k.done AND k.i >= 0 AND k.lane BETWEEN 0 AND {width - 1})))"""


_TRACED = """traced AS (SELECT read_id, any_value(score) AS score, arg_max(ops, length(ops)) AS ops, max(edits) AS edits, any_value(last_i) AS last_i, min(first_i) AS first_i, arg_max(first_col, length(ops)) AS first_col FROM back GROUP BY 1)"""


@query(_band_sql(_BENT, "bent", 8) + ", " + _TRACED + """ SELECT a.read_id, a.contig, coalesce(t.score, 0)::INT AS score, (from_ + coalesce(first_col, 0))::BIGINT AS start, coalesce(edits, 0)::INT AS edits,
 CASE WHEN t.score IS NULL THEN '*' ELSE (CASE WHEN first_i > 0 THEN first_i || 'S' ELSE '' END) || array_to_string([length(x) || x[1] FOR x IN regexp_extract_all(ops, 'M+|I+|D+')], '') || (CASE WHEN last_i + 1 < length(a.sequence) THEN (length(a.sequence) - last_i - 1) || 'S' ELSE '' END) END AS cigar
 FROM faced a LEFT JOIN traced t USING (read_id)""", recursive=True)
def banded_cigar(spark, d):
    """Alignments with their CIGARs of reads with gaps, in a band of 8 diagonals to either side."""
    place = lambda *of: A.place_banded(*of, BandedParams(band=8), trace=True)
    return A.place_each_once(_bent(spark, d), X.contigs(spark, d), place).select("read_id", "contig", "score", "start", "edits", "cigar")


@query(_band_sql(_CHAIN, "reads", 64) + """ SELECT a.read_id, a.contig, (from_ + coalesce(greatest(0, d - 64 + list_position(c.h, b.score) - 1), 0))::BIGINT AS start, coalesce(b.score, 0)::INT AS score, least(60, coalesce(b.score, 0))::INT AS mapq
 FROM faced a LEFT JOIN best b ON b.read_id = a.read_id LEFT JOIN cells c ON c.read_id = b.read_id AND c.i = b.i""", recursive=True, slow=True)
def banded_align(spark, d):
    return A.place_each_once(X.reads(spark, d), X.contigs(spark, d), A.place_banded).select("read_id", "contig", "start", "score", "mapq")


def aligned_sql(sql: str) -> str:
    """DuckDB SQL over the derived tables and ``aligned``, the reads at their places."""
    return f"WITH {X.CTE}, {_counts(_ALIGN + ', ' + sql)}"


_SAM = _ALIGN + """, sam AS (SELECT r.read_id, r.name qname, CASE WHEN score > 0 THEN 0 ELSE 4 END::INT flag, CASE WHEN score > 0 THEN a.contig ELSE '*' END rname, CASE WHEN score > 0 THEN a.start + 1 ELSE 0 END::BIGINT pos,
 CASE WHEN score > 0 THEN mapq ELSE 0 END::INT mapq, CASE WHEN score > 0 THEN length(r.sequence) || 'M' ELSE '*' END cigar, '*' rnext, 0 pnext, 0 tlen, r.sequence seq, r.quality qual, CASE WHEN score > 0 THEN score ELSE 0 END::INT score
 FROM reads r LEFT JOIN aligned a ON r.read_id = a.read_id)"""


@query(_SAM + " SELECT * FROM sam")
def sam_rows(spark, d):
    return A.sam_of(A.place_each_once(X.reads(spark, d), X.contigs(spark, d), how="left"))


@query(_SAM + " SELECT concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, 'AS:i:' || score) AS line FROM sam")
def sam_text(spark, d):
    return sinks.sam_lines(sam_rows(spark, d))


@query(_SAM + " SELECT read_id, 4 AS flag FROM reads WHERE read_id % 50 = 7 UNION ALL SELECT read_id, flag FROM sam WHERE flag & 4 <> 0 AND read_id % 50 <> 7")
def unmapped_reads(spark, d):
    """Every fiftieth read is unreadable, so it has no seed."""
    r = X.reads(spark, d).withColumn("sequence", F.when(F.expr("read_id % 50 = 7"), F.repeat(F.lit("N"), 100)).otherwise(F.col("sequence")))
    return A.sam_of(A.place_each_once(r, X.contigs(spark, d), how="left")).where(F.col("flag").bitwiseAND(4) != 0).select("read_id", "flag")


@query(_SAM + " SELECT qname, flag, rname, pos, mapq, cigar, seq, qual, score FROM sam")
def align_files(spark, d):
    """Reads and reference from their files: FASTQ in byte ranges, FASTA in tiles that no step puts together again."""
    from strandline.sources import fastq

    folder = _written_reads(spark, d)
    reads, tiles = fastq.read_fastq(spark, f"{folder.removeprefix('file:')}/part-*", split=1 << 18), _reference_files(spark, d, A.TILE, 5000)
    return A.sam_of(A.place_each_once(reads, tiles, how="left")).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "score")


_FLAGGED = _ALIGN + """, rows0 AS (SELECT read_id, gpos, start, contig, mapq, CASE WHEN read_id % 11 = 0 THEN 0 ELSE score END::INT score, (CASE WHEN read_id % 5 = 0 THEN 256 ELSE 0 END + CASE WHEN read_id % 7 = 0 THEN 2048 ELSE 0 END + CASE WHEN read_id % 13 = 0 THEN 1024 ELSE 0 END)::INT flag FROM aligned)"""


def _flagged(spark, d):
    """Alignments with secondary, supplementary and duplicate flags, and zero scores, at fixed ids."""
    bit = lambda n, b: F.when(F.col("read_id") % n == 0, b).otherwise(0)
    rows = _aligned(spark, d).withColumn("flag", bit(5, 256) + bit(7, 2048) + bit(13, 1024))
    return rows.withColumn("score", F.when(F.col("read_id") % 11 == 0, 0).otherwise(F.col("score"))).select("read_id", "gpos", "start", "contig", "mapq", "score", "flag")


@query(_FLAGGED + " SELECT read_id, mapq, score, flag FROM rows0 WHERE mapq >= 30 AND score >= 50 AND flag & 256 = 0 AND flag & 2048 = 0")
def quality_filter(spark, d):
    return A.filter_by_quality(_flagged(spark, d), FilterParams(30, 50, True, True)).select("read_id", "mapq", "score", "flag")


@query(_FLAGGED + " SELECT count(*) AS n_passing FROM rows0 WHERE mapq >= 30 AND score >= 50 AND flag & 256 = 0 AND flag & 2048 = 0")
def quality_filter_count(spark, d):
    return A.count_passing(_flagged(spark, d), FilterParams(30, 50, True, True))


@query(_FLAGGED + " SELECT read_id, score, flag FROM rows0 WHERE score <> 0 AND flag & 1024 = 0")
def compact(spark, d):
    return A.compact(_flagged(spark, d)).select("read_id", "score", "flag")


@query(_FLAGGED + " SELECT count(*) AS total, count_if(flag & 256 = 0) AS primary_n, count_if(flag & 256 <> 0) AS secondary_n, count_if(flag & 1024 <> 0) AS duplicates, round(avg(mapq), 6) AS mean_mapq, round(avg(score), 6) AS mean_score FROM rows0")
def align_stats(spark, d):
    return A.statistics(_flagged(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_mapq", "mean_score")})


@query(_FLAGGED + " SELECT count(*) AS total_reads, count_if(score > 0) AS aligned_reads, round(avg(mapq) FILTER (score > 0), 6) AS mean_mapq, round(count_if(score > 0) / count(*), 6) AS alignment_rate FROM rows0")
def run_metrics(spark, d):
    return A.run_metrics(_flagged(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_mapq", "alignment_rate")})


@query(_FLAGGED + " SELECT contig, count(*) AS n_reads FROM rows0 WHERE score > 0 GROUP BY 1")
def reads_per_contig(spark, d):
    return A.reads_per_contig(_flagged(spark, d))


_MULTI = _ALIGN + """, hits AS (SELECT read_id, gpos, 1 ord, mapq, 0 flag FROM aligned UNION ALL SELECT read_id, gpos, 2, CASE WHEN read_id % 2 = 0 THEN mapq - 1 ELSE mapq END, 0 FROM aligned WHERE read_id % 3 = 0)"""


def _multi(spark, d):
    """Every third read hits its place twice, every other of these with a lower MAPQ."""
    one = _aligned(spark, d).select("read_id", "gpos", F.lit(1).alias("ord"), "mapq", F.lit(0).alias("flag"))
    two = one.where("read_id % 3 = 0").withColumn("ord", F.lit(2)).withColumn("mapq", F.when(F.col("read_id") % 2 == 0, F.col("mapq") - 1).otherwise(F.col("mapq")))
    return one.union(two)


@query(_MULTI + " SELECT read_id, gpos, ord, mapq::INT AS mapq, (CASE WHEN lag(mapq) OVER (PARTITION BY gpos, read_id ORDER BY mapq DESC, ord) > mapq THEN 1024 ELSE 0 END)::INT AS flag FROM hits")
def mark_duplicates(spark, d):
    return A.mark_duplicates(_multi(spark, d))


@query(_MULTI + " SELECT read_id, gpos, ord, mapq::INT AS mapq, (CASE WHEN row_number() OVER (PARTITION BY gpos ORDER BY mapq DESC, read_id, ord) > 1 THEN 1024 ELSE 0 END)::INT AS flag FROM hits")
def mark_duplicates_by_position(spark, d):
    return A.mark_duplicates(_multi(spark, d), by="position")


@query(_ALIGN + " SELECT read_id, gpos, score FROM aligned ORDER BY gpos, read_id")
def coord_sort(spark, d):
    return A.coordinate_sort(_aligned(spark, d).select("read_id", "gpos", "score"))


_PAIRS = _ALIGN + """, mates AS (SELECT read_id, read_id // 2 pair_id, (read_id % 2 + 1)::INT mate, gpos, score FROM aligned),
pairs AS (SELECT pair_id, count(*) n, min(score) s, abs(max(gpos) FILTER (mate = 1) - max(gpos) FILTER (mate = 2)) apart FROM mates GROUP BY 1)"""


@query(_PAIRS + " SELECT read_id, pair_id, mate, coalesce(apart, -1) AS insert_size, coalesce(n = 2 AND s > 0 AND apart BETWEEN 100 AND 1000, false) AS proper, CASE WHEN coalesce(n = 2 AND s > 0 AND apart BETWEEN 100 AND 1000, false) THEN 2 ELSE 0 END::INT AS flag FROM mates JOIN pairs USING (pair_id)")
def validate_pairs(spark, d):
    rows = _aligned(spark, d).select("read_id", F.expr("read_id div 2").alias("pair_id"), F.expr("cast(read_id % 2 + 1 as int)").alias("mate"), "gpos", "score", F.lit(0).alias("flag"))
    return A.validate_pairs(rows).selectExpr("read_id", "pair_id", "mate", "coalesce(insert_size, -1L) insert_size", "proper", "flag")


@query("""one AS (SELECT read_id // 2 pair_id, name FROM reads WHERE read_id % 2 = 0), two AS (SELECT read_id // 2 pair_id, name FROM reads WHERE read_id % 2 = 1)
SELECT pair_id, 1 AS mate, 2 * pair_id AS read_id, one.name FROM one JOIN two USING (pair_id) UNION ALL SELECT pair_id, 2, 2 * pair_id + 1, two.name FROM one JOIN two USING (pair_id)""")
def paired_reads(spark, d):
    """All reads, paired by parity."""
    r = X.reads(spark, d)
    half = lambda m: r.where(f"read_id % 2 = {m}").withColumn("read_id", F.expr("read_id div 2"))
    return A.interleave(A.pair_reads(half(0), half(1))).select("pair_id", "mate", "read_id", "name")


@query("SELECT e.event_id AS read_id, c.name AS contig, (e.user_id * 37 + e.event_id) % 26000 AS gpos, ((e.user_id * 37 + e.event_id) % 26000) - c.ordinal * 1024 AS \"offset\" FROM events e LEFT JOIN contigs c ON ((e.user_id * 37 + e.event_id) % 26000) // 1024 = c.ordinal")
def locate_positions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id read_id", "(user_id * 37 + event_id) % 26000 gpos")
    return A.locate(e, X.contigs(spark, d), bin_size=512).select("read_id", "contig", "gpos", "offset")


@query("SELECT substr(string_agg(sequence, '' ORDER BY ordinal), 1001, 2000) AS sequence FROM contigs")
def reference_subsequence(spark, d):
    return A.subsequence(X.contigs(spark, d), 1000, 2000)


@query("SELECT r.read_id, min(c.name) AS contig, arg_min(instr(c.sequence, r.sequence), c.name)::BIGINT - 1 AS position, 60 AS mapq FROM reads r JOIN contigs c ON contains(c.sequence, r.sequence) GROUP BY 1")
def exact_contains(spark, d):
    return A.contains_exactly(X.reads(spark, d), X.contigs(spark, d)).selectExpr("read_id", "contig", "cast(position as bigint) position", "mapq")


@query(_SAM + " SELECT rname, pos, qname FROM (SELECT * FROM sam WHERE read_id % 2 = 0 UNION ALL SELECT * FROM sam WHERE read_id % 2 = 1) ORDER BY ALL")
def merge_outputs(spark, d):
    s = sam_rows(spark, d)
    return sinks.merge_alignments([s.where("read_id % 2 = 0"), s.where("read_id % 2 = 1")]).select("rname", "pos", "qname")


# ---- sequence functions

@query("SELECT read_id, (length(sequence) - length(replace(sequence, 'A', '')))::INT AS a, (length(sequence) - length(replace(sequence, 'C', '')))::INT AS c, (length(sequence) - length(replace(sequence, 'G', '')))::INT AS g, (length(sequence) - length(replace(sequence, 'T', '')))::INT AS t, (length(sequence) - length(replace(sequence, 'N', '')))::INT AS n FROM reads")
def base_counts(spark, d):
    return X.reads(spark, d).select("read_id", *(S.base_count("sequence", b).alias(b.lower()) for b in "ACGTN"))


@query("SELECT read_id, round((SELECT avg(ascii(substr(quality, j + 1, 1)) - 33) FROM range(length(quality)) g(j)), 6) AS mean_q, round((SELECT avg(ascii(substr(quality, j + 11, 1)) - 33) FROM range(20) g(j)), 6) AS region_q FROM reads")
def mean_quality(spark, d):
    return X.reads(spark, d).select("read_id", F.round(S.mean_quality("quality"), 6).alias("mean_q"), F.round(S.region_quality("quality", 10, 20), 6).alias("region_q"))


@query("SELECT read_id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc, reverse(translate(lower(sequence), 'acgt', 'TGCA')) AS rc_lower, reverse(translate(sequence, 'ACGT', 'TGCA')) || 'N' AS rc_strict, translate(sequence, 'ACGT', '0123') AS codes FROM reads")
def revcomp(spark, d):
    r = X.reads(spark, d)
    return r.select("read_id", S.reverse_complement("sequence").alias("rc"), S.reverse_complement_keep_case(F.lower("sequence")).alias("rc_lower"), S.reverse_complement_strict(F.concat(F.lit("?"), "sequence")).alias("rc_strict"), S.base_codes("sequence").alias("codes"))


@query("SELECT a.read_id, hamming(a.sequence, b.sequence)::INT AS far, hamming(a.sequence, b.sequence)::INT AS far_any_case, hamming(left(a.sequence, 90), left(b.sequence, 90))::INT + 10 AS far_prefix, round(1 - hamming(a.sequence, b.sequence) / 100.0, 6)::DOUBLE AS same FROM reads a JOIN reads b ON b.read_id = a.read_id + 1")
def hamming(spark, d):
    r = X.reads(spark, d)
    b = r.select((F.col("read_id") - 1).alias("read_id"), F.col("sequence").alias("other"))
    return r.join(b, "read_id").select("read_id", S.hamming("sequence", "other").alias("far"), S.hamming_ignore_case(F.lower("sequence"), "other").alias("far_any_case"), S.prefix_distance("sequence", F.substring("other", 1, 90)).alias("far_prefix"), F.round(S.match_fraction("sequence", "other"), 6).alias("same"))


@query("SELECT a.read_id, (SELECT string_agg(greatest(substr(a.quality, j + 1, 1), substr(b.quality, j + 1, 1)), '' ORDER BY j) FROM range(100) g(j)) AS merged, a.sequence = b.sequence AS same FROM reads a JOIN reads b ON b.read_id = a.read_id + 1")
def quality_merge(spark, d):
    r = X.reads(spark, d)
    b = r.select((F.col("read_id") - 1).alias("read_id"), F.col("sequence").alias("s2"), F.col("quality").alias("q2"))
    return r.join(b, "read_id").select("read_id", S.merge_qualities("quality", "q2").alias("merged"), S.equal_ignore_case(F.lower("sequence"), "s2").alias("same"))


@query("SELECT read_id, (o * 6)::INT AS \"offset\", substr(sequence, o * 6 + 1, 19) AS kmer FROM reads, range(14) g(o)")
def kmers(spark, d):
    return X.reads(spark, d).select("read_id", F.explode(S.kmers("sequence")).alias("m")).select("read_id", "m.offset", "m.kmer")


# ---- collapse, assignment

_CLUSTERS = "clusters AS (SELECT sequence, count(*) read_count, min(read_id) first_id, list(read_id ORDER BY read_id) ids FROM reads GROUP BY 1)"


@query(_CLUSTERS + """, q AS (SELECT sequence, string_agg(c, '' ORDER BY j) cq FROM (SELECT sequence, j, max(substr(quality, j + 1, 1)) c FROM reads, range(100) g(j) GROUP BY ALL) GROUP BY 1)
SELECT c.sequence AS consensus_sequence, q.cq AS consensus_quality, c.read_count, array_to_string(c.ids, ',') AS read_ids, round((SELECT avg(ascii(substr(r.quality, j + 1, 1)) - 33) FROM range(100) g(j)), 6) AS avg_quality
FROM clusters c JOIN q USING (sequence) JOIN reads r ON r.read_id = c.first_id""")
def exact_collapse(spark, d):
    out = M.collapse_exact(X.reads(spark, d))
    return out.withColumn("read_ids", F.array_join(F.transform("read_ids", lambda x: x.cast("string")), ",")).withColumn("avg_quality", F.round("avg_quality", 6))


@query(_CLUSTERS + " SELECT sum(read_count)::BIGINT AS reads_in, count(*) AS clusters_out, round(sum(read_count) / count(*), 6) AS compression_ratio, round(avg(read_count), 6) AS avg_cluster_size FROM clusters")
def collapse_stats(spark, d):
    r = X.reads(spark, d)
    return M.collapse_stats(r, _clusters(r)).withColumns({c: F.round(c, 6) for c in ("compression_ratio", "avg_cluster_size")})


def _clusters(reads):
    return reads.groupBy(F.col("sequence").alias("consensus_sequence")).agg(F.count("*").alias("read_count"))


@query(_CLUSTERS + " SELECT a.sequence AS a, b.sequence AS b FROM clusters a JOIN clusters b ON a.sequence < b.sequence AND length(a.sequence) = length(b.sequence) AND hamming(a.sequence, b.sequence) <= 2")
def near_pairs(spark, d):
    return M.near_pairs(X.reads(spark, d).select(F.col("sequence").alias("s")).distinct(), 2)


@query()
def near_merge(spark, d):
    return M.merge_similar(M.collapse_exact(X.reads(spark, d)), 2).select("consensus_sequence", "read_count", "avg_quality")


_ASSIGN = _CLUSTERS + """, cand AS (SELECT c.sequence, c.read_count, t.amplicon_id, t.ord, starts_with(c.sequence, t.primer_fwd) OR starts_with(c.sequence, t.primer_rev) pre,
 EXISTS (SELECT 1 FROM range(length(c.sequence) - 19) g(j) WHERE hamming(substr(c.sequence, j + 1, 20), primer_fwd) <= 2 OR hamming(substr(c.sequence, j + 1, 20), primer_rev) <= 2
  OR hamming(substr(reverse(translate(c.sequence, 'ACGT', 'TGCA')), j + 1, 20), primer_fwd) <= 2 OR hamming(substr(reverse(translate(c.sequence, 'ACGT', 'TGCA')), j + 1, 20), primer_rev) <= 2) near FROM clusters c, targets t),
assigned AS (SELECT c.sequence, c.read_count, b.amplicon_id FROM clusters c LEFT JOIN (SELECT sequence, arg_min(amplicon_id, (CASE WHEN pre THEN 0 ELSE 1000 END) + ord) amplicon_id FROM cand WHERE pre OR near GROUP BY 1) b USING (sequence))"""


def _assigned(spark, d):
    return M.assign(_clusters(X.reads(spark, d)), X.targets(spark, d))


@query(_ASSIGN + " SELECT sequence AS consensus_sequence, read_count, amplicon_id FROM assigned")
def assign_amplicon(spark, d):
    return _assigned(spark, d).select("consensus_sequence", "read_count", "amplicon_id")


_LENGTHS = """varied AS (SELECT c.sequence consensus, l, substr(c.sequence, 401, l) s FROM contigs c, range(100, 400, 7) g(l)),
panel AS (SELECT amplicon_id, ord, 120 + ord * 9 e FROM targets)"""


@query(_LENGTHS + """ SELECT v.s AS consensus_sequence, arg_min(p.amplicon_id, abs(l - e) / e::DOUBLE * 1000000 + ord / 1000.0) AS amplicon_id FROM varied v LEFT JOIN panel p ON abs(l - e) <= 0.2 * e AND 1 - abs(l - e) / e::DOUBLE > 0.8 GROUP BY 1""")
def assign_by_length(spark, d):
    """Stretches of all contigs without primers, in many lengths, against targets of different lengths and unmatchable primers."""
    c = X.contigs(spark, d).select(F.col("sequence").alias("whole"), F.explode(F.sequence(F.lit(100), F.lit(399), F.lit(7))).alias("l"))
    clusters = c.select(F.substr("whole", F.lit(401), F.col("l")).alias("consensus_sequence"))
    panel = X.targets(spark, d).withColumn("expected_length", F.expr("cast(120 + ord * 9 as int)")).withColumn("primer_fwd", F.lit("N" * 20)).withColumn("primer_rev", F.lit("N" * 20))
    return M.assign(clusters, panel).select("consensus_sequence", "amplicon_id")


@query(_ASSIGN + " SELECT amplicon_id, count(*) AS n_clusters, sum(read_count)::BIGINT AS n_reads FROM assigned WHERE amplicon_id IS NOT NULL GROUP BY 1")
def amplicon_counts(spark, d):
    return M.amplicon_counts(_assigned(spark, d))


@query(_ASSIGN + " SELECT count(*) AS clusters, count(amplicon_id) AS assigned_clusters, round(count(amplicon_id) / count(*), 6) AS assignment_rate FROM assigned")
def assignment_rate(spark, d):
    return M.assignment_rate(_assigned(spark, d)).withColumn("assignment_rate", F.round("assignment_rate", 6))


# ---- demultiplexing

_DEMUX = """codes AS (SELECT sample_id, 0 strand, barcode code FROM barcodes WHERE i < 8 UNION ALL SELECT sample_id, 1, reverse(translate(barcode, 'ACGT', 'TGCA')) FROM barcodes WHERE i < 8),
tries AS (SELECT read_id, sample_id, strand, j pos, hamming(substr(sequence, j + 1, 8), code) mm FROM barcoded, codes, range(43) g(j)),
best AS (SELECT read_id, sample_id, strand, min(mm) mm, arg_min(pos, mm * 100 + pos) pos FROM tries WHERE mm <= 1 GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY read_id ORDER BY mm) r FROM best),
won AS (SELECT read_id, count(*) ties, min(mm) mm, arg_min(sample_id, (sample_id, strand)) sample_id, arg_min(pos, (sample_id, strand)) pos FROM ranked WHERE r = 1 GROUP BY 1),
demuxed AS (SELECT read_id, sequence, CASE WHEN w.ties IS NULL THEN 'unassigned' WHEN w.ties > 1 THEN 'ambiguous' WHEN (SELECT avg(ascii(substr(quality, pos::INT + k + 1, 1)) - 33) FROM range(8) g(k)) < 20 THEN 'qc_failed' ELSE 'assigned' END status, w.mm::INT mm, w.sample_id s, w.pos FROM barcoded LEFT JOIN won w USING (read_id))"""


def _demuxed(spark, d):
    return M.demultiplex(X.barcoded(spark, d), X.barcodes(spark), DemuxParams())


@query(_DEMUX + " SELECT read_id, status, CASE WHEN status = 'assigned' THEN s END AS sample_id, coalesce(mm, -1) AS mismatches, CASE WHEN status = 'assigned' THEN substr(sequence, pos::INT + 9) ELSE sequence END AS trimmed FROM demuxed")
def demux(spark, d):
    return _demuxed(spark, d).selectExpr("read_id", "status", "sample_id", "coalesce(mismatches, -1) mismatches", "trimmed")


@query(_DEMUX + " SELECT count(*) AS total, count_if(status = 'assigned') AS assigned, count_if(status = 'unassigned') AS unassigned, count_if(status = 'ambiguous') AS ambiguous, count_if(status = 'qc_failed') AS qc_failed, round(count_if(status = 'assigned') / count(*), 6) AS assignment_rate FROM demuxed")
def demux_stats(spark, d):
    return M.demux_stats(_demuxed(spark, d)).withColumn("assignment_rate", F.round("assignment_rate", 6))


@query(_DEMUX + " SELECT CASE WHEN status = 'assigned' THEN s ELSE 'unassigned' END AS bin, count(*) AS n_reads FROM demuxed GROUP BY 1")
def demux_bins(spark, d):
    return M.reads_per_bin(_demuxed(spark, d))


_DUAL = """own AS (SELECT read_id, read_id % 9 a, (read_id + CASE WHEN read_id % 10 = 0 THEN 1 ELSE 0 END) % 9 b FROM reads),
named AS (SELECT read_id, x.sample_id s7, y.sample_id s5 FROM own LEFT JOIN barcodes x ON x.i = a AND x.i < 8 LEFT JOIN barcodes y ON y.i = b AND y.i < 8)"""


def _index_reads(spark, d):
    """Bare index reads: a barcode in each mate, of the next sample in the second of every tenth."""
    code = lambda n: F.get(F.array(*map(F.lit, X.CODES)), F.expr(f"cast({n} % 9 as int)"))
    return X.truth(spark, d).select("read_id", code("read_id").alias("sequence"), F.lit("IIIIIIII").alias("quality"), code("(read_id + if(read_id % 10 = 0, 1, 0))").alias("sequence2"), F.lit("IIIIIIII").alias("quality2"))


@query(_DUAL + " SELECT read_id, CASE WHEN s7 = s5 THEN 'assigned' WHEN s7 IS NOT NULL AND s5 IS NOT NULL THEN 'ambiguous' ELSE 'unassigned' END AS status, CASE WHEN s7 = s5 THEN s7 END AS sample_id FROM named")
def demux_dual(spark, d):
    b = X.barcodes(spark)
    return M.demultiplex_dual(_index_reads(spark, d), b, b).select("read_id", "status", "sample_id")


@query(_DUAL + " SELECT read_id, coalesce(s7, s5) AS sample_id FROM named")
def demux_either_mate(spark, d):
    return M.demultiplex_either(_index_reads(spark, d), X.barcodes(spark)).select("read_id", "sample_id")


# ---- primers

_TRIM = """ends AS (SELECT r.read_id, repeat('A', CASE WHEN read_id % 10 % 3 = 2 THEN 3 ELSE 0 END) || (CASE WHEN read_id % 10 < 5 THEN primer_fwd ELSE '' END) || r.sequence || (CASE WHEN read_id % 2 = 0 THEN reverse(translate(primer_rev, 'ACGT', 'TGCA')) ELSE '' END) AS sequence FROM reads r JOIN truth USING (read_id) JOIN targets t ON t.ord = truth.ordinal)"""


def _primed(spark, d):
    """All reads with their target's primers at none, either or both ends; some have bases before the forward one, which then is not
    at offset 0."""
    own = F.broadcast(X.targets(spark, d).select(F.col("ord").cast("int").alias("ordinal"), "primer_fwd", "primer_rev"))  # one a contig
    r = X.reads(spark, d).join(X.truth(spark, d).select("read_id", "ordinal"), "read_id").join(own, "ordinal").withColumn("v", F.expr("read_id % 10"))
    s = F.concat(F.when(F.col("v") % 3 == 2, "AAA").otherwise(""), F.when(F.col("v") < 5, F.col("primer_fwd")).otherwise(""), "sequence", F.when(F.col("v") % 2 == 0, S.reverse_complement("primer_rev")).otherwise(""))
    return r.select("read_id", s.alias("sequence")).withColumn("quality", F.repeat(F.lit("I"), F.length("sequence")))


_TRIMMED = _TRIM + """, fit AS (SELECT e.read_id, e.sequence, CASE WHEN hamming(left(e.sequence, 20), t.primer_fwd) <= 2 THEN hamming(left(e.sequence, 20), t.primer_fwd) * 1000 + t.ord END f,
 (SELECT min(m) FROM (SELECT greatest(length(e.sequence) - 30, 0) + o p, CASE WHEN hamming(substr(e.sequence, greatest(length(e.sequence) - 30, 0) + o + 1, 20), reverse(translate(t.primer_rev, 'ACGT', 'TGCA'))) <= 2 THEN (hamming(substr(e.sequence, greatest(length(e.sequence) - 30, 0) + o + 1, 20), reverse(translate(t.primer_rev, 'ACGT', 'TGCA'))) * 1000 + t.ord) * 1000 + greatest(length(e.sequence) - 30, 0) + o END m FROM range(11) g(o)) ) r FROM ends e, targets t),
 cut AS (SELECT read_id, any_value(sequence) sequence, min(f) f, min(r) % 1000 r FROM fit GROUP BY 1)"""


def _trimmed(spark, d):
    return M.trim_primers(_primed(spark, d), X.targets(spark, d), TrimParams())


@query(_TRIMMED + " SELECT read_id, f IS NOT NULL AS fwd_found, r IS NOT NULL AS rev_found, substr(sequence, CASE WHEN f IS NULL THEN 1 ELSE 21 END, (coalesce(r, length(sequence)) - CASE WHEN f IS NULL THEN 0 ELSE 20 END)::INT) AS trimmed_sequence FROM cut")
def primer_trim(spark, d):
    return _trimmed(spark, d).select("read_id", "fwd_found", "rev_found", "trimmed_sequence")


@query(_TRIMMED + " SELECT count(*) AS total, count(f) AS fwd, count(r) AS rev, count_if(f IS NOT NULL AND r IS NOT NULL) AS \"both\", count_if(f IS NULL AND r IS NULL) AS neither, sum(CASE WHEN f IS NULL THEN 0 ELSE 20 END + length(sequence) - coalesce(r, length(sequence)))::BIGINT AS bases_trimmed FROM cut")
def trim_stats(spark, d):
    return M.trim_stats(_trimmed(spark, d))


# ---- chimeras

@query("SELECT row_number() OVER (ORDER BY n DESC, sequence)::INT AS ord, sequence, n AS abundance FROM (SELECT sequence, count(*) n FROM reads GROUP BY 1 ORDER BY n DESC, sequence LIMIT 100)")
def chimera_parents(spark, d):
    return M.chimera_parents(_clusters(X.reads(spark, d)))


_CHIM = """groups AS (SELECT min(read_id)::BIGINT id, sequence, count(*) abundance FROM reads GROUP BY sequence),
parents AS (SELECT sequence p, abundance pa, row_number() OVER (ORDER BY abundance DESC, sequence) ord FROM groups QUALIFY ord <= 100),
sides AS (SELECT id, bp, ord, pa >= 2 * abundance heavy, hamming(left(sequence, bp), left(p, bp)) dl, hamming(substr(sequence, bp + 1), substr(p, bp + 1)) dr FROM groups, parents, (SELECT (30 + 5 * k)::INT bp FROM range(9) g(k))),
per AS (SELECT id, bp, min(dl) + min(dr) AS d, count(*) k FROM sides WHERE heavy GROUP BY ALL),
best AS (SELECT id, arg_min(d, d * 1000 + bp) d, arg_min(bp, d * 1000 + bp) bp FROM per WHERE k >= 2 GROUP BY 1),
lefts AS (SELECT id, bp, ord, dl FROM sides QUALIFY row_number() OVER (PARTITION BY id, bp ORDER BY dl, ord) <= 2),
rights AS (SELECT id, bp, ord, dr FROM sides QUALIFY row_number() OVER (PARTITION BY id, bp ORDER BY dr, ord) <= 2),
pairs AS (SELECT l.id, l.bp, l.dl + r.dr AS d FROM lefts l JOIN rights r ON l.id = r.id AND l.bp = r.bp AND l.ord <> r.ord),
rbest AS (SELECT id, arg_min(d, d * 1000 + bp) d, arg_min(bp, d * 1000 + bp) bp FROM pairs GROUP BY 1),
verdicts AS (SELECT g.id, g.abundance, coalesce(b.d < 10, false) n, coalesce(r.d < 10, false) r FROM groups g LEFT JOIN best b USING (id) LEFT JOIN rbest r USING (id))"""


def _chimera_clusters(spark, d):
    """All clusters of the reads, by the id of their first read, and their chimera parents."""
    c = M.collapse_exact(X.reads(spark, d))
    return c.select(F.array_min("read_ids").alias("id"), F.col("consensus_sequence").alias("sequence"), F.col("read_count").alias("abundance")), M.chimera_parents(c)


@query(_CHIM + " SELECT g.id, coalesce(b.d, -1)::INT AS distance, coalesce(b.bp, -1)::INT AS breakpoint, coalesce(b.d < 10, false) AS is_chimera FROM groups g LEFT JOIN best b USING (id)")
def chimera_de_novo(spark, d):
    q, p = _chimera_clusters(spark, d)
    return M.chimera_de_novo(q, p, ChimeraParams()).fillna(-1, ["distance", "breakpoint"])


@query(_CHIM + " SELECT g.id, coalesce(b.d, -1)::INT AS distance, coalesce(b.bp, -1)::INT AS breakpoint, coalesce(b.d < 10, false) AS is_chimera FROM groups g LEFT JOIN rbest b USING (id)")
def chimera_reference(spark, d):
    q, p = _chimera_clusters(spark, d)
    return M.chimera_reference(q, p, ChimeraParams()).fillna(-1, ["distance", "breakpoint"])


@query(_CHIM + " SELECT id, abundance FROM verdicts WHERE NOT (n OR r)")
def chimera_filter(spark, d):
    q, p = _chimera_clusters(spark, d)
    return M.filter_chimeras(q, M.detect_chimeras(q, p, p)).select("id", "abundance")


@query(_CHIM + " SELECT count(*) AS checked, count_if(n OR r) AS found, count_if(n) AS de_novo, count_if(r AND NOT n) AS reference, round(count_if(n OR r) / count(*), 6) AS chimera_rate FROM verdicts")
def chimera_stats(spark, d):
    q, p = _chimera_clusters(spark, d)
    return M.chimera_stats(M.detect_chimeras(q, p, p)).withColumn("chimera_rate", F.round("chimera_rate", 6))


# ---- alignment kernels

@query()
def sw_local(spark, d):
    """A stretch of every contig with two bases left out, against all whole contigs."""
    ref = X.contigs(spark, d).select(F.col("name").alias("target_id"), F.col("ordinal").alias("ord"), "sequence")
    at = F.col("ord") * 37 % 900 + 1
    q = ref.select(F.col("ord").cast("bigint").alias("query_id"), F.concat(F.substr("sequence", at, F.lit(40)), F.substr("sequence", at + 42, F.lit(40))).alias("sequence"))
    return M.best_alignment(q, ref)


# ---- pileup, calls, joint genotypes

_PILE = """cols AS (SELECT m.chromosome, m.position, m.ref_base, substr(p.sequence, (m.position - p.start)::INT + 1, 1) b, ascii(substr(p.quality, (m.position - p.start)::INT + 1, 1)) - 33 q FROM markers m JOIN placed p ON p.chromosome = m.chromosome AND m.position BETWEEN p.start AND p.start + length(p.sequence) - 1),
piles0 AS (SELECT chromosome, position, ref_base, count_if(b = 'A') a, count_if(b = 'C') c, count_if(b = 'G') g, count_if(b = 'T') t, count(*) AS depth, count_if(b = ref_base) ref_count, sum(q)::BIGINT quality_sum FROM cols GROUP BY ALL),
alts AS (SELECT chromosome, position, b, count(*) n FROM cols WHERE b <> ref_base AND b IN ('A', 'C', 'G', 'T') GROUP BY ALL),
top AS (SELECT chromosome, position, b, n FROM (SELECT *, row_number() OVER (PARTITION BY chromosome, position ORDER BY n DESC, b) r FROM alts) WHERE r = 1),
piles AS (SELECT p.*, coalesce(top.b, 'N') alt_base, coalesce(top.n, 0) alt_count, depth - ref_count - coalesce(top.n, 0) other_count FROM piles0 p LEFT JOIN top USING (chromosome, position)),
calls AS (SELECT *, alt_count / depth::DOUBLE af, CASE WHEN alt_count / depth::DOUBLE < 0.25 THEN '0/0' WHEN alt_count / depth::DOUBLE > 0.75 THEN '1/1' ELSE '0/1' END gt FROM piles WHERE depth >= 10 AND alt_count / depth::DOUBLE >= 0.01 AND alt_base <> 'N')"""


def _piles(spark, d):
    return M.pileup(X.placed(spark, d), X.markers(spark, d))


def _calls(spark, d):
    return M.call_variants(_piles(spark, d), CALL)


@query(_PILE + " SELECT chromosome, position, ref_base, a AS n_a, c AS n_c, g AS n_g, t AS n_t, depth, ref_count, alt_base, alt_count, other_count, quality_sum FROM piles")
def pileup(spark, d):
    return _piles(spark, d).selectExpr("chromosome", "position", "ref_base", "A n_a", "C n_c", "G n_g", "T n_t", "depth", "ref_count", "alt_base", "alt_count", "other_count", "quality_sum")


@query(_PILE + " SELECT chromosome, position, ref_base, alt_base, depth, alt_count, round(af, 6) AS allele_frequency, gt AS genotype FROM calls")
def call_variants(spark, d):
    return _calls(spark, d).select("chromosome", "position", "ref_base", "alt_base", "depth", "alt_count", F.round("allele_frequency", 6).alias("allele_frequency"), "genotype")


_QUAL = _PILE + """, lik AS (SELECT *, [exp(lgamma(depth + 1) - lgamma(alt_count + 1) - lgamma(depth - alt_count + 1) + alt_count * ln(p) + (depth - alt_count) * ln(1 - p)) FOR p IN [0.01::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]] l FROM calls),
quals AS (SELECT *, trunc(least(60, greatest(0, CASE WHEN list_sort(l)[2] > 1e-10 THEN 10 * log10(list_sort(l)[3] / list_sort(l)[2]) ELSE 10 * log10(depth) END)))::INT qual FROM lik)"""


@query(_QUAL + " SELECT chromosome, position, alt_count, depth, qual FROM quals")
def variant_qual(spark, d):
    return _calls(spark, d).select("chromosome", "position", "alt_count", "depth", "qual")


@query(_QUAL + """ SELECT concat_ws(chr(9), chromosome, position + 1, CASE WHEN position = 100 THEN amplicon_id ELSE '.' END, ref_base, alt_base, qual, 'PASS',
 'AMP=' || CASE WHEN position = 100 THEN amplicon_id ELSE '.' END || ';DP=' || depth || ';AF=' || printf('%.3f', round(af, 3)) || ';RD=' || ref_count || ';AD=' || alt_count || CASE WHEN position = 100 THEN ';KNOWN' ELSE '' END, 'GT:DP:AD:AF', gt || ':' || depth || ':' || ref_count || ',' || alt_count || ':' || printf('%.3f', round(af, 3))) AS line FROM quals JOIN targets USING (chromosome)""")
def vcf_rows(spark, d):
    return sinks.vcf_lines(M.annotate_variants(_calls(spark, d), X.targets(spark, d)), ["sample_001"])


@query(_PILE + """, cov AS (SELECT amplicon_id, depth FROM piles JOIN targets USING (chromosome)), n AS (SELECT amplicon_id, count(*) k FROM calls JOIN targets USING (chromosome) WHERE position = 100 GROUP BY 1)
SELECT amplicon_id, round(avg(depth), 6) AS mean_depth, min(depth) AS min_depth, max(depth) AS max_depth, round(stddev_pop(depth) / avg(depth), 6) AS uniformity, coalesce(max(k), 0)::BIGINT AS variants_called FROM cov LEFT JOIN n USING (amplicon_id) GROUP BY 1""")
def amplicon_stats(spark, d):
    t = X.targets(spark, d)
    cov = _piles(spark, d).join(t.select("chromosome", "amplicon_id"), "chromosome")
    return M.amplicon_stats(cov, M.annotate_variants(_calls(spark, d), t)).withColumns({c: F.round(c, 6) for c in ("mean_depth", "uniformity")})


_JOINT = """sv AS (SELECT 'S' || (read_id % 4) sample_id, m.chromosome, m.position, m.ref_base, substr(p.sequence, (m.position - p.start)::INT + 1, 1) b FROM markers m JOIN placed p ON p.chromosome = m.chromosome AND m.position BETWEEN p.start AND p.start + length(p.sequence) - 1),
deep AS (SELECT sample_id, chromosome, position, ref_base, count(*) AS depth FROM sv GROUP BY ALL), alt AS (SELECT sample_id, chromosome, position, b, n FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, chromosome, position ORDER BY n DESC, b) r FROM (SELECT sample_id, chromosome, position, b, count(*) n FROM sv WHERE b <> ref_base GROUP BY ALL)) WHERE r = 1),
vars AS (SELECT d.*, a.b alt_base, a.n, a.n / depth::DOUBLE af FROM deep d JOIN alt a USING (sample_id, chromosome, position) WHERE depth >= 2),
sites AS (SELECT chromosome, position, arg_min(ref_base, sample_id) ref_allele, arg_min(alt_base, sample_id) alt_allele FROM vars GROUP BY ALL),
joint AS (SELECT s.*, p.sample_id, CASE WHEN v.af IS NULL THEN './.' WHEN v.af < 0.25 THEN '0/0' WHEN v.af > 0.75 THEN '1/1' ELSE '0/1' END genotype, coalesce(v.depth, 0) AS depth, coalesce(v.n, 0) alt_depth, coalesce(v.af, 0) af FROM sites s CROSS JOIN (SELECT DISTINCT 'S' || (read_id % 4) sample_id FROM reads) p LEFT JOIN vars v ON v.chromosome = s.chromosome AND v.position = s.position AND v.sample_id = p.sample_id)"""


def _joint(spark, d):
    """Calls of four samples (by read_id), then their joint genotypes."""
    p, m = X.placed(spark, d), X.markers(spark, d)
    sampled = M.pileup(p.withColumn("chromosome", F.concat_ws("|", F.concat(F.lit("S"), F.col("read_id") % 4), "chromosome")), m.select(F.explode(F.array(*(F.concat(F.lit(f"S{i}|"), "chromosome") for i in range(4)))).alias("chromosome"), "position", "ref_base"))
    both = M.call_variants(sampled, CallParams(2, 1e-9))
    v = both.select(F.split("chromosome", "\\|")[0].alias("sample_id"), F.split("chromosome", "\\|")[1].alias("chromosome"), "position", F.col("ref_base").alias("ref_allele"), F.col("alt_base").alias("alt_allele"), "allele_frequency", F.col("depth").alias("total_depth"), F.lit("").alias("amplicon_id"))
    return M.joint_genotypes(v, spark.createDataFrame([(f"S{i}",) for i in range(4)], "sample_id string"))


@query(_JOINT + " SELECT chromosome, position, ref_allele, alt_allele, sample_id, genotype, depth, alt_depth, round(af, 6) AS allele_frequency FROM joint")
def joint_genotype(spark, d):
    return _joint(spark, d).drop("amplicon_id").withColumn("allele_frequency", F.round("allele_frequency", 6))


_AC = "ac AS (SELECT chromosome, position, sum(CASE genotype WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END)::BIGINT ac, sum(CASE genotype WHEN './.' THEN 0 ELSE 2 END)::BIGINT an, sum(depth)::BIGINT dp FROM joint GROUP BY ALL)"


@query(_JOINT + ", " + _AC + " SELECT chromosome, position, ac, an, dp, round(CASE WHEN an = 0 THEN 0 ELSE ac / an::DOUBLE END, 6) AS af FROM ac")
def allele_counts(spark, d):
    return M.allele_counts(_joint(spark, d)).withColumn("af", F.round("af", 6))


@query(_JOINT + " SELECT sample_id, count(*) AS genotypes, count_if(genotype = './.') AS missing, count_if(genotype IN ('0/1', '1/1')) AS variants FROM joint GROUP BY 1")
def genotype_stats(spark, d):
    return M.genotype_stats(_joint(spark, d))


@query(_JOINT + ", " + _AC + """, cells AS (SELECT chromosome, position, ref_allele, alt_allele, string_agg(CASE WHEN genotype = './.' THEN './.:0:0,0:0.000:0' ELSE genotype || ':' || depth || ':' || (depth - alt_depth) || ',' || alt_depth || ':' || printf('%.3f', round(af, 3)) || ':60' END, chr(9) ORDER BY sample_id) c FROM joint GROUP BY ALL)
SELECT concat_ws(chr(9), chromosome, position + 1, '.', ref_allele, alt_allele, '60', 'PASS', 'AMP=.;AC=' || ac || ';AN=' || an || ';AF=' || printf('%.4f', round(ac / an::DOUBLE, 4)) || ';DP=' || dp, 'GT:DP:AD:AF:GQ', c) AS line FROM cells JOIN ac USING (chromosome, position)""")
def multi_vcf_rows(spark, d):
    g = _joint(spark, d)
    return sinks.multi_vcf_lines(g, M.allele_counts(g), [f"S{i}" for i in range(4)])


@query(_JOINT + " SELECT DISTINCT chromosome, position FROM joint")
def distinct_positions(spark, d):
    return _joint(spark, d).select("chromosome", "position").distinct()


# ---- work split, coverage, stats

@query("SELECT read_id, (read_id // ceil((SELECT count(*) FROM reads) / 7)::BIGINT)::INT AS chunk FROM reads")
def chunk_assign(spark, d):
    return M.chunks(X.reads(spark, d), 7).select("read_id", "chunk")


@query("""w AS (SELECT i, [108 * 80.0, 84 * 86.0, 142 * 89.0][i::INT + 1] x, (SELECT count(*) FROM reads) n FROM range(3) g(i)), z AS (SELECT i, n, CASE WHEN i = 2 THEN NULL ELSE trunc(n * x / (SELECT sum(x) FROM w))::BIGINT END k FROM w)
SELECT i AS part, coalesce(k, n - (SELECT sum(k) FROM z)::BIGINT) AS size FROM z""")
def weighted_split(spark, d):
    n = X.truth(spark, d).count()
    return spark.createDataFrame([(i, s) for i, (_, s) in enumerate(M.weighted_split(n, [108 * 80.0, 84 * 86.0, 142 * 89.0]))], "part bigint, size bigint")


@query("SELECT i AS part, (n // 7 + CASE WHEN i < n % 7 THEN 1 ELSE 0 END)::BIGINT AS size FROM range(7) g(i), (SELECT count(*) n FROM reads)")
def even_split(spark, d):
    return spark.createDataFrame([(i, s) for i, (_, s) in enumerate(M.even_split(X.truth(spark, d).count(), 7))], "part bigint, size bigint")


@query("c AS (SELECT ordinal, count(*) n FROM truth GROUP BY 1) SELECT bool_and(n >= 100) AS sufficient, min(n) AS least, max(n) AS most FROM c")
def coverage_check(spark, d):
    return M.has_coverage(X.truth(spark, d).groupBy("ordinal").agg(F.count("*").alias("depth")), 100)


@query("SELECT '{\"reads_in\":' || count(*) || ',\"bases\":' || sum(length(sequence))::BIGINT || '}' AS json FROM reads")
def stats_json(spark, d):
    return sinks.stats_json(X.reads(spark, d).agg(F.count("*").alias("reads_in"), F.sum(F.length("sequence")).alias("bases")))


@query(_ASSIGN + """, one AS (SELECT (SELECT sum(read_count)::BIGINT FROM assigned) a, (SELECT count(*) FROM assigned) b, (SELECT count(amplicon_id) FROM assigned) c)
SELECT a AS total_reads, b AS collapsed_clusters, round(a / b, 6) AS collapse_ratio, c AS assigned_clusters, round(c / b, 6) AS assignment_rate, c AS aligned_clusters, 1.0::DOUBLE AS alignment_rate, 0::BIGINT AS variants_called FROM one""")
def panel_stats(spark, d):
    """The eight statistics of a panel run over the collapsed reads, before calling."""
    assigned = _assigned(spark, d)
    placed = assigned.where("amplicon_id is not null")
    out = M.panel_stats(_clusters(X.reads(spark, d)), assigned, placed, spark.range(0))
    return out.withColumns({c: F.round(c, 6) for c in ("collapse_ratio", "assignment_rate", "alignment_rate")})


@query(_ASSIGN + """, seen AS (SELECT t.chromosome, substr(g.sequence, 101, 1) AS ref, substr(a.sequence, 21, 1) AS b, sum(a.read_count)::BIGINT AS n FROM assigned a JOIN targets t USING (amplicon_id) JOIN contigs g ON g.name = t.chromosome WHERE length(a.sequence) >= 21 GROUP BY ALL),
depths AS (SELECT chromosome, sum(n)::BIGINT AS depth, coalesce(max(n) FILTER (b <> ref AND b IN ('A', 'C', 'G', 'T')), 0) AS alt FROM seen GROUP BY 1),
one AS (SELECT (SELECT sum(read_count)::BIGINT FROM assigned) a, (SELECT count(*) FROM assigned) b, (SELECT count(amplicon_id) FROM assigned) c, (SELECT count(*) FROM depths WHERE depth >= 10 AND alt > 0 AND alt / depth::DOUBLE >= 0.01) v)
SELECT a AS total_reads, b AS collapsed_clusters, round(a / b, 6) AS collapse_ratio, c AS assigned_clusters, round(c / b, 6) AS assignment_rate, c AS aligned_clusters, 1.0::DOUBLE AS alignment_rate, v AS variants_called FROM one""")
def panel_run_stats(spark, d):
    """The statistics of a whole panel run, from reads to calls."""
    from strandline.plans import pipelines as P

    out = P.call_panel(X.reads(spark, d), X.targets(spark, d), X.contigs(spark, d), CALL, distance=0).stats
    return out.select("total_reads", "collapsed_clusters", F.round("collapse_ratio", 6).alias("collapse_ratio"), "assigned_clusters", F.round("assignment_rate", 6).alias("assignment_rate"), "aligned_clusters", F.round("alignment_rate", 6).alias("alignment_rate"), "variants_called")


@query("SELECT count(*) AS total_reads, sum(length(sequence))::BIGINT AS total_bases FROM reads")
def stream_totals(spark, d):
    """The streaming totals of the reads, run to completion over a file stream into a memory table."""
    import uuid

    from strandline.streaming import realtime as R

    folder = scratch_folder(spark, "stream")
    X.reads(spark, d).repartition(4).write.parquet(f"{folder}/in")
    name = f"totals_{uuid.uuid4().hex}"
    q = R.totals(R.watch_reads(spark, f"{folder}/in", 1)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# ---- the whole amplicon pipeline

@query(_PILE + " SELECT count(*) AS n_variants, count_if(gt = '0/0') AS hom_ref, count_if(gt = '0/1') AS het, count_if(gt = '1/1') AS hom_alt FROM calls")
def genotype(spark, d):
    g = _calls(spark, d).withColumn("g", G.genotype("allele_frequency"))
    return g.agg(F.count("*").alias("n_variants"), F.count_if(F.col("g") == "0/0").alias("hom_ref"), F.count_if(F.col("g") == "0/1").alias("het"), F.count_if(F.col("g") == "1/1").alias("hom_alt"))
