"""How far the sources of a language differ in their words: exact chi-square-like divergences of smoothed frequencies.

Words are found in bytes. The texts of a batch stand in one buffer; a table of 256 entries lower-cases A to Z and clears every
byte that is no letter of ASCII and below 0x80, so the borders of words are where cleared bytes begin and end. Slices between
them are grouped by their 64-bit xxhash; each slice is then compared byte for byte with the first of its group, and those
that differ form groups of their own. Documents by words is a sparse matrix in compressed rows, whose entries give the
occurrences of a word in a (language, source) group and the number of documents that hold it.

Spark adds these up. A language keeps the V words that at least ``least`` of its documents hold. In a group (or a whole
language) with N occurrences of kept words, a word that occurs ``count`` times weighs p = 1 + floor(10**9 (count + 1) / (N + V)); words
that do not occur count too. The divergence of p from q is floor((p - q)**2 / q), an integer. Words of a language are dealt
into buckets of about ``ROWS`` (source, word) entries. A bucket is a sparse matrix of sources by words: for
each other source, the divergences of all sources' entries are summed by ``reduceat``, and the words that a source lacks
follow from the two weights of count 0. Sums of buckets add up to the divergence of two sources (part ``pair``).
Part ``term`` has the words that are more frequent in a source than in its language, by divergence.

A null text, language or source counts as an empty one. Every row is a document, repeated ones too. Groups without words occur
in part ``pair``; a language without kept words has divergences 0. Equal values rank by the item's bytes. Texts of any length
are read whole. Columns of other names are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._spark import Scratch, small, table

#: Entries of a bucket, about.
ROWS = 1 << 14
#: Sources that are compared with all others in one task.
BLOCK = 256
#: Ranks of part ``term``.
TOP = 200
SCALE = 10**9
#: What each byte is in a word: a letter as itself, in lower case, and 0 outside of words.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every range, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


def cut(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with all else cleared, and where words begin and end."""
    letters = LETTER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(letters) + 2, np.int8)
    inside[1:-1] = letters != 0
    edges = np.flatnonzero(np.diff(inside))
    return letters, edges[::2], edges[1::2]


def group(letters: np.ndarray, begin: np.ndarray, end: np.ndarray, digest=None) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's group, first word of each group): words are in one group if and only if their bytes are equal."""
    if digest is None:
        from xxhash import xxh3_64_intdigest as digest
    raw = letters.tobytes()
    hashed = np.fromiter((digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    _, first, word = np.unique(hashed, return_index=True, return_inverse=True)
    sizes, model = end - begin, first[word]
    same = sizes == sizes[model]
    if same.any():
        mine, its = ranges(begin[same], sizes[same]), ranges(begin[model[same]], sizes[same])
        at = np.cumsum(sizes[same]) - sizes[same]
        same[same] = np.logical_and.reduceat(letters[mine] == letters[its], at)
    if not same.all():  # other bytes of an equal hash
        firsts, more = first.tolist(), {}
        for i in np.flatnonzero(~same).tolist():
            piece = raw[begin[i] : end[i]]
            if piece not in more:
                more[piece] = len(firsts)
                firsts.append(i)
            word[i] = more[piece]
        first = np.array(firsts)
    return word, first


def _counts(digest=None):
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            texts, lang, source = b.column(0), b.column(1).dictionary_encode(), b.column(2).dictionary_encode()
            pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            groups, of_row = np.unique(pair, return_inverse=True)
            raw = b"\0".join(t.as_buffer() for t in texts)
            letters, begin, end = cut(raw)
            word, first = group(letters, begin, end, digest)
            last = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            row = np.searchsorted(last, begin, side="right")
            wide = max(1, len(first))
            cells, n = np.unique(row * wide + word, return_counts=True)  # documents by words
            place, which = np.unique(of_row[cells // wide] * wide + cells % wide, return_inverse=True)
            total = np.bincount(which, n, len(place)).astype(np.int64)
            docs = np.bincount(which, minlength=len(place))
            which_group, which_word = place // wide, first[place % wide] if len(first) else place
            sizes = (end - begin)[which_word] if len(first) else which_word
            spelled = letters[ranges(begin[which_word], sizes)] if len(first) else letters[:0]
            blank = len(groups)  # every group once more without a word, so that it occurs
            at = np.concatenate([[0], np.cumsum(sizes), np.full(blank, sizes.sum())]).astype(np.int32)
            term = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(spelled.tobytes()))
            whose = groups[np.concatenate([which_group, np.arange(blank)]).astype(np.int64)]
            none = np.zeros(blank, np.int64)
            cols = [
                lang.dictionary.take(pa.array(whose // len(source.dictionary))),
                source.dictionary.take(pa.array(whose % len(source.dictionary))),
                term,
                pa.array(np.concatenate([total, none])),
                pa.array(np.concatenate([docs, none]).astype(np.int64)),
            ]
            out = pa.RecordBatch.from_arrays(cols, schema=kind)
            for lo in range(0, out.num_rows, 65_536):
                yield out.slice(lo, 65_536)

    return scan


def weights(count: np.ndarray, among: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / among) in two steps, exact in 64 bits for ``among`` up to 10**14."""
    first = (count + 1) * 31_250
    return 1 + first // among * 32_000 + first % among * 32_000 // among


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _bucket(terms: pa.Table, sources: pa.Table) -> list[tuple[str, np.ndarray, pa.Array, np.ndarray]]:
    """(part, source number, item, value) of one bucket; sources by number as in ``sources``."""
    names = sources.column("source").combine_chunks()
    n_sources, v = len(names), sources.column("v")[0].as_py()
    among = sources.column("total").to_numpy() + v
    asked = np.flatnonzero(sources.column("asked").to_numpy(zero_copy_only=False))
    if not terms.num_rows:
        g, h = np.nonzero(np.arange(n_sources)[:, None] != asked[None, :])
        return [("pair", g, pc.take(names, pa.array(asked[h])), np.zeros(len(g), np.int64))]
    src = pc.index_in(terms.column("source").combine_chunks(), names).to_numpy()
    words = pc.unique(terms.column("term").combine_chunks())
    words = words.take(pc.sort_indices(words))
    col, count = pc.index_in(terms.column("term").combine_chunks(), words).to_numpy(), terms.column("n").to_numpy()
    order = np.lexsort((col, src))
    src, col, count = src[order], col[order], count[order]
    bounds = np.searchsorted(src, np.arange(n_sources + 1))
    held = np.flatnonzero(np.diff(bounds))
    p, p0 = weights(count, among[src]), weights(np.zeros(n_sources, np.int64), among)
    value = np.zeros((n_sources, len(asked)), np.int64)
    for j, h in enumerate(asked.tolist()):
        own = slice(bounds[h], bounds[h + 1])
        q = np.full(len(words), p0[h])
        q[col[own]] = p[own]
        more = divergence(p, q[col]) - divergence(p0[src], q[col])  # over what the source would have without the word
        value[held, j] = np.add.reduceat(more, bounds[held])
        kinds, often = np.unique(p[own], return_counts=True)
        value[:, j] += (divergence(p0[:, None], kinds[None, :]) * often).sum(1)
        value[:, j] += (len(words) - (own.stop - own.start)) * divergence(p0, p0[h])
    g, h = np.nonzero(np.arange(n_sources)[:, None] != asked[None, :])
    out = [("pair", g, pc.take(names, pa.array(asked[h])), value[g, h])]
    if asked[0] == 0:
        language = np.zeros(len(words), np.int64)
        np.add.at(language, col, count)
        q = weights(language, np.int64(sources.column("lang_total")[0].as_py() + v))[col]
        up = np.flatnonzero(p > q)
        f = divergence(p[up], q[up])
        up, f = (x[np.lexsort((col[up], -f, src[up]))] for x in (up, f))
        start = np.searchsorted(src[up], src[up])
        top = np.arange(len(up)) - start < TOP
        out.append(("term", src[up][top], pc.take(words, pa.array(col[up][top])), f[top]))
    return out


def audit(docs: DataFrame, least: int = 3, scratch: Scratch | None = None, rows: int = ROWS, digest=None) -> DataFrame:
    """lang, source, part, item, value, rank of every group of ``docs``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    found = docs.select(*blank).mapInArrow(_counts(digest), "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    found = found.withColumns({"of_all": F.sum("docs").over(word), "first": F.row_number().over(word.orderBy("source")) == 1})
    kept = scratch.put(found.where((F.col("term") == "") | (F.col("of_all") >= least)).select("lang", "source", "term", "n", "first"))

    a_word = F.col("term") != ""
    totals = scratch.put(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(a_word).alias("entries"), F.count_if(a_word & F.col("first")).alias("v")))
    per_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("v"), F.count("*").alias("n_sources"), F.sum("entries").alias("entries"))
    per_lang = per_lang.selectExpr("lang", "lang_total", "v", f"cast(greatest(1, ceil(entries / {rows})) as int) buckets", f"cast(ceil(n_sources / {BLOCK}) as int) blocks")
    per_lang = small(scratch.put(per_lang))

    left = kept.where(a_word).join(per_lang, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    left = left.select("lang", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "term", "n")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    right = totals.drop("v").withColumn("number", number).join(per_lang, "lang")
    right = right.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("lang", "bucket", "block", "source", "number", "total", "lang_total", "v", F.expr(f"number div {BLOCK} = block").alias("asked"))

    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def compare(key, terms: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.sort_by("number")
        names, parts = sources.column("source").combine_chunks(), []
        for part, s, item, value in _bucket(terms, sources):
            n = len(value)
            parts.append(pa.table([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), n), pc.take(names, pa.array(s)), pa.repeat(pa.scalar(part), n), item, pa.array(value)], schema=kind))
        return pa.concat_tables(parts)

    keys = ("lang", "bucket", "block")
    done = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "lang string, source string, part string, item string, value long")
    done = scratch.put(done)
    pairs = done.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = done.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).union(terms)


def query(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM groups g LEFT JOIN (SELECT c.* FROM counts c SEMI JOIN kept k ON c.lang = k.lang AND c.term = k.term) c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
weighed AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v))::HUGEINT AS p,
 (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v))::HUGEINT AS q
 FROM sums s JOIN kept k ON s.lang = k.lang JOIN langs l ON l.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN weighed x ON x.lang = a.lang AND x.source = a.source LEFT JOIN weighed y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM weighed WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
