"""Removal of long repeated strings by two-stage suffix sorting.

``repeated_bytes`` removes every byte that is covered by a ``span``-byte string (UTF-8 bytes) that
also starts anywhere else, in another text or in the same one; overlaps count, and all strings are
judged on the input. Matches never cross texts.

A suffix array of the whole corpus is not needed to decide this. Every window of ``span`` bytes is
named by its minimizer, the 64-byte gram of least hash in it (leftmost of equals). Equal windows
have equal minimizers, so they can be told apart within the windows of one minimizer:

1. One text pass cuts each text into runs of windows that have the same minimizer occurrence, and
   keeps of each run only its place, the minimizer's hash and a hash of the run's bytes.
2. Minimizers that occur once are dropped. Runs of equal bytes under one minimizer are repeats as a
   whole; this takes care of exact copies, however many, without moving text. One of each such
   group goes on, and only where its minimizer also has other runs.
3. The bytes of the runs that go on are dealt by minimizer. Each task packs whole minimizers into
   blocks of a few MB and builds a suffix array for each block in two stages: only the suffixes that
   are smaller than their successors are sorted directly, eight bytes at a time among those still
   equal; the rest are induced by scanning the buckets of the first byte in order. Adjacent suffixes with a common
   prefix of ``span`` bytes then mark the repeated windows.
4. Marked windows are joined to the texts, which lose the covered bytes.

A minimizer with more than ``hot`` different runs is not put into one block. Its windows are told
apart by two independent 64-bit hashes of their bytes in a plain count, which is spread over all
tasks; nothing is capped.

Null and short texts lose nothing; a null doc_id is kept. Rows that repeat doc_id and text are
copies like any others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _kernel as K
from strandline.llm._spark import Scratch, bit_table, small, table

GRAM = 64
#: Bytes of a block of runs that is sorted at once, and of a stretch that the sort skips where it is equal.
BLOCK = 1 << 19
FAR = 64
_NONE = -(2**63)
_U = np.uint64


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, span: int, sums: np.ndarray, gram: int = GRAM):
    """Runs of windows with one minimizer occurrence: (row, first window, past window, minimizer position)."""
    width, n = span - gram + 1, len(data)
    z = np.empty(0, np.int64)
    if n < span:
        return z, z, z, z
    grams = K.span_hash(sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
    key = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(key) % width
    tiles = np.concatenate((key, np.full(pad, 2**64 - 1, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - span + 1
    at = (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & _U(0xFFFFFFFF)).astype(np.int64)
    good = np.zeros(m + 1, np.int32)
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= span)
    good[offsets[long]] += 1
    np.add.at(good, offsets[long + 1] - span + 1, -1)
    good = np.cumsum(good)[:m] > 0
    edge = np.ones(m, bool)
    edge[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
    edge[offsets[long]] = True
    first = np.flatnonzero(edge)
    past = np.append(first[1:], m)
    keep = good[first]
    first, past = first[keep], past[keep]
    return np.searchsorted(offsets, first, "right") - 1, first, past, at[first]


def _blocks(text: np.ndarray, reach: int) -> np.ndarray:
    """The eight bytes at every place as one number that orders like them; zeros follow the text."""
    padded = np.zeros(reach + 8, np.uint8)
    padded[: len(text)] = text
    out = np.zeros(reach, np.uint64)
    for j in range(8):
        out = (out << _U(8)) | padded[j : j + reach]
    return out


def _unequal(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each group of neighbours, whether its values differ."""
    out = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    out[group[1:][(values[1:] != values[:-1]) & (group[1:] == group[:-1])]] = True
    return out


def _sorted_directly(starts: np.ndarray, blocks: np.ndarray, far: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """``starts`` in order of the ``span`` bytes at them, compared eight by eight among those still equal. ``far`` and ``whole``
    hash the next ``FAR`` and ``span`` bytes of every place: groups that agree in them need no look at these bytes."""
    order = starts[np.argsort(blocks[starts], kind="stable")]
    head = np.ones(len(order), bool)
    head[1:] = blocks[order[1:]] != blocks[order[:-1]]
    at = np.arange(len(order))  # places in groups that may still differ
    for depth in range(8, span, FAR):
        group = np.cumsum(head[at]) - 1
        on = _unequal(whole[order[at]], group)[group]
        at, group = at[on], group[on]
        if not len(at):
            break
        group = np.cumsum(head[at]) - 1
        on = _unequal(far[order[at] + depth], group)[group]
        part, own = at[on], group[on]
        for d in range(depth, min(depth + FAR, span), 8):
            if not len(part):
                break
            own = np.cumsum(head[part]) - 1
            block = blocks[order[part] + d]
            on = _unequal(block, own)[own]
            if on.any():
                i, b, g = part[on], block[on], own[on]
                o = np.lexsort((b, g))
                order[i], b = order[i][o], b[o]
                head[i[1:]] |= b[1:] != b[:-1]
                own = np.cumsum(head[part]) - 1
                on = np.bincount(own)[own] > 1
                part = part[on]
    return order


def two_stage(text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array to a depth of ``span`` bytes, whether each suffix shares ``span`` bytes with the one before it).

    ``span`` is at least 8. Zero bytes are taken to follow the text; the empty suffix is the smallest.
    """
    n = len(text)
    blocks = _blocks(text, n + span + FAR)
    # smaller than its successor: the next different byte is larger; the last suffix is larger than the empty one
    differs = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(differs, np.arange(n))
    rising = np.zeros(n, bool)
    has = nxt < len(differs)
    at = differs[nxt[has]]
    rising[has] = text[at + 1] > text[at]
    # stage one: only these are sorted
    group = np.flatnonzero(rising)
    sums = K.prefix_hash(np.concatenate((text, np.zeros(span + 2 * FAR, np.uint8))))
    every = np.arange(n + span + FAR)
    far, whole = K.span_hash(sums, every, every + FAR), K.span_hash(sums, every[:n], every[:n] + span)
    order = _sorted_directly(group, blocks, far, whole, span)
    del sums, every, far, whole
    # stage two: bucket scans induce the others
    total = np.bincount(text, minlength=256)
    up = np.bincount(text[group], minlength=256)
    start = np.cumsum(total) - total
    sa = np.empty(n, np.int64)
    split = start + total - up
    seen = np.cumsum(up) - up
    for c in np.flatnonzero(up):
        sa[split[c] : start[c] + total[c]] = order[seen[c] : seen[c] + up[c]]
    head = start.copy()
    if n:
        sa[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1

    def place(of):
        prev = of - 1
        prev = prev[prev >= 0]
        prev = prev[~rising[prev]]
        if not len(prev):
            return
        ch = text[prev]
        o = np.argsort(ch, kind="stable")
        prev, ch = prev[o], ch[o]
        cut = np.flatnonzero(np.concatenate(([True], ch[1:] != ch[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            d = ch[a]
            sa[head[d] : head[d] + b - a] = prev[a:b]
            head[d] += b - a

    for c in np.flatnonzero(total):
        done = start[c]
        while done < head[c]:  # runs of one byte fill their own bucket as it is read
            part, done = (done, head[c]), head[c]
            place(sa[part[0] : part[1]])
        place(sa[split[c] : start[c] + total[c]])
    equal = np.zeros(n, bool)
    near = np.arange(1, n)
    for offset in [*range(0, span - 8, 8), span - 8]:
        near = near[blocks[sa[near] + offset] == blocks[sa[near - 1] + offset]]
    equal[near] = True
    return sa, equal


def repeated_starts(text: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """Which of the ``valid`` starts have a string of ``span`` bytes that another valid start also has."""
    sa, equal = two_stage(text, span)
    kind = np.cumsum(~equal) - 1
    ok = valid[sa]
    many = np.bincount(kind[ok], minlength=kind[-1] + 1 if len(kind) else 0) > 1
    out = np.zeros(len(text), bool)
    out[sa] = ok & many[kind]
    return out


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


_ROW = "doc_id long, fp long"


def _runs(docs: DataFrame, span: int) -> DataFrame:
    def scan(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, data, offs in K.slices(b.column(1)):
                sums = K.prefix_hash(data)
                row, first, past, at = minimizer_runs(data, offs, span, sums)
                if not len(row):
                    continue
                fp = K.signed(K.span_hash(sums, offs[:-1], offs[1:]))
                mh = K.signed(K.span_hash(sums, at, at + GRAM))
                body = K.signed(K.span_hash(sums, first, past + span - 1))
                base = offs[row]
                cols = [pa.array(ids[lo + row]), pa.array(fp[row]), pa.array(first - base), pa.array(past - base), pa.array(mh), pa.array(body)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "a", "b", "mh", "body"])

    return docs.mapInArrow(scan, _ROW + ", a long, b long, mh long, body long")


def _only(docs: DataFrame, wanted: DataFrame):
    """A function of True or False, to doc_id, fp, text of the rows that a Bloom filter of fixed size (8 MB) over ``wanted``
    (doc_id, fp) lets pass, or of all others; and its broadcast."""
    bits = 1 << 26

    def cells(fp: np.ndarray) -> np.ndarray:
        h = K.mix(fp.view(np.uint64) ^ _U(0x7F4A7C15))
        return np.stack([(h >> _U(s)).astype(np.int64) & (bits - 1) for s in (0, 19, 38)])

    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select("fp").distinct(), "fp", 26, cells))

    def rows(hits: bool) -> DataFrame:
        def scan(batches):
            bloom = shared.value
            for b in batches:
                fp = np.empty(b.num_rows, np.uint64)
                for lo, hi, data, offs in K.slices(b.column(1)):
                    fp[lo:hi] = K.span_hash(K.prefix_hash(data), offs[:-1], offs[1:])
                fp = fp.view(np.int64)
                pas = np.ones(len(fp), bool)
                for at in cells(fp):
                    pas &= (bloom[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) > 0
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(1)], ["doc_id", "fp", "text"]).filter(pa.array(pas == hits))
                if out.num_rows:
                    yield out

        return docs.mapInArrow(scan, _ROW + ", text string")

    return rows, shared


def _cut(batches, span: int):
    """Output rows of (doc_id, fp, text, starts: list of {a, b})."""
    for b in batches:
        raw, offs = K.raw_text(b.column(2))
        lists = b.column(3)
        at, n = lists.offsets.to_numpy(), np.diff(offs)
        a, z = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        removed, spans, sha = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), []
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(n)):
            body = raw[offs[i] : offs[i + 1]]
            if valid[i] and at[i + 1] > at[i]:
                d = np.zeros(n[i] + 1, np.int64)
                np.add.at(d, a[at[i] : at[i + 1]], 1)
                np.add.at(d, z[at[i] : at[i + 1]] - 1 + span, -1)
                gone = np.cumsum(d)[:-1] > 0
                removed[i], spans[i] = gone.sum(), len(_spans(gone)[0])
                body = body[~gone]
            sha.append(hashlib.sha256(body.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(removed), pa.array(spans), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_windows(docs: DataFrame, scratch: Scratch, span: int, hot: int) -> DataFrame:
    """(doc_id, fp, a, b): ranges of window starts whose strings occur more than once; may overlap."""
    every = scratch.put(_runs(docs, span))
    kinds = every.groupBy("mh").agg(F.count("*").alias("n"), F.min("body").alias("lo"), F.max("body").alias("hi")).where("n > 1").selectExpr("mh", "lo <> hi mixed")
    # both written: a join alone, without an aggregate beside it, can be split where one minimizer has very many runs
    kinds = scratch.put(kinds)
    runs = scratch.put(every.join(kinds, "mh"))
    scratch.drop(every, kinds)
    groups = runs.groupBy("mh", "body").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "fp", "a", "b")).alias("r"), F.first("mixed").alias("mixed"))
    groups = scratch.put(groups)
    whole = runs.join(groups.where("copies > 1").select("mh", "body"), ["mh", "body"]).select("doc_id", "fp", "a", "b")
    rest = groups.where("mixed")
    big = scratch.put(rest.groupBy("mh").agg(F.count("*").alias("kinds")).where(f"kinds > {hot}").selectExpr("mh", "true hot"))
    rest = scratch.put(rest.join(small(big), "mh", "left").selectExpr("mh", "copies", "r.doc_id", "r.fp", "r.a", "r.b", "coalesce(hot, false) hot"))
    spots = rest.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("a", "b", "mh", "copies", "hot")).alias("spots"))
    rows, shared = _only(docs, rest)
    found = rows(True).join(spots, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"]).select("doc_id", "fp", "text", "spots")

    def bodies(batches):
        for b in batches:
            raw, offs = K.raw_text(b.column(2))
            at = b.column(3).offsets.to_numpy()
            a, z, mh, copies, hot_ = (b.column(3).values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            cold = np.flatnonzero(~hot_[at[0] : at[-1]].astype(bool)) + at[0]
            for part in range(0, len(cold), 2000):
                i = cold[part : part + 2000]
                r = row[i - at[0]]
                text = pa.array([raw[offs[x] + s : offs[x] + e - 1 + span].tobytes() for x, s, e in zip(r, a[i], z[i])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(mh[i]), pa.array(copies[i] == 1), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(a[i]), pa.array(z[i]), text], ["mh", "single", "doc_id", "fp", "a", "b", "body"])

    def windows(batches):
        for b in batches:
            at = b.column(3).offsets.to_numpy()
            a, z, mh, _, hot_ = (b.column(3).values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            raw, offs = K.raw_text(b.column(2))
            for x in range(b.num_rows):
                i = [j for j in range(at[x], at[x + 1]) if hot_[j]]
                if not i:
                    continue
                body = raw[offs[x] : offs[x + 1]]
                one, two = K.prefix_hash(body), K.prefix_hash(body ^ np.uint8(0xA5))
                p = np.concatenate([np.arange(a[j], z[j]) for j in i])
                m = np.repeat(mh[i], z[i] - a[i])
                cols = [pa.array(m), pa.array(K.signed(K.span_hash(one, p, p + span))), pa.array(K.signed(K.span_hash(two, p, p + span))), b.column(0).take(pa.array(np.full(len(p), x))), b.column(1).take(pa.array(np.full(len(p), x))), pa.array(p)]
                yield pa.RecordBatch.from_arrays(cols, ["mh", "h1", "h2", "doc_id", "fp", "a"])

    def sort_blocks(batches):
        held, size, last = [], 0, None
        for b in batches:
            for mh, single, doc, fp, a, z, body in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BLOCK and mh != last:
                    yield from sort_block(held)
                    held, size = [], 0
                held.append((single, doc, fp, a, z, body))
                size, last = size + len(body), mh
        if held:
            yield from sort_block(held)

    def sort_block(held):
        text = np.frombuffer(b"".join(x[5] for x in held), np.uint8)
        edge = np.cumsum([0] + [len(x[5]) for x in held])
        count = np.array([x[4] - x[3] for x in held])
        d = np.zeros(len(text) + 1, np.int8)
        d[edge[:-1]] += 1
        d[edge[:-1] + count] -= 1
        flags = repeated_starts(text, np.cumsum(d)[:-1] > 0, span)
        lo, hi = _spans(flags)
        own = np.searchsorted(edge, lo, "right") - 1
        keep = np.array([held[i][0] for i in own], bool) if len(own) else np.zeros(0, bool)
        lo, hi, own = lo[keep], hi[keep], own[keep]
        start = np.array([x[3] for x in held], np.int64)
        cols = [pa.array([held[i][1] for i in own], pa.int64()), pa.array([held[i][2] for i in own], pa.int64()), pa.array(start[own] + lo - edge[own]), pa.array(start[own] + hi - edge[own])]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "a", "b"])

    kind = _ROW + ", a long, b long"
    found = scratch.put(found, [shared])
    dealt = found.mapInArrow(bodies, "mh long, single boolean, doc_id long, fp long, a long, b long, body binary").repartition("mh").sortWithinPartitions("mh")
    marked = dealt.mapInArrow(sort_blocks, kind)
    hot_windows = found.where("exists(spots, s -> s.hot)").mapInArrow(windows, "mh long, h1 long, h2 long, doc_id long, fp long, a long")
    twice = hot_windows.groupBy("mh", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    hot_marked = hot_windows.join(twice, ["mh", "h1", "h2"], "left_semi").selectExpr("doc_id", "fp", "a", "a + 1 b")
    out = scratch.put(whole.union(marked).union(hot_marked))
    scratch.drop(runs, groups, big, rest, found)
    return out


def repeated_bytes(docs: DataFrame, span: int = 400, hot: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text); ``span`` is at least a gram."""
    if span < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes")
    scratch = Scratch(docs.sparkSession)
    docs = docs.selectExpr(f"coalesce(cast(doc_id as bigint), {_NONE}) doc_id", "coalesce(text, '') text")
    marked = repeated_windows(docs, scratch, span, hot)
    ranges = marked.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    empty = F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("starts")
    rows, _ = _only(docs, marked)
    with_cuts = rows(True).join(ranges, ["doc_id", "fp"], "left").select("doc_id", "fp", "text", "starts")
    without = rows(False).select("doc_id", "fp", "text", empty)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = with_cuts.union(without).mapInArrow(lambda batches: _cut(batches, span), kind)
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {_NONE})"))


def query(spark, sf_dir):
    # the decision as a column too: 1 where anything is removed
    return repeated_bytes(table(spark, sf_dir, "documents")).selectExpr("*", "cast(n_removed > 0 as int) repeats")


#: All windows of 400 bytes (800 hexadecimal digits) by their MD5.
ORACLE_SQL = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents), t AS (SELECT doc_id, h, length(h) // 2 n FROM h),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) i FROM t WHERE n >= 400)),
hot AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
starts AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END new FROM win SEMI JOIN hot USING (k)),
runs AS (SELECT doc_id, min(i) a, max(i) + 400 z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) run FROM starts) GROUP BY doc_id, run),
pieces AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) b FROM runs),
cut AS (SELECT doc_id, count(*) k, sum(z - a)::BIGINT gone, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) left_hex FROM pieces JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(left_hex, h))) AS kept_sha256, CASE WHEN gone > 0 THEN 1 ELSE 0 END AS repeats FROM t LEFT JOIN cut USING (doc_id)"""
