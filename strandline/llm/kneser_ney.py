"""Quality by an interpolated modified Kneser-Ney model, in sharded count joins.

The model is over a text's symbols, in ``ORDER`` of up to four. With ``BYTES``, which the query takes,
they are the UTF-8 bytes as they stand: nothing is folded, and the tables grow with the corpus. With
``CLASSES`` they are 64 classes of bytes (capitals, digits, punctuation and non-ASCII bytes by class),
whose tables have at most 64**4 rows.

1. Trusted texts (label quality 1) are counted: every task adds up its n-grams, Spark sums them.
   All trusted rows count but those that are held out, so what is gathered follows the input.
2. Continuation counts, the three discounts of each order and the back-off weights come from joins
   of count tables on their n-grams and contexts.
3. The highest order is cut into shards by the context's first symbol. Slices of texts send their distinct n-grams
   to the shards, each with the texts that have it and how often; a shard streams them past its part of the table and
   answers with sums of log probabilities, which are added per text to its perplexity.
4. Trusted texts give a quantile of perplexity for each language; a document stays if its own does
   not exceed that of its language (or of all, for languages without trusted text). With ``folds``
   the trusted texts of fold 0 (by a hash of doc_id) are held out of the model, and the quantile is
   theirs; where there is none of them, that of all trusted texts.

Null and empty texts have no symbols: n_symbols 0, perplexity null, not kept. A null language is the
level "(none)". Rows that repeat a doc_id are scored one by one. Without trusted text nothing is
scored or kept. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _kernel as K
from strandline.llm._spark import Scratch, small, table

ORDER = 4
SHARDS = 4
QUANTILE = 0.99
FOLDS = 5
#: So many trusted ids (8 bytes each) are broadcast; more are joined.
BROADCAST_IDS = 2_000_000


class Symbols(NamedTuple):
    """The symbol of each byte, the bits that a symbol takes, and the one that stands before a text and is no byte's."""

    of: np.ndarray
    bits: int
    boundary: int


def _alphabet() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[:] = 62  # control bytes and the like
    out[97:123] = np.arange(26)
    out[65:91] = 26 + np.arange(26) // 9  # capitals: 26..28
    out[48:58] = 29
    out[32], out[10], out[9], out[13] = 30, 31, 30, 31
    for i, c in enumerate(b".,;:-'\"()"):
        out[c] = 32 + i
    for c in b"!?":
        out[c] = 41
    for c in b"#$%&*@":
        out[c] = 42
    for c in b"+=<>/\\|_~^`[]{}":
        out[c] = 43
    high = np.arange(128, 256)
    out[high] = 44 + high % 16  # 44..59
    return out


def _bytes() -> np.ndarray:
    """Every byte is a symbol of its own; frequent ones have neighbouring numbers, so that sorted keys differ little."""
    first = list(b" etaoinshrdlcumwfgypbvkjxqz.,'-")
    out = np.zeros(256, np.uint8)
    out[first + sorted(set(range(256)) - set(first))] = np.arange(256)
    return out


CLASSES = Symbols(_alphabet(), 6, 63)
#: No UTF-8 text has the byte 255.
BYTES = Symbols(_bytes(), 8, 255)


def grams(data: np.ndarray, offsets: np.ndarray, symbols: Symbols = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the ORDER-gram that ends at each symbol; three boundary symbols stand before a text."""
    sizes = np.diff(offsets)
    pad = ORDER - 1
    x = np.full(len(data) + pad * len(sizes), symbols.boundary, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data)) + pad * (row + 1)
    x[at] = symbols.of[data]
    key = np.zeros(len(at), np.int64)
    for j in range(ORDER):
        key = (key << symbols.bits) | x[at - pad + j]
    return row, key


def _count(docs: DataFrame, ids, symbols: Symbols) -> DataFrame:
    """(key, c) summed by task; ``ids`` (a broadcast sorted array) picks rows, None takes all."""

    def scan(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            k, c = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            u, back = np.unique(k, return_inverse=True)
            return [(u, np.bincount(back, c).astype(np.int64))]

        for b in batches:
            if ids is not None:
                own = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids.value, own), len(ids.value) - 1)
                hit = (ids.value[at] == own) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(hit))
            for _, _, data, offs in K.slices(b.column(1)):
                if len(data):
                    held.append(np.unique(grams(data, offs, symbols)[1], return_counts=True))
                    if len(held) > 16:
                        held[:] = fold()
        if held:
            k, c = fold()[0]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64())], ["key", "c"])

    return docs.mapInArrow(scan, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times."""
    n = {r[0]: r[1] for r in counts.where("c <= 4").groupBy("c").count().collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    low = [1 - 2 * y * n2 / n1, 2 - 3 * y * (n3 / n2), 3 - 4 * y * (n4 / n3) if n3 else 1.5]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(low))


def _order(counts: DataFrame, lower: DataFrame | None, bits: int) -> tuple[DataFrame, DataFrame]:
    """(key, ctx, p) and (ctx, gamma) of one order: interpolated with ``lower`` (key, p), or with the uniform law."""
    d1, d2, d3 = _discounts(counts)
    counts = counts.withColumn("ctx", F.expr(f"shiftright(key, {bits})"))
    ctx = counts.groupBy("ctx").agg(F.sum("c").alias("all"), F.expr(f"sum(case c when 1 then {d1}D when 2 then {d2}D else {d3}D end)").alias("cut"))
    ctx = ctx.selectExpr("ctx", "`all`", "cut / `all` gamma")
    seen = counts.join(ctx, "ctx").withColumn("own", F.expr(f"(c - case c when 1 then {d1}D when 2 then {d2}D else {d3}D end) / `all`"))
    if lower is None:
        seen = seen.withColumn("p", F.expr(f"own + gamma / {1 << bits}D"))
    else:
        shorter = lower.selectExpr("key low", "p q")
        # a lower order has every suffix of a seen n-gram
        seen = seen.withColumn("low", F.expr(f"key & {lower.mask}")).join(shorter, "low").withColumn("p", F.expr("own + gamma * q"))
    return seen.select("key", "ctx", "p"), ctx.select("ctx", "gamma")


class Model:
    """Probabilities and back-off weights by order, as tables: ``p[n]`` (key, ctx, p), ``gamma[n]`` (ctx, gamma)."""

    def __init__(self, counts: DataFrame, scratch: Scratch, symbols: Symbols = CLASSES):
        self.symbols = symbols
        by_order = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
            mask = (1 << (symbols.bits * n)) - 1
            by_order[n] = by_order[n + 1].groupBy(F.expr(f"key & {mask}").alias("key")).agg(F.count("*").alias("c"))
        self.p, self.gamma = {}, {}
        lower = None
        for n in range(1, ORDER + 1):
            c = scratch.put(by_order[n].select("key", "c"))
            p, g = _order(c, lower, symbols.bits)
            self.p[n], self.gamma[n] = scratch.put(p), scratch.put(g)
            lower = self.p[n]
            lower.mask = (1 << (symbols.bits * n)) - 1

    def low(self) -> tuple[np.ndarray, ...]:
        """What a shard backs off to: probabilities of all bigrams, weights of all bigram contexts (both dense), and the seen
        trigrams with their probabilities: at most 16 bytes for each group of three symbols, at any input size."""
        size = 1 << self.symbols.bits
        out = np.full(1, 1 / size)
        for n in range(1, ORDER - 1):
            p, g = self.p[n].select("key", "p").toArrow(), self.gamma[n].toArrow()
            gamma = np.ones(size ** (n - 1))
            gamma[g.column(0).to_numpy()] = g.column(1).to_numpy()
            out = np.repeat(gamma, size) * (out if n > 1 and len(out) == size**n else np.tile(out, size**n // len(out)))
            out[p.column(0).to_numpy()] = p.column(1).to_numpy()
        p, g = self.p[ORDER - 1].select("key", "p").toArrow(), self.gamma[ORDER - 1].toArrow()
        gamma = np.ones(size ** (ORDER - 2))
        gamma[g.column(0).to_numpy()] = g.column(1).to_numpy()
        key = p.column(0).to_numpy()
        order = np.argsort(key)
        return out, gamma, key[order], p.column(1).to_numpy()[order]


def varints(deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of seven bits, the last of each below 128; and the size of each."""
    size = 1 + (deltas >= 1 << 7) + (deltas >= 1 << 14) + (deltas >= 1 << 21) + (deltas >= 1 << 28)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        on = size > k
        out[ends[on] - size[on] + k] = ((deltas[on] >> (7 * k)) & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, size


def unvarints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``varints`` and the place of each one's last byte."""
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.empty(0, np.int64), ends
    start = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(start, ends - start + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), start), ends


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as varints in zstd; the size of the varints stands first."""
    raw = varints(numbers)[0].tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return unvarints(np.frombuffer(raw, np.uint8))[0]


def postings(data: np.ndarray, offsets: np.ndarray, symbols: Symbols):
    """(shard, keys, sizes, rows, counts) of a slice of texts, by shard: its distinct n-grams in order as differences, in how many
    texts each stands, and these texts (differences within an n-gram) with their counts. All are packed."""
    row, key = grams(data, offsets, symbols)
    if not len(row):
        return
    whole_bits, row_bits = ORDER * symbols.bits, len(offsets).bit_length()
    shard = (key >> whole_bits - symbols.bits) % SHARDS
    whole = (shard << whole_bits | key) << row_bits | row
    whole.sort()
    first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
    count = np.diff(np.append(first, len(whole)))
    whole = whole[first]
    cut = np.searchsorted(whole, np.arange(SHARDS + 1) << whole_bits + row_bits)
    for s, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if lo == hi:
            continue
        key, row = whole[lo:hi] >> row_bits & (1 << whole_bits) - 1, whole[lo:hi] & (1 << row_bits) - 1
        new = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(new)
        rows = np.where(new, row, np.diff(row, prepend=0))
        yield s, packed(np.diff(key[at], prepend=0)), packed(np.diff(np.append(at, hi - lo))), packed(rows), packed(count[lo:hi])


def unposted(keys: bytes, sizes: bytes, rows: bytes, counts: bytes) -> tuple[np.ndarray, ...]:
    """(distinct keys, place among them of each posting, its row, its count) of what ``postings`` gives for a shard."""
    size, step = unpacked(sizes), unpacked(rows)
    first = np.cumsum(size) - size
    total = np.cumsum(step)
    row = total - np.repeat(total[first] - step[first], size)
    return np.cumsum(unpacked(keys)), np.repeat(np.arange(len(size)), size), row, unpacked(counts)


def perplexity(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """rid, n, logp of every text of ``docs`` (rid, text).

    The n-grams of a slice of texts go to the shard of their first symbol together: each distinct one once, with the
    texts that have it. A shard looks up an n-gram once a slice.
    """
    spark = docs.sparkSession
    symbols, bits = model.symbols, model.symbols.bits
    tri, duo = (1 << (ORDER - 1) * bits) - 1, (1 << (ORDER - 2) * bits) - 1
    shorter = spark.sparkContext.broadcast(model.low())
    # slices are spread in turn over several groups a shard, each of which is a partition and gets the shard's table first
    spread = max(4, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS))

    def send(batches):
        turn = None
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, data, offs in K.slices(b.column(1)):
                turn = int(ids[lo]) % spread if turn is None else (turn + 1) % spread
                found = [(s * spread + turn, ids[lo:hi].tobytes(), *streams) for s, *streams in postings(data, offs, symbols)]
                if found:
                    cols = [pa.array(c, t) for c, t in zip(zip(*found), [pa.int32()] + [pa.binary()] * 5)]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "ids", "a", "b", "c", "d"])

    def pack(batches):
        parts: dict[int, list] = {}
        for b in batches:
            shard = b.column(0).to_numpy()
            for s in np.unique(shard).tolist():
                parts.setdefault(s, []).append([c.to_numpy()[shard == s] for c in b.columns[1:]])
        for s, held in parts.items():
            key, p, kind = (np.concatenate([h[i] for h in held]) for i in range(3))
            seen, back = kind == 1, kind == 0
            order, low = np.argsort(key[seen]), np.argsort(key[back])
            seen_k, back_k = key[seen][order], key[back][low]
            cols = [seen_k, p[seen][order], back_k, p[back][low]]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["shard", "a", "b", "c", "d"])

    of = f"cast(shiftright(ctx, {(ORDER - 2) * bits}) % {SHARDS} as int) shard"
    rows = model.p[ORDER].selectExpr(of, "key", "p", "1 kind").union(model.gamma[ORDER].selectExpr(of, "ctx key", "gamma p", "0 kind"))
    streams = "a binary, b binary, c binary, d binary"
    shards = scratch.put(rows.repartition(SHARDS, "shard").mapInArrow(pack, f"shard int, {streams}"))
    sent = docs.mapInArrow(send, f"part int, ids binary, {streams}").selectExpr("part", "1Y kind", "ids", "a", "b", "c", "d")
    tables = shards.selectExpr("shard", f"explode(sequence(0, {spread - 1})) salt", "a", "b", "c", "d").selectExpr(f"shard * {spread} + salt part", "0Y kind", "cast('' as binary) ids", "a", "b", "c", "d")

    def answer(batches):
        two, weight, threes, p3 = shorter.value
        keys, p, ctxs, gamma = (np.empty(0, t) for t in (np.int64, float, np.int64, float))

        def look(table, values, wanted, other):
            """The values of the wanted entries of a sorted table, and ``other(missing)`` for those it lacks."""
            at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
            hit = table[at] == wanted if len(table) else np.zeros(len(wanted), bool)
            out = np.empty(len(wanted))
            out[hit] = values[at[hit]]
            out[~hit] = other(wanted[~hit])
            return out

        def log_p(key):
            q3 = lambda k: look(threes, p3, k, lambda x: weight[x >> bits] * two[x & duo])
            backed = lambda k: look(ctxs, gamma, k >> bits, lambda x: np.ones(len(x))) * q3(k & tri)
            return np.log(look(keys, p, key, backed))

        for b in batches:
            for i, kind in enumerate(b.column(1).to_pylist()):
                ids, *raw = (c[i].as_py() for c in b.columns[2:])
                if kind == 0:
                    keys, p, ctxs, gamma = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.float64) * 2))
                    continue
                ids = np.frombuffer(ids, np.int64)
                distinct, at, row, count = unposted(*raw)
                n = np.bincount(row, count, len(ids)).astype(np.int64)
                logp = np.bincount(row, log_p(distinct)[at] * count, len(ids))
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n[has]), pa.array(logp[has])], ["rid", "n", "logp"])

    dealt = sent.unionByName(tables).repartitionById(SHARDS * spread, "part").sortWithinPartitions("kind")
    return dealt.mapInArrow(answer, "rid long, n long, logp double").groupBy("rid").agg(F.sum("n").alias("n"), F.sum("logp").alias("logp"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, folds: int = 0, broadcast_ids: int = BROADCAST_IDS, symbols: Symbols = CLASSES) -> DataFrame:
    """doc_id, lang, trusted, n_symbols, perplexity, limit and keep of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    held = f"pmod(crc32(cast(cast(doc_id as string) as binary)), {folds}) = 0" if folds else "false"
    trusted = labels.where("quality = 1 and doc_id is not null").selectExpr("cast(doc_id as bigint) doc_id").distinct()
    trusted = scratch.put(trusted.withColumn("held", F.expr(held)))
    base = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    n, n_held = trusted.agg(F.count("*"), F.count_if("held")).first()
    if n == 0:
        return docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(lang, '(none)') lang", "false trusted", "cast(coalesce(octet_length(text), 0) as bigint) n_symbols", "cast(null as double) perplexity", "cast(null as double) `limit`", "false keep")
    learned = trusted.where("not held") if n_held < n else trusted
    if n <= broadcast_ids:
        ids = spark.sparkContext.broadcast(np.sort(learned.select("doc_id").toArrow().column(0).to_numpy()))
        counts = scratch.put(_count(base, ids, symbols), [ids])
    else:
        counts = scratch.put(_count(base.join(learned, "doc_id", "left_semi"), None, symbols))
    model = Model(counts, scratch, symbols)
    # texts of one id are told apart by a hash, and equal rows share their answer
    rid = "xxhash64(doc_id, text)"
    found = scratch.put(docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(lang, '(none)') lang", f"{rid} rid"))
    texts = base.selectExpr(f"{rid} rid", "text")
    times = found.groupBy("rid").agg(F.count("*").alias("times"))
    scored = perplexity(texts, model, scratch).join(times, "rid").selectExpr("rid", "n div times n_symbols", "exp(-logp / n) perplexity")
    scored = scratch.put(found.join(scored, "rid", "left").join(trusted, "doc_id", "left").selectExpr("doc_id", "lang", "held is not null trusted", "coalesce(held, false) held", "n_symbols", "round(perplexity, 9) perplexity"))
    scratch.drop(found)
    known = scored.where("trusted and perplexity is not null")
    top = lambda of: F.percentile_approx(F.expr(f"if({of}, perplexity, null)"), quantile, 10_000)
    # one row a language: those of its held-out texts, or else of all its trusted ones
    limit = scratch.put(known.groupBy("lang").agg(F.coalesce(top("held"), top("true")).alias("own")))
    common = known.agg(F.coalesce(top("held"), top("true"))).first()[0]
    out = scored.join(small(limit), "lang", "left").withColumn("limit", F.coalesce("own", F.lit(common).cast("double")))
    return out.selectExpr("doc_id", "lang", "trusted", "coalesce(n_symbols, 0L) n_symbols", "perplexity", "`limit`", "coalesce(perplexity <= `limit`, false) keep")


def query(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=FOLDS, symbols=BYTES)
