"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items are turned into the same templates: numbers, names and units become typed
placeholders, other words are lower-cased (letters of any script) without outer punctuation, and
runs of one placeholder collapse. Capitals alone do not tell names, so each side is read in three
ways: names are capitalised words that do not open a sentence (``MARKED``), all capitalised words
(``CAPITALS``: names that open sentences), or no words (``PLAIN``: copies in another case). Windows
of ``window`` template words that hold at least half literal words are hashed and hash-joined with
those of the benchmark read in the same way. Matches are grouped by document, item, reading and
alignment (difference of template positions), and the
placeholders of a group must be filled consistently: one value of the item always meets one value
of the document. A group with an inconsistent filling loses the windows that hold the odd values.
A document is a leak of an item when, in any reading, its surviving windows cover at least ``need``
windows of it (or all, if it has fewer); the reading that covers the largest share gives n_windows,
item_windows and renamed. Where the case of a copy is changed and its names are replaced too, only
its windows without names can match. A template whose literals agree and whose slots are consistently renamed
is thereby caught, as is an exact copy, whose slots agree trivially.

Items without such windows, since they are short or mostly slots, are read word by word without any
placeholder (``EXACT``): their windows have ``window`` words, or all words of a shorter item. An item of
fewer than ``least`` words is evidence only where it is a document's whole text (``WHOLE``). An exact copy
is thus found of every item that has a word, but a re-parameterised one only of items with windows.

The benchmark may be of any size: its window hashes fill a bit table of fixed size, which lets a
text pass emit windows that may match; the Spark join with the benchmark's windows is exact on the
64-bit hash and decides. Nulls and texts without words match nothing, nor do such items, nor rows with a
null id. Repeated ids are taken together. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _kernel as K
from strandline.llm._spark import Scratch, bit_table, table, without

WINDOW = 8
NEED = 6
LEAST = 5
BITS = 24

#: Units that follow or end a number. Fixed list of plain unit names.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml l s ms sec min h hr hrs hours minutes seconds days weeks months years percent % usd eur dollars euros cents kmh mph w kw v a hz khz mhz ghz kb mb gb tb c f k".split()

#: Readings: which capitalised words are names. The salts keep windows of different readings apart.
MARKED, CAPITALS, PLAIN, EXACT, WHOLE = range(5)
_SALT = K.WORD_MULT[58:63]

NUM, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INNER = np.zeros(256, bool)  # bytes of a word proper: letters, digits, non-ASCII
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = _INNER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 59, 63, 10]] = True


#: Lower case of the characters of two and of three UTF-8 bytes whose lower case has as many.
_FOLD = np.arange(1 << 16, dtype=np.uint16)
for _c in range(128, 1 << 16):
    _l = chr(_c).lower()
    if len(_l) == 1 and (_c < 2048) == (ord(_l) < 2048) and 128 <= ord(_l) < 1 << 16:
        _FOLD[_c] = ord(_l)
#: Bytes of a character by its first byte.
_SIZE = np.ones(256, np.int64)
_SIZE[0xC2:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:0xF5] = 2, 3, 4


def fold(data: np.ndarray) -> np.ndarray:
    """The bytes in lower case; every character keeps its place and length."""
    low = K.LOWER[data]
    for n in (2, 3):
        at = np.flatnonzero(_SIZE[data] == n) if (data >= 0xC2).any() else np.empty(0, np.int64)
        at = at[at + n <= len(data)]
        if not len(at):
            continue
        c = data[at].astype(np.int64) & (0x1F if n == 2 else 0x0F)
        for j in range(1, n):
            c = c << 6 | data[at + j] & 0x3F
        new = _FOLD[c].astype(np.int64)
        at, new = at[new != c], new[new != c]
        for j in range(n - 1, 0, -1):
            low[at + j] = 0x80 | new & 0x3F
            new >>= 6
        low[at] = (0xC0 if n == 2 else 0xE0) | new
    return low


def _unit_hashes() -> np.ndarray:
    out = [K.span_hash(K.prefix_hash(np.frombuffer(u.encode(), np.uint8)), np.array([0]), np.array([len(u)]))[0] for u in UNITS if u != "%"]
    return np.sort(np.array(out, np.uint64))


_UNIT_HASHES = _unit_hashes()


def parse(data: np.ndarray, offsets: np.ndarray):
    """(row, token, first byte, past byte, capital, opens a sentence, word) of the words of a slice; of numbers and units the
    token is NUM or UNIT, the word a hash like that of others."""
    z = np.empty(0, np.int64)
    none = z, z.view(np.uint64), z, z, z > 0, z > 0, z.view(np.uint64)
    s, e, rows = K.words(data, offsets, K.SPACES)
    if not len(s):
        return none
    # drop outer punctuation; words of nothing else vanish
    inner = np.flatnonzero(_INNER[data])
    if not len(inner):
        return none
    a = np.searchsorted(inner, s)
    b = np.searchsorted(inner, e) - 1
    has = b >= a
    closes = _STOP[data[e - 1]]
    opens = np.ones(len(s), bool)
    opens[1:] = (rows[1:] != rows[:-1]) | closes[:-1]
    # a line break before the word opens a sentence as well
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    opens[1:] |= lines[s[1:]] != lines[e[:-1]]
    a, b, rows, opens = a[has], b[has], rows[has], opens[has]
    s, e = inner[a], inner[b] + 1
    low = fold(data)
    token = K.span_hash(K.prefix_hash(low), s, e)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    number = digits[e] > digits[s]
    at = np.searchsorted(_UNIT_HASHES, token)
    at[at == len(_UNIT_HASHES)] = 0
    unit = (_UNIT_HASHES[at] == token) & np.concatenate(([False], number[:-1])) & (np.concatenate(([-1], rows[:-1])) == rows)
    changed = np.concatenate(([0], np.cumsum(low != data)))
    capital = changed[np.minimum(s + _SIZE[data[s]], len(data))] > changed[s]
    return rows, np.where(number, NUM, np.where(unit, UNIT, token)), s, e, capital & ~number & ~unit, opens, token


def read(words: tuple, how: int):
    """(row, token, first byte, past byte) of the template words of parsed words in one reading; runs of one placeholder collapse."""
    rows, token, s, e, capital, opens, _ = words
    if not len(rows):
        return rows, token, s, e
    if how != PLAIN:
        token = np.where(capital & ~opens if how == MARKED else capital, NAME, token)
    slot = (token == NUM) | (token == UNIT) | (token == NAME)
    keep = np.ones(len(token), bool)
    keep[1:] = ~(slot[1:] & (token[1:] == token[:-1]) & (rows[1:] == rows[:-1]))
    first = np.flatnonzero(keep)
    last = np.append(first[1:], len(token)) - 1
    return rows[first], token[first], s[first], e[last]


def template(data: np.ndarray, offsets: np.ndarray, how: int = MARKED):
    """(row, token, first byte, past byte) of the template words of a slice; placeholders are NUM, NAME and UNIT."""
    return read(parse(data, offsets), how)


def windows(rows: np.ndarray, token: np.ndarray, n_rows: int, window: int):
    """(first template word, hash) of the windows with at least half literal words."""
    n = len(token) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    literal = np.concatenate(([0], np.cumsum((token != NUM) & (token != NAME) & (token != UNIT))))
    ok = (rows[window - 1 :] == rows[:n]) & (2 * (literal[window:] - literal[:n]) >= window)
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for j in range(window):
        h += token[at + j] * K.WORD_MULT[j]
    return at, K.mix(h)


def exact_windows(rows: np.ndarray, word: np.ndarray, n_rows: int, sizes) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all stretches of each of ``sizes`` words."""
    ats, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for size in sizes:
        n = len(word) - size + 1
        if n > 0:
            at = np.flatnonzero(rows[size - 1 :] == rows[:n])
            h = np.full(len(at), size, np.uint64)
            for j in range(size):
                h += word[at + j] * K.WORD_MULT[j]
            ats.append(at)
            hashes.append(K.mix(h))
    return np.concatenate(ats), np.concatenate(hashes)


def _exact_rows(window: int, least: int, sizes=None):
    """A function of (row, word) arrays and the number of rows to (reading, first word, hash): of items (``sizes`` None) their
    own windows, of documents the windows of ``sizes`` words; rows of fewer than ``least`` words as a whole."""

    def find(rows, word, n_rows):
        count = np.bincount(rows, minlength=n_rows)
        own = np.minimum(count, window)[rows]
        few = count[rows] < least
        at, h = [], []
        for size in range(1, least):  # whole texts
            i, g = exact_windows(rows, word, n_rows, [size])
            ok = few[i] & (own[i] == size)
            at.append(i[ok])
            h.append(g[ok] ^ _SALT[WHOLE])
        n_whole = sum(map(len, at))
        for size in range(least, window + 1) if sizes is None else sizes:
            i, g = exact_windows(rows, word, n_rows, [size])
            ok = own[i] == size if sizes is None else np.ones(len(i), bool)
            at.append(i[ok])
            h.append(g[ok] ^ _SALT[EXACT])
        at, h = np.concatenate(at), np.concatenate(h)
        return np.where(np.arange(len(at)) < n_whole, WHOLE, EXACT).astype(np.int32), at, h

    return find


_KIND = "id long, how int, pos int, h long, slots array<struct<at:int,value:string>>"
_SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())]))


def _window_rows(window: int, bits=None, exact=None, templates: bool = True):
    """A scan of (id, text) to windows with their slot values; ``bits`` holds back windows that cannot match. ``exact`` finds
    windows without placeholders as well, or alone without ``templates``."""

    def scan(batches):
        table_ = bits.value if bits is not None else None

        def may(h):
            cell = (h >> np.uint64(64 - BITS)).astype(np.int64)
            return (table_[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0

        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in K.slices(b.column(1)):
                parsed = parse(data, offs)
                if exact is not None and len(parsed[0]):
                    rows, word = parsed[0], parsed[6]
                    how, at, h = exact(rows, word, hi - lo)
                    if table_ is not None:
                        hit = may(h)
                        how, at, h = how[hit], at[hit], h[hit]
                    first = np.searchsorted(rows, np.arange(hi - lo))
                    r = rows[at]
                    cols = [ids.take(pa.array(lo + r)), pa.array(how), pa.array((at - first[r]).astype(np.int32)), pa.array(K.signed(h)), pa.array([[]] * len(at), _SLOTS)]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "how", "pos", "h", "slots"])
                if not templates:
                    continue
                for how in (MARKED, CAPITALS, PLAIN):
                    rows, token, s, e = read(parsed, how)
                    at, h = windows(rows, token, hi - lo, window)
                    h = h ^ _SALT[how]
                    if table_ is not None and len(at):
                        hit = may(h)
                        at, h = at[hit], h[hit]
                    if not len(at):
                        continue
                    first = np.searchsorted(rows, np.arange(hi - lo))
                    slots = []
                    for i in at.tolist():
                        slots.append([{"at": int(j - i), "value": bytes(data[s[j] : e[j]]).decode("utf-8", "replace").lower()} for j in range(i, i + window) if token[j] in (NUM, NAME, UNIT)])
                    r = rows[at]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(lo + r)), pa.array(np.full(len(at), how, np.int32)), pa.array((at - first[r]).astype(np.int32)), pa.array(K.signed(h)), pa.array(slots, _SLOTS)],
                        ["id", "how", "pos", "h", "slots"],
                    )

    return scan


def _lengths(window: int):
    """A scan of (id, text) to the texts' numbers of words, ``window`` at most."""

    def scan(batches):
        for b in batches:
            for lo, hi, data, offs in K.slices(b.column(1)):
                n = np.unique(np.minimum(np.bincount(parse(data, offs)[0], minlength=hi - lo), window))
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32))], ["n"])

    return scan


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, need: int = NEED, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, renamed of every document that holds a benchmark item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.selectExpr("cast(doc_id as bigint) id", "text").where("id is not null")
    bench = benchmark.selectExpr("cast(item_id as bigint) id", "text").where("id is not null")
    items = scratch.put(bench.mapInArrow(_window_rows(window), _KIND).distinct())
    rest = bench.join(items.select("id").distinct(), "id", "left_anti")
    rest = scratch.put(rest.mapInArrow(_window_rows(window, exact=_exact_rows(window, least), templates=False), _KIND).distinct())
    exact = None
    if not rest.isEmpty():
        # at most window - least + 1 lengths
        lengths = bench.join(rest.where(f"how = {EXACT}").select("id").distinct(), "id", "left_semi").mapInArrow(_lengths(window), "n int").distinct()
        exact = _exact_rows(window, least, sorted(r[0] for r in lengths.collect() if r[0] >= least))
        items = items.union(rest)
    shared = bit_table(items, "h", BITS, lambda h: (h.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64))
    bits = spark.sparkContext.broadcast(shared.view(np.uint8))  # 2 MB at any size
    found = docs.mapInArrow(_window_rows(window, bits, exact), _KIND)
    hits = found.join(items.selectExpr("id item", "how", "pos ipos", "h", "slots islots"), ["h", "how"])
    hits = scratch.put(hits.selectExpr("id", "item", "how", "pos - ipos shift", "ipos", "slots", "islots").distinct(), [bits])
    # slots of one alignment, each with the value that most of its places agree on
    group = ["id", "item", "how", "shift"]
    slots = hits.selectExpr(*group, "ipos", "explode(arrays_zip(slots, islots)) z").selectExpr(*group, "ipos", "z.islots.value was", "z.slots.value now")
    votes = slots.groupBy(*group, "was", "now").agg(F.count("*").alias("n"))
    chosen = votes.groupBy(*group, "was").agg(F.max(F.struct("n", "now")).alias("top")).selectExpr(*group, "was", "top.now now")
    odd = slots.join(chosen.withColumnRenamed("now", "kept"), [*group, "was"]).groupBy(*group, "ipos").agg(F.max(F.expr("now <> kept")).alias("odd"), F.max(F.expr("was <> now")).alias("renamed"))
    good = hits.select(*group, "ipos").join(odd, [*group, "ipos"], "left").where("not coalesce(odd, false)")
    size = items.groupBy(F.col("id").alias("item"), "how").agg(F.countDistinct("pos").alias("item_windows"))
    out = good.groupBy("id", "item", "how").agg(F.countDistinct("ipos").alias("n_windows"), F.max(F.expr("coalesce(renamed, false)")).alias("renamed"))
    out = out.join(size, ["item", "how"]).where(f"n_windows >= least({need}, item_windows)")
    best = F.max(F.struct(F.expr("n_windows / item_windows"), F.expr("not renamed"), "n_windows", "item_windows", "renamed")).alias("best")
    return out.groupBy("id", "item").agg(best).selectExpr("id doc_id", "item item_id", "best.n_windows", "best.item_windows", "best.renamed")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id stay."""
    return without(docs, leaks(docs, benchmark, **options).select("doc_id"), Scratch(docs.sparkSession))


def query(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
