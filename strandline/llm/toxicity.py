"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of ``P`` bytes of two strings, each weighted by ``DECAY`` to
the power of the span it takes in both, and is normalised. Gaps and inserted characters lower it
gradually, so "i.d.i.o.t" or "wor-thless" stay near the words they hide.

A text is read as units: words without outer punctuation, spelled-out words (runs of single
characters), both of these also without what breaks them up, overlapping windows of whichever of
these is longer than ``WIDTH`` bytes, short stretches of spelled-out runs (which may hold many
words), and the first bytes of longer words (stems). Training takes a sample of at most ``SAMPLE``
labelled rows, in order of a hash of doc_id;
both are parameters of ``fit``:

1. Words of labelled sentences are counted by class over distinct neighbourhoods (word before, word
   after), so copied text counts once. Words and stems whose neighbourhoods are toxic beyond chance
   are positive examples, with gapped variants; the most frequent other words, and of all other words
   those that resemble a positive one, are negative.
2. Landmarks are every family of positive units (those that begin alike), however many there are,
   and at least LANDMARKS // 2 negative ones; the kernel matrix of the landmarks gives the Nyström
   features, and a linear SVM (squared hinge) is trained on them.
3. The two largest unit margins of each sampled document, the numbers of weak, middling and strong
   ones and the number of units feed a logistic curve, which turns margins into a score.

Scoring is one pass over whole texts without shuffle; a task evaluates each different unit once. A
unit gets kernels only if a subsequence of at least ``SHARE`` of a toxic landmark's bytes occurs in it (bit-parallel); other
units have the margin -1. Null and empty texts have no units and get the score of a text without toxic units. A
null doc_id is scored but never trained on. Without labels of both classes every score is 0.
Repeated ids and other columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _kernel as K
from strandline.llm._spark import Scratch, lean, table

#: Labelled rows that a fit takes at most. All words of theirs that belong to a toxic family or resemble one are examples.
SAMPLE = 10_000
#: Of words that neither belong to a toxic family nor resemble one, whose margin is -1 without the model, so many frequent
#: ones are examples too.
PLAIN = 8_000
P = 3
DECAY = 0.75
WIDTH = 24
STEM = 8
SPELLED = range(5, STEM + 1)
SHARE = 0.75
LANDMARKS = 48
FOLDS = 5
#: Margins that a task remembers (16 bytes each); beyond that it starts anew.
REMEMBERED = 1 << 19

#: Bytes of a character by its first byte.
_SIZE = np.ones(256, np.int64)
_SIZE[0xC2:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:0xF5] = 2, 3, 4
_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[97:123] = _INNER[128:] = True


def pieces(rows: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, length) of the first WIDTH bytes of spans, and of the overlapping windows after them."""
    out = [(rows, s, np.minimum(n, WIDTH))]
    more = np.arange(len(n))
    for at in range(WIDTH // 2, int(n.max(initial=0)), WIDTH // 2):
        more = more[n[more] > at + WIDTH // 2]
        if not len(more):
            break
        out.append((rows[more], s[more] + at, np.minimum(n[more] - at, WIDTH)))
    return out


def inside(data: np.ndarray, rows: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, length) of every stretch of ``SPELLED`` characters of spans without word boundaries."""
    out = []
    for row, x, y in zip(rows.tolist(), s.tolist(), (s + n).tolist()):
        edge = np.append(x + np.flatnonzero(data[x:y] & 0xC0 != 0x80), y)
        for k in SPELLED:
            size = edge[k:] - edge[:-k]
            out.append((np.full(len(size), row), edge[:-k], np.minimum(size, WIDTH)))
    return out


def units(data: np.ndarray, offsets: np.ndarray):
    """(bytes, row, start, length, hash) of the units of a slice of lower-cased bytes; the bytes are the slice's, and after
    them those of broken-up units without what breaks them up."""
    z = np.empty(0, np.int64)
    s, e, rows = K.words(data, offsets, K.SPACES)
    inner = np.flatnonzero(_INNER[data])
    if not len(s) or not len(inner):
        return data, z, z, z, z.view(np.uint64)
    a, b = np.searchsorted(inner, s), np.searchsorted(inner, e) - 1
    has = b >= a
    s, e, rows = inner[a[has]], inner[b[has]] + 1, rows[has]
    n = e - s
    broken = np.flatnonzero((n - (b[has] - a[has] + 1) >= 2) & (b[has] - a[has] + 1 >= P))
    whole = [(rows[broken], s[broken], e[broken])]
    parts = pieces(rows, s, n)
    long = n > STEM
    parts.append((rows[long], s[long], np.full(int(long.sum()), STEM)))
    single = np.flatnonzero(n == _SIZE[data[s]])  # one character, of however many bytes
    if len(single) > 2:
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(single) > 1) | (rows[single[1:]] != rows[single[:-1]]), [True])))
        runs = [(single[x], single[y - 1]) for x, y in zip(cut[:-1], cut[1:]) if y - x >= P]
        if runs:
            f, l = np.array(runs).T
            parts += pieces(rows[f], s[f], e[l] - s[f])
            whole.append((rows[f], s[f], e[l]))
    r, s, e = (np.concatenate(x) for x in zip(*whole))
    if len(r):
        kept = [data[x:y][_INNER[data[x:y]]] for x, y in zip(s.tolist(), e.tolist())]
        size = np.array([len(x) for x in kept])
        at = len(data) + np.cumsum(size) - size
        parts += pieces(r, at, size)
        data = np.concatenate([data, *kept])
        parts += inside(data, *(x[len(broken) :] for x in (r, at, size)))
    r, s, n = (np.concatenate(x) for x in zip(*parts))
    keep = n >= P
    r, s, n = r[keep], s[keep], n[keep]
    return data, r, s, n, K.span_hash(K.prefix_hash(data), s, s + n)


def codes(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Units as rows of bytes, zero after their end."""
    at = s[:, None] + np.arange(WIDTH)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.arange(WIDTH) >= n[:, None]] = 0
    return out


def as_codes(strings: list[bytes]) -> np.ndarray:
    out = np.zeros((len(strings), WIDTH), np.uint8)
    for i, x in enumerate(strings):
        out[i, : min(len(x), WIDTH)] = np.frombuffer(x[:WIDTH], np.uint8)
    return out


def _raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of P bytes of every row of a with the same row of b (or its only row)."""
    n, la = len(a), int((a > 0).sum(1).max(initial=0))
    lb = int((b > 0).sum(1).max(initial=0))
    lam = np.float32(DECAY)
    same = [[((a[:, i] == b[:, j]) & (a[:, i] > 0)).astype(np.float32) for j in range(lb)] for i in range(la)]
    total = np.zeros(n, np.float32)
    prev = None  # prev[i][j]: weight of subsequences of q - 1 bytes in a[:i], b[:j], counted to the ends
    for q in range(1, P + 1):
        now = [[np.zeros(n, np.float32) for _ in range(lb + 1)] for _ in range(la + 1)] if q < P else None
        for i in range(1, la + 1):
            row = np.zeros(n, np.float32)
            for j in range(1, lb + 1):
                hit = same[i - 1][j - 1] if prev is None else same[i - 1][j - 1] * prev[i - 1][j - 1]
                hit = hit * (lam * lam)
                if q == P:
                    total += hit
                else:
                    row = lam * row + hit
                    now[i][j] = lam * now[i - 1][j] + row
        prev = now
    return total


def _all_kernels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_raw_kernel`` of every row of a with every row of b."""
    la, lb = (int((x > 0).sum(1).max(initial=0)) for x in (a, b))
    lam = np.float32(DECAY)
    out = np.zeros((len(a), len(b)), np.float32)
    if not la or not lb:
        return out
    step = max(1, (1 << 20) // (la * lb * len(b)))
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        shape = (len(part), len(b))
        same = [[((part[:, i, None] == b[None, :, j]) & (part[:, i, None] > 0)).astype(np.float32) for j in range(lb)] for i in range(la)]
        prev = None
        for q in range(1, P + 1):
            now = [[np.zeros(shape, np.float32) for _ in range(lb + 1)] for _ in range(la + 1)] if q < P else None
            for i in range(q, la + 1):
                row = np.zeros(shape, np.float32)
                for j in range(1, lb + 1):
                    hit = same[i - 1][j - 1] if prev is None else same[i - 1][j - 1] * prev[i - 1][j - 1]
                    hit = hit * (lam * lam)
                    if q == P:
                        out[lo : lo + step] += hit
                    else:
                        row = lam * row + hit
                        now[i][j] = lam * now[i - 1][j] + row
            prev = now
    return out


#: Units and landmarks are handled in groups of like length, so that little is padded.
_GROUPS = (5, 6, 8, 12, 16, WIDTH)


def _groups(size: np.ndarray):
    low = -1
    for n in _GROUPS:
        at = np.flatnonzero((size > low) & (size <= n))
        low = n
        if len(at):
            yield n, at


def _letters(c: np.ndarray) -> np.ndarray:
    """The bytes that occur in each row, folded to 64 bits."""
    bit = np.where(c > 0, np.uint64(1) << (c & 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bit, axis=1) if c.shape[1] else np.zeros(len(c), np.uint64)


class Model:
    def __init__(self, landmarks: list[bytes], toxic: int, share: float = SHARE):
        """The first ``toxic`` landmarks are toxic ones."""
        self.marks = as_codes(landmarks)
        self.toxic, self.share = toxic, share
        self.norm = np.sqrt(np.maximum(_raw_kernel(self.marks, self.marks), 1e-12))
        self.alpha = np.zeros(len(landmarks), np.float32)
        self.bias, self.curve = -1.0, np.array([-9.0] + [0.0] * 7)

    def kernels(self, c: np.ndarray) -> np.ndarray:
        out = np.zeros((len(c), len(self.marks)), np.float32)
        marks = [(self.marks[j, :n], j) for n, j in _groups((self.marks > 0).sum(1))]
        for n, at in _groups((c > 0).sum(1)):
            part = c[at, :n]
            own = np.concatenate([_raw_kernel(part[lo : lo + 4096], part[lo : lo + 4096]) for lo in range(0, len(part), 4096)])
            own = np.sqrt(np.maximum(own, 1e-12))
            for mark, j in marks:
                out[at[:, None], j] = _all_kernels(part, mark) / own[:, None] / self.norm[j]
        return out

    def may_be(self, c: np.ndarray) -> np.ndarray:
        """Which units share a subsequence of at least ``share`` of a toxic landmark: bit-parallel longest common subsequence."""
        out = np.zeros(len(c), bool)
        for n, at in _groups((c > 0).sum(1)):
            part = c[at, :n]
            letters, found = _letters(part), np.zeros(len(at), bool)
            for mark in self.marks[: self.toxic]:
                size = int((mark > 0).sum())
                if not size:
                    continue
                need = int(np.ceil(self.share * size))
                if need > n:
                    continue
                # cheap first: a subsequence of so many bytes has most of the landmark's letters
                own = _letters(mark[None])[0]
                left = np.flatnonzero(~found & (np.bitwise_count(letters & own) >= max(1, int(np.bitwise_count(own)) - (size - need))))
                if not len(left):
                    continue
                masks = np.zeros(256, np.uint32)
                for j in range(size):
                    masks[mark[j]] |= np.uint32(1 << j)
                masks[0] = 0
                m = masks[part[left]]
                full = np.uint32((1 << size) - 1)
                v = np.full(len(left), full, np.uint32)
                for i in range(n):
                    x = v & m[:, i]
                    v = (v + x) | (v - x)
                found[left[size - np.bitwise_count(v & full) >= need]] = True
            out[at] = found
        return out

    def margins(self, c: np.ndarray) -> np.ndarray:
        out = np.full(len(c), -1.0, np.float32)
        if self.alpha.any():
            at = np.flatnonzero(self.may_be(c))
            if len(at):
                out[at] = np.maximum(self.kernels(c[at]) @ self.alpha + self.bias, -1)
        return out

    def features(self, data: np.ndarray, offsets: np.ndarray, seen: "Seen | None" = None) -> np.ndarray:
        """Of each row of a slice: largest and second largest margin, logs of the numbers of units of weak,
        middling and strong margin, the number of strong ones up to two, and the log of the number of all
        units, which counts only without two strong ones. ``seen`` remembers margins from slice to slice."""
        n = len(offsets) - 1
        out = np.zeros((n, 7))
        out[:, :2] = -1
        data, r, s, size, h = units(data, offsets)
        if len(r):
            f = (Seen() if seen is None else seen).margins(self, data, s, size, h)
            at = np.flatnonzero(f > -1)
            at = at[np.lexsort((-f[at], r[at]))]
            rows, start = np.unique(r[at], return_index=True)
            out[rows, 0] = f[at[start]]
            second = start + 1
            ok = second < np.append(start[1:], len(at))
            out[rows[ok], 1] = f[at[second[ok]]]
            for i, (lo, hi) in enumerate(((0, 1), (1, 3), (3, np.inf))):
                out[:, 2 + i] = np.log1p(np.bincount(r[(f > lo) & (f <= hi)], minlength=n))
            out[:, 5] = np.minimum(np.round(np.expm1(out[:, 4])), 2)
            out[:, 6] = np.where(out[:, 5] < 2, np.log1p(np.bincount(r, minlength=n)), 0)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)))


class Seen:
    """Margins of the units that a task has met, by hash."""

    def __init__(self):
        self.hashes, self.found = np.empty(0, np.uint64), np.empty(0, np.float32)

    def margins(self, model: Model, data: np.ndarray, s: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Margins of units, given their place in ``data`` and their hash."""
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == own if len(self.hashes) else np.zeros(len(own), bool)
        out = np.empty(len(own), np.float32)
        out[known] = self.found[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = model.margins(codes(data, s[first[new]], size[first[new]]))
            if len(self.hashes) + len(new) > REMEMBERED:
                self.hashes, self.found = self.hashes[:0], self.found[:0]
            both = np.concatenate((self.hashes, own[new]))
            order = np.argsort(both, kind="stable")
            self.hashes, self.found = both[order], np.concatenate((self.found, out[new]))[order]
        return out[back]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60):
    """Linear SVM with squared hinge loss by Newton steps; returns weights and bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        g = ridge * w - (x[on] * (weight[on] * y[on] * slack[on])[:, None]).sum(0)
        h = ridge * np.eye(len(w)) + (x[on] * weight[on][:, None]).T @ x[on]
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of weighted rows with a small ridge, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.1 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def variants(word: bytes) -> list[bytes]:
    """Gapped forms of a positive example: one byte put in at each inner place, all places, or a doubled byte."""
    out = [word[:i] + b".-*_ "[i % 5 : i % 5 + 1] + word[i:] for i in range(1, len(word))]
    out += [c.join(word[i : i + 1] for i in range(len(word))) for c in (b".", b"-", b" ")]
    return out + [word[:i] + word[i - 1 : i] + word[i:] for i in range(1, len(word))]


#: Up to so many examples get their kernels on the driver, more in tasks.
ON_DRIVER = 2_000


def _kernels_in_tasks(spark, model: Model, examples: list[bytes]) -> np.ndarray:
    """Kernels of the examples with all landmarks."""
    if len(examples) <= ON_DRIVER:
        return model.kernels(as_codes(examples)).astype(np.float64)
    shared = spark.sparkContext.broadcast((model, examples))
    n = len(model.marks)

    def scan(batches):
        model, examples = shared.value
        for b in batches:
            at = b.column(0).to_pylist()
            found = model.kernels(as_codes([examples[i] for i in at]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), n).cast(pa.list_(pa.float32()))], ["i", "k"])

    got = spark.range(0, len(examples), 1, max(1, len(examples) // 1000)).mapInArrow(lean(scan), "i long, k array<float>").toArrow().sort_by("i")
    shared.destroy()
    return np.array(got.column("k").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, plain_words: int = PLAIN, share: float = SHARE) -> Model:
    """Train on at most ``sample`` rows of ``labels`` (doc_id, toxic) outside fold 0, half of them toxic where there are so many.
    Every word of the sample that belongs to a toxic family or resembles a landmark is an example, and ``plain_words`` others."""
    spark = docs.sparkSession
    usable = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic").where(f"doc_id is not null and toxic in (0, 1) and pmod(crc32(cast(cast(doc_id as string) as binary)), {folds}) <> 0")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = []
    for kind in (1, 0):
        picked += usable.where(f"toxic = {kind}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2 if kind else sample - len(picked)).collect()
    known = {r[0]: r[1] for r in picked}
    if len(set(known.values())) < 2:
        return Model([b"..."], 0)
    ids = np.array(sorted(known), np.int64)
    kinds = np.array([known[i] for i in ids.tolist()], np.int8)
    shared = spark.sparkContext.broadcast((ids, kinds))

    def chosen(batches):
        ids, kinds = shared.value
        for b in batches:
            own = b.column(0).fill_null(ids[0] - 1).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            hit = ids[at] == own
            if hit.any():
                yield kinds[at[hit]], b.filter(pa.array(hit))

    def count(batches):
        for kinds, b in chosen(batches):
            for lo, hi, data, offs in K.slices(b.column(1)):
                data = K.LOWER[data]
                s, e, rows = K.words(data, offs, K.SPACES)
                inner = np.flatnonzero(_INNER[data])
                if not len(s) or not len(inner):
                    continue
                h = K.span_hash(K.prefix_hash(data), s, e)
                edge = rows[1:] != rows[:-1]
                before, after = np.concatenate(([0], h[:-1])).astype(np.uint64), np.concatenate((h[1:], [0])).astype(np.uint64)
                before[1:][edge] = 0
                after[:-1][edge] = 0
                around = K.mix(before * K.WORD_MULT[0] + after * K.WORD_MULT[1])
                a, z = np.searchsorted(inner, s), np.searchsorted(inner, e) - 1
                ok = z >= a
                s, e, rows, around = inner[a[ok]], inner[z[ok]] + 1, rows[ok], around[ok]
                ok = (e - s >= P) & (e - s <= WIDTH)
                s, e, rows, around = s[ok], e[ok], rows[ok], around[ok]
                raw = data.tobytes()
                words = [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(kinds[lo + rows], pa.int8()), pa.array(K.signed(around))], ["word", "toxic", "around"])

    base = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    seen = base.mapInArrow(lean(count), "word binary, toxic tinyint, around long").distinct()
    per_word = seen.groupBy("word").agg(F.sum("toxic").cast("long").alias("t"), F.count("*").alias("n"))
    stems = per_word.selectExpr("explode(transform(filter(array(4, 5, 6, 7, 8), k -> k < octet_length(word)), k -> substring(word, 1, k))) unit", "t", "n").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds >= 3")
    every = per_word.selectExpr("word unit", "t", "n", "1L kinds").union(stems).groupBy("unit").agg(F.max("t").alias("t"), F.max("n").alias("n"))
    scratch = Scratch(spark)
    per_word = scratch.put(per_word)
    every = scratch.put(every)
    t_all, n_all, v_all = every.agg(F.sum("t"), F.sum("n"), F.count("*")).first()
    if not t_all or t_all == n_all:
        return Model([b"..."], 0)
    rate = t_all / n_all
    # log likelihood ratio against the common rate, beyond what so many units reach by chance, and nearly pure
    gain = f"t * ln(t / (n * {rate}D)) + if(n > t, (n - t) * ln((n - t) / (n * {1 - rate}D)), 0)"
    positive = every.where(f"t >= 4 and (n - t) <= 0.15 * t * {(1 - rate) / rate}D and n <= 2 * t").withColumn("gain", F.expr(gain)).where(f"gain > {np.log(v_all) + 2}")
    positive = positive.withColumn("rank", F.expr(f"gain * pow((t / n - {rate}D) / {1 - rate}D, 3)"))
    top = [bytes(r["unit"]) for r in positive.orderBy(F.desc("rank"), "unit").collect()]
    if not top:
        return Model([b"..."], 0)
    marks: list[bytes] = []  # of units that begin alike, the one that explains most and is purest
    for u in top:
        if not any(u.startswith(m) or m.startswith(u) for m in marks):
            marks.append(u)
    stem = f"exists(array({', '.join(f"unhex('{m.hex()}')" for m in marks)}), m -> startswith(word, m))"
    family = per_word.where(f"({stem}) and t > 0").orderBy(F.desc("t"), "word").collect()  # of the sample
    good = [bytes(r["word"]) for r in family]
    others = per_word.where(f"n > t and not ({stem})")
    plain = [bytes(r[0]) for r in others.orderBy(F.desc(F.expr("n - t")), "word").limit(max(plain_words, LANDMARKS)).collect()]
    model = Model(marks + plain[: max(LANDMARKS - len(marks), LANDMARKS // 2)], len(marks), share)
    early = spark.sparkContext.broadcast(model)

    def resembling(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            hit = early.value.may_be(as_codes(words))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit))], ["word"])

    alike = others.select("word").mapInArrow(lean(resembling), "word binary").orderBy("word").collect()  # of the sample
    early.destroy()
    near = [bytes(r[0]) for r in alike]
    negative = list(dict.fromkeys(plain[:plain_words] + near + [x[:STEM] for x in near if len(x) > STEM]))
    bad = list(dict.fromkeys(marks + good + [g[:STEM] for g in good if len(g) > STEM] + [v for m in marks for v in variants(m)]))
    negative = [x for x in negative if not any(x.startswith(m) for m in marks)]
    x = _kernels_in_tasks(spark, model, bad + negative)
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(negative))])
    weight = np.where(y > 0, 1 / max(len(bad), 1), 1 / max(len(negative), 1)) * 100
    # members of a toxic family that clean text has too count on both sides, by their neighbourhoods
    mixed = [(r["word"], (r["n"] - r["t"]) * rate / (1 - rate) / r["t"]) for r in family if r["n"] > r["t"]]
    if mixed:
        place = {w: i for i, w in enumerate(bad)}
        at = np.array([place[bytes(w)] for w, _ in mixed])
        x, y = np.vstack([x, x[at]]), np.concatenate([y, -np.ones(len(at))])
        weight = np.concatenate([weight, weight[at] * np.minimum(np.array([m for _, m in mixed]), 1)])
    val, vec = np.linalg.eigh(model.kernels(model.marks).astype(np.float64))
    keep = val > 1e-4 * val.max()
    nystrom = vec[:, keep] / np.sqrt(val[keep])
    w, model.bias = _svm(x @ nystrom, y, weight)
    model.alpha = (nystrom @ w).astype(np.float32)
    ready = spark.sparkContext.broadcast(model)

    def feature(batches):
        seen = Seen()
        for kinds, b in chosen(batches):
            for lo, hi, data, offs in K.slices(b.column(1)):
                f = ready.value.features(K.LOWER[data], offs, seen)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(f[:, i])) for i in range(7)), pa.array(kinds[lo:hi], pa.int8())], [*"abcdefg", "toxic"])

    # repeated ids may bring more rows than the sample has ids; equal feature rows are one row with its count
    got = base.mapInArrow(lean(feature), ", ".join(f"{c} double" for c in "abcdefg") + ", toxic tinyint").selectExpr(*(f"round({c}, 2) {c}" for c in "abcdefg"), "toxic").groupBy(*"abcdefg", "toxic").count().toArrow()
    values = np.stack([got.column(c).to_numpy() for c in "abcdefg"], axis=1) if got.num_rows else np.zeros((0, 7))
    model.curve = _curve(values, got.column("toxic").to_numpy().astype(float), got.column("count").to_numpy().astype(float))
    ready.destroy()
    shared.destroy()
    scratch.clear()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model, seen = shared.value, Seen()
        for b in batches:
            for lo, hi, data, offs in K.slices(b.column(1)):
                p = model.score(model.features(K.LOWER[data], offs, seen))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p)], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(lean(scan), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; no shuffle, other columns ride along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches):
        model, seen = shared.value, Seen()
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for lo, hi, data, offs in K.slices(b.column(at)):
                keep[lo:hi] = model.score(model.features(K.LOWER[data], offs, seen)) < threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(scan), docs.schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = f"pmod(crc32(cast(cast(doc_id as string) as binary)), {FOLDS}) = 0"
    return out.selectExpr("doc_id", f"coalesce({held}, false) held_out", "score", "if(score >= 0.5, 1, 0) predicted")
