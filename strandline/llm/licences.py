"""Licence scan with a generalised suffix automaton of template words.

The words of all templates build one suffix automaton. A text streams through it: at every word the
automaton gives the longest suffix read so far that occurs in some template (the matching
statistics). Matches that cannot be extended are chained, template by template: in order in both
text and template, with at most ``gap`` words between neighbours. A chain that covers at least
``cover`` of its template (and ``least`` words) adds the template's label; ``score`` is the largest
covered share of any template, 1 where a base phrase stands. Base phrases are places where their
words stand consecutively; they are never changed by the method.

A word that no template has resets the automaton, so only runs of template words are streamed, and
those are found vectorised. Words are told apart by a 64-bit hash. Null and empty texts have no
words, labels '' and score 0; a null doc_id is kept. Rows that repeat an id or a text are scanned one by
one. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import _kernel as K
from strandline.llm._spark import table
from strandline.llm.templates import PHRASES, TEMPLATES

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,past:int,cover:double>>"


def word_hashes(text: str) -> np.ndarray:
    data = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = K.words(data, np.array([0, len(data)]), K.PUNCT)
    return K.span_hash(K.prefix_hash(data), s, e)


class Automaton:
    """Suffix automaton of several word sequences; each state keeps where its longest string ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[tuple[int, int]]] = [set()]
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, own)
                own[last].add((t, i))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            own[self.link[v]] |= own[v]
        self.ends = [sorted(x) for x in own]

    def _new(self, length, nexts, link, own) -> int:
        self.length.append(length)
        self.next.append(nexts)
        self.link.append(link)
        own.append(set())
        return len(self.length) - 1

    def _split(self, p, c, q, own) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], own)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last, c, own) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q, own)
        cur = self._new(self.length[last] + 1, {}, 0, own)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, own)
        return cur

    def matches(self, ids):
        """(end, length, state) of every match that the next word does not extend."""
        v = size = 0
        out = []
        for i, c in enumerate(ids):
            before = (i - 1, size, v)
            while v and c not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                size += 1
            if before[1] and size <= before[1]:
                out.append(before)
        if size:
            out.append((len(ids) - 1, size, v))
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = 3, gap: int = 8, cover: float = 0.8):
        self.labels = [label for label, _ in templates]
        seqs = [word_hashes(text) for _, text in templates]
        self.phrases = [(word_hashes(p), label) for p, label in phrases]
        self.vocabulary = np.unique(np.concatenate(seqs + [h for h, _ in self.phrases]))
        ids = [np.searchsorted(self.vocabulary, s).tolist() for s in seqs]
        self.sizes = [len(x) for x in ids]
        self.least, self.gap, self.cover = least, gap, cover
        self.automaton = Automaton(ids)
        self.base = [(np.searchsorted(self.vocabulary, h), label) for h, label in self.phrases]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no template has."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def chains(self, runs):
        """(template, first word, past word, covered share) of the chains over matches of one text's ``runs`` of (start, ids)."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for start, ids in runs:
            for end, size, v in self.automaton.matches(ids):
                for t, e in self.automaton.ends[v]:
                    # short matches count where they are most of a short template or next to others
                    if size >= min(self.least, self.sizes[t]):
                        hits.setdefault(t, []).append((start + end - size + 1, e - size + 1, size))
        out = []
        for t, found in hits.items():
            found = sorted(set(found))
            best: list[tuple[int, int]] = []  # covered words, first match of the chain
            for i, (d, p, n) in enumerate(found):
                top = (n, i)
                j = i - 1
                while j >= 0 and d - found[j][0] <= self.sizes[t] + self.gap:
                    d0, p0, n0 = found[j]
                    if d0 + n0 <= d <= d0 + n0 + self.gap and p0 + n0 <= p <= p0 + n0 + self.gap:
                        top = max(top, (best[j][0] + n, best[j][1]), key=lambda x: (x[0], -x[1]))
                    j -= 1
                best.append(top)
            for (d, _, n), (got, first) in zip(found, best):
                out.append((t, found[first][0], d + n, got / self.sizes[t]))
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """For each row of a slice: words, base starts by label, and its chains."""
        data = K.LOWER[data]
        s, e, rows = K.words(data, offsets, K.PUNCT)
        ids = self.ids(K.span_hash(K.prefix_hash(data), s, e))
        n_rows = len(offsets) - 1
        count = np.bincount(rows, minlength=n_rows)
        first = np.cumsum(count) - count
        base = []
        for seq, label in self.base:
            n = len(ids) - len(seq) + 1
            if n <= 0:
                continue
            ok = rows[len(seq) - 1 :] == rows[:n]
            for j, c in enumerate(seq):
                ok &= ids[j : n + j] == c
            at = np.flatnonzero(ok)
            base += [(int(rows[i]), int(i - first[rows[i]]), label) for i in at]
        known = ids >= 0
        edge = np.concatenate(([True], (known[1:] != known[:-1]) | (rows[1:] != rows[:-1]), [True])) if len(ids) else np.array([True])
        cut = np.flatnonzero(edge)
        runs: dict[int, list] = {}
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= self.least and known[a]:
                runs.setdefault(int(rows[a]), []).append((int(a - first[rows[a]]), ids[a:b].tolist()))
        return count, base, {row: self.chains(found) for row, found in runs.items()}


def scan_licences(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): base phrases, labels, score and the covered template spans."""
    scanner = scanner or Scanner()

    def scan(batches):
        for b in batches:
            for lo, hi, data, offs in K.slices(b.column(1)):
                count, base, chains = scanner.scan(data, offs)
                n = hi - lo
                n_base, firsts, lasts = [0] * n, [None] * n, [None] * n
                base_labels, labels, score, spans = [set() for _ in range(n)], [set() for _ in range(n)], [0.0] * n, [[] for _ in range(n)]
                for row, at, label in base:
                    n_base[row] += 1
                    firsts[row] = at if firsts[row] is None else min(firsts[row], at)
                    lasts[row] = at if lasts[row] is None else max(lasts[row], at)
                    base_labels[row].add(label)
                    score[row] = 1.0
                for row, found in chains.items():
                    for t, a, z, share in found:
                        score[row] = max(score[row], min(1.0, share))
                        if share >= scanner.cover:
                            labels[row].add(scanner.labels[t])
                            spans[row].append({"label": scanner.labels[t], "start": a, "past": z, "cover": share})
                join = [",".join(sorted(x)) for x in base_labels]
                both = [",".join(sorted(x | y)) for x, y in zip(base_labels, labels)]
                cols = [b.column(0).slice(lo, n), pa.array(count, pa.int64()), pa.array(n_base, pa.int64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(join, pa.string()), pa.array(both, pa.string()), pa.array(score, pa.float64())]
                cols.append(pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("past", pa.int32()), ("cover", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(scan, SCHEMA)


def query(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents")).drop("spans")
