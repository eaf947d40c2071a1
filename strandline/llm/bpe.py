"""Byte-pair token ids of whole texts by backtracking, and back to text by an offset table.

The merges of a tokenizer file (a parameter) make every token one string over 512 symbols: the 256 bytes, and the
256 bytes at a word's end. An Aho-Corasick automaton of these strings finds the longest token at every place of a word. The
encoder walks from the left, takes the longest token that its left neighbour tolerates, a shorter one where it does
not, and steps back where none is left; places that led nowhere are marked, so each is left once and the time is
linear in the word. Two neighbours tolerate each other if no merge that bridges them is due before the merges that
built them; a sequence whose neighbours all do is the one that merging in order gives. Verdicts on pairs are kept in a
table that fills as pairs are met.

Texts are split at the file's special tokens, which stay whole, then normalised and cut into words as the file says:
NFC, lower case by single characters, the file's pattern. Texts with characters whose Unicode data differ between
libraries, such as recently assigned ones, are normalised and cut by the tokenizer library itself.

Null and empty texts have no ids and decode to an empty text. A null doc_id is kept as null; repeated rows come out as often as
they came in; other columns, of any name, are not looked at. A word of any length is encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._spark import table

VOCABULARY = "word_bpe_49k.json"

#: Words and pairs that a worker keeps; the table starts anew beyond it, which changes no result.
KEPT = 1 << 18
#: Longer words are encoded each time.
KEPT_LENGTH = 64

#: Characters of scripts whose classes, case and composition no longer change from one Unicode version to the next.
SETTLED = ((0x0, 0x52F), (0x1E00, 0x1FFF), (0x2000, 0x2064), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x3000, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E))

_loaded: dict = {}


def _path(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = itertools.count(256)
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Spelling:
    """Strings by number: their bytes in one array, and where each begins."""

    def __init__(self, strings: list[bytes]):
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)])

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of ``ids`` in a row, and the end of each."""
        begin = self.at[ids]
        sizes = self.at[ids + 1] - begin
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)].tobytes(), ends


class Tokenizer:
    """Encoder and decoder of one tokenizer file: byte-level BPE, with or without a suffix at word ends."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or said.get("decoder"):
            raise ValueError("only byte-level BPE files without prefixes, byte fallback and decoder are read")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.end = 256 if suffix else 0
        spelled: dict[str, str] = {}
        for b, letter in enumerate(byte_letters()):
            spelled[letter] = chr(b)
            if suffix:
                spelled[letter + suffix] = chr(256 + b)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for order, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            spelled[a + b] = spelled[a] + spelled[b]
            self.halves[vocab[a + b]] = (vocab[a], vocab[b])
            self.merged[vocab[a], vocab[b]] = (order, vocab[a + b])
        self.order = {made: order for order, made in self.merged.values()}
        self.strings = {vocab[t]: s for t, s in spelled.items()}
        self.size = {i: len(s) for i, s in self.strings.items()}
        number = {s: i for i, s in self.strings.items()}
        self.shorter = {i: next((number[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in number), -1) for i, s in self.strings.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in number.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()

        added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said.get("added_tokens", [])):
            raise ValueError("added tokens must stand for themselves")
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        names = {i: t for t, i in (vocab | added).items()}
        self.spelling = Spelling([(names.get(i, "") + " ").encode() for i in range(max(names) + 1)])

        self.library = Library.from_file(path)
        steps = said["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in said["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[0]["behavior"] != "Removed":
            raise ValueError("only NFC, white space, lower case and one pattern of words are read")
        self.words_of = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.settled = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SETTLED) + "]*").fullmatch
        self.letters = {letter: b for b, letter in enumerate(byte_letters())}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def _bridged(self, a: int, b: int) -> bool:
        """Whether a merge across the border of ``a`` and ``b`` is due while its two halves stand there.

        Tokens that end at the border within ``a`` stand until their own merge takes them; of equal merges the left one is
        first, so within ``a`` the inner one wins, and within ``b`` the bridging one.
        """
        left, until_left = a, len(self.merged)
        while True:
            right, until_right = b, len(self.merged)
            while True:
                due = self.merged.get((left, right))
                if due and due[0] < until_left and due[0] <= until_right:
                    return True
                if right not in self.halves:
                    break
                until_right, right = self.order[right], self.halves[right][0]
            if left not in self.halves:
                return False
            until_left, left = self.order[left], self.halves[left][1]

    def _tolerated(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            found = self.pairs[key] = not self._bridged(a, b)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        symbols = word[:-1].decode("latin-1") + chr(self.end + word[-1])
        n = len(symbols)
        longest = [-1] * n
        for last, token in self.automaton.iter(symbols):
            longest[last + 1 - self.size[token]] = token  # later ends are longer
        ids: list[int] = []
        at, token, dead = 0, longest[0], bytearray(n + 1)
        while at < n:
            while token >= 0 and (dead[at + self.size[token]] or ids and not self._tolerated(ids[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                ids.append(token)
                at += self.size[token]
                token = longest[at] if at < n else -1
            else:
                if not ids:
                    raise ValueError("a symbol is not in the vocabulary")
                dead[at] = 1
                at -= self.size[ids[-1]]
                token = self.shorter[ids.pop()]
        return ids

    def _words(self, text: str):
        """The words of a text as they are looked up, and how to get their bytes."""
        if self.settled(text):
            text = unicodedata.normalize("NFC", text)
            return self.words_of("".join(map(str.lower, text)) if "Σ" in text else text.lower()), str.encode
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letters[c] for c in w) for w, _ in cut], bytes

    def encode(self, text: str) -> list[int]:
        if self.special and (marks := list(self.special.finditer(text))):
            ids, at = [], 0
            for m in marks:
                ids += self._plain(text[at : m.start()])
                ids.append(self.added[m[0]])
                at = m.end()
            return ids + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        words, to_bytes = self._words(text)
        known = self.known
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.encode_word(to_bytes(w))
                if len(w) <= KEPT_LENGTH:
                    if len(known) >= KEPT:
                        known.clear()
                    known[w] = found
            ids += found
        return ids

    def decode(self, ids: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> list[bytes]:
        """The text of every sequence of a batch: ``ids`` in a row, and the end of each sequence."""
        parts, bounds, before = [], [np.zeros(1, np.int64)], 0
        for lo in range(0, len(ids), step):
            part, ended = self.spelling.join(ids[lo : lo + step])
            parts.append(part)
            bounds.append(ended + before)
            before += len(part)
        whole, at = b"".join(parts), np.concatenate(bounds)
        stops = at[ends]
        starts = np.concatenate([[0], stops[:-1]])
        return [whole[a : max(a, b - 1)] for a, b in zip(starts.tolist(), stops.tolist())]


def tokenizer(vocabulary: str) -> Tokenizer:
    """The tokenizer of a file, loaded once a worker. A path stands for itself; a bare name is one of the installed vocabularies."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Tokenizer(_path(vocabulary))
    return _loaded[vocabulary]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every text."""

    def scan(batches):
        coder = tokenizer(vocabulary)
        for b in batches:
            found = [np.array(coder.encode(t.as_py() or ""), np.int32) for t in b.column(1)]
            ends = np.cumsum([0] + [len(x) for x in found], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(scan, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``encode`` with ``text``: the tokens' spellings joined by spaces, as files without a decoder say. Null ids give no text."""

    def scan(batches):
        coder = tokenizer(vocabulary)
        for b in batches:
            lists = b.column(1)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            texts = coder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
            texts = [t.decode() if valid else None for t, valid in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, "doc_id long, ids array<int>, text string")


def query(spark, sf_dir):
    rows = decode(encode(table(spark, sf_dir, "documents")))
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
