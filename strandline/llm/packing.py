"""Token ids packed into fixed-length rows by best fit decreasing.

Every text is encoded with a byte-level vocabulary (a rank file, a parameter), ended by an end id
(a parameter; the first id after the ranks if not given) and cut into pieces of at most ``length`` ids,
so no id is lost. Pieces are packed in groups of
about ``group_ids`` ids of one input split: longest first, each into the row with the least room
that still holds it. A segment tree over room sizes finds that row in log(length) steps. Rows are
padded to ``length`` with the end id.

Each row carries its ids (little-endian, of ``id_bytes`` bytes: 2, or 4 where the vocabulary has more than
65,536 ids), the cumulative segment lengths, the positions at
which position ids restart (0 at every segment start; padding restarts too), and the document and
first id offset of each segment, from which ``unpack`` restores every document's ids. Null and
empty texts give the end id alone. Rows with equal ids stay apart by their offsets only if one of
them is cut; a null doc_id is kept as null. Other columns are ignored. An empty table gives no rows.

``write_matrices`` writes the rows as files that training code maps into memory: one id matrix a task,
and beside it the segment lengths, resets and their bounds as flat arrays.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm._spark import table

#: The end id of the default vocabulary.
END = 50256
LENGTH = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The published pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, n_ids int, ids binary, id_bytes int, resets array<int>"

_encoders: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file. A path stands for itself; a bare name is a file of the installed public vocabularies."""
    if vocabulary not in _encoders:
        import tiktoken

        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def id_type(vocabulary: str, end: int | None = None) -> tuple[np.dtype, int]:
    """The type of the ids, and the end id."""
    top = encoder(vocabulary).max_token_value
    end = top + 1 if end is None else end
    return np.dtype("<u2" if max(top, end) < 1 << 16 else "<u4"), end


class Rooms:
    """Open rows by the room they have left: a segment tree of counts over 0..length."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.any[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room that is at least ``need``; the row is taken out."""
        i = need + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not self.any[i]:
                    i += 1
        room = i - self.size
        while i:
            self.any[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths, length: int) -> list[list[int]]:
    """Rows of piece numbers. Longest pieces first, ties in input order."""
    rooms, rows = Rooms(length), []
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        need = int(lengths[i])
        if found := rooms.take(need):
            room, row = found
            rows[row].append(i)
        else:
            room, row = length, len(rows)
            rows.append([i])
        if room > need:
            rooms.put(room - need, row)
    return rows


def pack(docs: DataFrame, length: int = LENGTH, group_ids: int = 2_000_000, vocabulary: str = VOCABULARY, end: int | None = None) -> DataFrame:
    """The packed rows of every text of ``docs``."""

    def emit(pieces, kind, last) -> Iterator[pa.RecordBatch]:
        rows = best_fit([len(p[2]) for p in pieces], length)
        for lo in range(0, len(rows), 256):
            part = [[pieces[i] for i in row] for row in rows[lo : lo + 256]]
            cu = [np.cumsum([0] + [len(p[2]) for p in row]).tolist() for row in part]
            ids = [np.concatenate([p[2] for p in row] + [np.full(length - c[-1], last, kind)]).tobytes() for row, c in zip(part, cu)]
            cols = [
                pa.array([[p[0] for p in row] for row in part], pa.list_(pa.int64())),
                pa.array([[p[1] for p in row] for row in part], pa.list_(pa.int32())),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array([c[-1] for c in cu], pa.int32()),
                pa.array(ids, pa.binary()),
                pa.array([kind.itemsize] * len(part), pa.int32()),
                pa.array([c if c[-1] < length else c[:-1] for c in cu], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_ids", "doc_offsets", "cu_seqlens", "n_ids", "ids", "id_bytes", "resets"])

    def scan(batches):
        encode, pieces, held = encoder(vocabulary).encode_ordinary, [], 0
        kind, last = id_type(vocabulary, end)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array(encode(text.as_py() or "") + [last], kind)
                for at in range(0, len(ids), length):
                    pieces.append((doc, at, ids[at : at + length]))
                held += len(ids)
                if held >= group_ids:
                    yield from emit(pieces, kind, last)
                    pieces, held = [], 0
        if pieces:
            yield from emit(pieces, kind, last)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(scan, SCHEMA)


def unpack(rows) -> dict:
    """(doc_id, ids) of packed rows, end ids included; for checks on small tables."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), f"<u{r['id_bytes']}")
        for i, (doc, off) in enumerate(zip(r["doc_ids"], r["doc_offsets"])):
            parts.setdefault(doc, []).append((off, ids[r["cu_seqlens"][i] : r["cu_seqlens"][i + 1]].tolist()))
    return {doc: [x for _, p in sorted(found) for x in p] for doc, found in parts.items()}


def position_ids(cu_seqlens, length: int) -> np.ndarray:
    """Position ids of one row, which restart at every segment and at the padding."""
    starts = np.asarray(cu_seqlens)
    starts = starts[starts < length]
    at = np.zeros(length, np.int64)
    at[starts] = starts
    return np.arange(length) - np.maximum.accumulate(at)


def write_matrices(packed: DataFrame, path: str) -> DataFrame:
    """Write the packed rows into a folder that all executors share, and return (part, n_rows, n_ids) of what was written.

    Part 00007 is ``ids-00007.npy`` (rows x length, of the ids' type), ``cu_seqlens-00007.npy`` and ``resets-00007.npy``
    (flat int32) and ``bounds-00007.npy`` (rows + 1 by 2: where each row's lengths and resets begin). A file gets its name when it is
    whole, so a task that is run again replaces its own files.
    """
    if "://" in path and not path.startswith("file://"):
        raise ValueError("matrices are written to a mounted folder")
    folder = path.removeprefix("file://")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, n_ids, n_rows = task.partitionId(), 0, 0
        os.makedirs(folder, exist_ok=True)
        temporary = f"{folder}/.{part:05d}-{task.taskAttemptId()}"
        cu, resets, bounds, kind, length = [], [], [(0, 0)], None, 0
        with open(f"{temporary}-raw", "wb") as out:  # rows go to disk as they come
            for b in batches:
                for ids, size, lengths, starts, n in zip(*(b.column(c).to_pylist() for c in ("ids", "id_bytes", "cu_seqlens", "resets", "n_ids"))):
                    out.write(ids)
                    kind, length = np.dtype(f"<u{size}"), len(ids) // size
                    cu += lengths
                    resets += starts
                    bounds.append((len(cu), len(resets)))
                    n_rows, n_ids = n_rows + 1, n_ids + n
        if n_rows:
            matrix = np.memmap(f"{temporary}-raw", kind, "r", shape=(n_rows, length))
            for name, array in (("ids", matrix), ("cu_seqlens", np.array(cu, np.int32)), ("resets", np.array(resets, np.int32)), ("bounds", np.array(bounds, np.int64))):
                np.save(f"{temporary}-{name}.npy", array)
                os.replace(f"{temporary}-{name}.npy", f"{folder}/{name}-{part:05d}.npy")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_rows], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "n_rows", "n_ids"])
        os.remove(f"{temporary}-raw")

    found = packed.select("ids", "id_bytes", "cu_seqlens", "resets", "n_ids").mapInArrow(write, "part int, n_rows long, n_ids long").toArrow()
    return packed.sparkSession.createDataFrame(found)


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
