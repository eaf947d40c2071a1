"""Vectorised text kernels shared by the training-data operators.

Texts arrive as Arrow string columns. Everything here works on the raw UTF-8 buffers of a record
batch, in slices of whole documents of about ``SLICE`` bytes, so memory is bounded by the slice (or
by the longest single text) and no Python string is made per row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
WORD_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words that end at ASCII white space: [^\x20\x09-\x0D]+
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Words of letters and digits, all of non-ASCII included: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PUNCT = np.zeros(256, bool)
PUNCT[0x00:0x30] = PUNCT[0x3A:0x61] = PUNCT[0x7B:0x80] = True

_powers = {"f": np.empty(0, np.uint64), "i": np.empty(0, np.uint64)}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["f"]) < n:
        size = max(n, SLICE + 1)
        for key, base in (("f", _BASE), ("i", _BASE_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["f"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def trim() -> None:
    """Give freed memory back, so that a worker that later tasks reuse stays small."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets from 0) of runs of rows that hold about ``limit`` bytes."""
    raw, offsets = raw_text(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    trim()


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes that are not ``gaps``; runs end with their row."""
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, z
    inside = ~gaps[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums; with ``span_hash`` they give the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _pow(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _pow(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle, rows in order; a row of 1 to k - 1 words gives its whole sequence as one."""
    n = len(hashes)
    count = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(count) - count
    parts_r, parts_h = [], []
    if n >= k:
        whole = rows[k - 1 :] == rows[: n - k + 1]
        at = np.flatnonzero(whole)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h += hashes[at + j] * WORD_MULT[j]
        parts_r.append(rows[at])
        parts_h.append(mix(h))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = count[short].astype(np.uint64) * WORD_MULT[63]
        for j in range(k - 1):
            has = count[short] > j
            h[has] += hashes[first[short[has]] + j] * WORD_MULT[j]
        parts_r.append(short)
        parts_h.append(mix(h))
    if not parts_r:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    r, h = np.concatenate(parts_r), np.concatenate(parts_h)
    if len(parts_r) > 1:
        order = np.argsort(r, kind="stable")
        r, h = r[order], h[order]
    return r, h


def distinct_by_row(r: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row: (rows, hashes, n_rows + 1 offsets)."""
    count = np.bincount(r, minlength=n_rows)
    edge = np.concatenate(([0], np.cumsum(count)))
    h = h.copy()
    for i in np.flatnonzero(count > 1):
        h[edge[i] : edge[i + 1]].sort()
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        r, h = r[keep], h[keep]
    return r, h, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=n_rows))))


def shingle_sets(data, offsets, k, gaps=SPACES):
    """Sorted distinct shingle hashes of each row of a slice: (rows, hashes, offsets)."""
    data = LOWER[data]
    s, e, r = words(data, offsets, gaps)
    sums = prefix_hash(data)
    n = len(offsets) - 1
    return distinct_by_row(*shingles(span_hash(sums, s, e), r, n, k), n)


def list_array(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
