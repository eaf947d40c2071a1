"""Smith-Waterman kernels, vectorised in numpy and fed by Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.schemas import BandedParams, ChimeraParams, LocalParams, TrimParams

LOCAL = "score int, query_start int, query_end int, target_start int, target_end int, matches int, mismatches int, gaps int, identity double, cigar string, cigar_sam string"


def run_lengths(ops: str) -> str:
    """Run-length form of operations; "0M" if there are none."""
    out, at = [], 0
    while at < len(ops):
        end = at
        while end < len(ops) and ops[end] == ops[at]:
            end += 1
        out.append(f"{end - at}{ops[at]}")
        at = end
    return "".join(out) or "0M"


#: Cells of the score matrices that are filled together.
CELLS = 1 << 21


def local_align(query: str, target: str, p: LocalParams = LocalParams()) -> dict:
    """Best local alignment with traceback. A gap costs its opening unless the cell it comes from is a gap of the same kind.

    Ties prefer the diagonal, then a gap in the target; the first best cell in row order ends the alignment. In
    ``cigar`` D consumes the query and I the target; ``cigar_sam`` has them the other way round.
    """
    return local_align_many([(query, target)], p)[0]


def local_align_many(pairs: list[tuple[str, str]], p: LocalParams = LocalParams()) -> list[dict]:
    """``local_align`` of every pair, pairs of like size together."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    part, rows, cols = [], 0, 0
    for i in order:
        n, m = len(pairs[i][0]), len(pairs[i][1])
        if part and (max(rows, n) + 1) * (max(cols, m) + 1) * (len(part) + 1) > CELLS:
            _fill([pairs[j] for j in part], part, out, p)
            part, rows, cols = [], 0, 0
        part.append(i)
        rows, cols = max(rows, n), max(cols, m)
    if part:
        _fill([pairs[j] for j in part], part, out, p)
    return out


def _letters(strings: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(strings), width), pad, np.int64)
    for i, x in enumerate(strings):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
    return out


def _fill(pairs, places, out, p: LocalParams) -> None:
    """Score matrices of some pairs at once, by anti-diagonals: a cell needs the two before its own only."""
    qs, ts = (list(x) for x in zip(*pairs))
    n, m, count = max(map(len, qs)), max(map(len, ts)), len(qs)
    q, t = _letters(qs, n, -1), _letters(ts, m, -2)
    score = np.zeros((count, n + 1, m + 1), np.int32)
    came = np.zeros((count, n + 1, m + 1), np.uint8)  # 1 diagonal, 2 up, 3 left
    n_own, m_own = (np.array([len(x) for x in xs])[:, None] for xs in (qs, ts))
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        diag = score[:, i - 1, j - 1] + np.where(q[:, i - 1] == t[:, j - 1], p.match, p.mismatch)
        up = score[:, i - 1, j] + np.where(came[:, i - 1, j] == 2, p.gap_extend, p.gap_open)
        left = score[:, i, j - 1] + np.where(came[:, i, j - 1] == 3, p.gap_extend, p.gap_open)
        top = np.maximum(np.maximum(diag, up), np.maximum(left, 0))
        top = np.where((i <= n_own) & (j <= m_own), top, 0)
        score[:, i, j] = top
        came[:, i, j] = np.where(top > 0, np.where(top == diag, 1, np.where(top == up, 2, 3)), 0)
    for k, place in enumerate(places):
        at = int(score[k].argmax())  # the first in row order
        out[place] = _trace(qs[k], ts[k], score[k], came[k], at // (m + 1), at % (m + 1))


def _trace(query: str, target: str, score: np.ndarray, came: np.ndarray, end_i: int, end_j: int) -> dict:
    best, i, j, ops = int(score[end_i, end_j]), end_i, end_j, []
    while i and j and score[i, j] > 0:
        step = came[i, j]
        if step == 1:
            ops.append("M" if query[i - 1] == target[j - 1] else "X")
            i, j = i - 1, j - 1
        elif step == 2:
            ops.append("D")
            i -= 1
        else:
            ops.append("I")
            j -= 1
    ops = "".join(reversed(ops))
    same, far, gaps = ops.count("M"), ops.count("X"), ops.count("D") + ops.count("I")
    return {
        "score": best, "query_start": i, "query_end": end_i, "target_start": j, "target_end": end_j, "matches": same, "mismatches": far, "gaps": gaps,
        "identity": 100.0 * same / len(ops) if ops else 0.0, "cigar": run_lengths(ops), "cigar_sam": run_lengths(ops.translate(str.maketrans("DI", "ID"))),
    }


def local_udf(params: LocalParams = LocalParams()):
    """struct column of ``local_align(query, target)``; equal pairs of a batch are aligned once."""

    @F.pandas_udf(LOCAL)
    def align(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        pairs = list(zip(query.fillna(""), target.fillna("")))
        own = list(dict.fromkeys(pairs))
        done = dict(zip(own, local_align_many(own, params)))
        return pd.DataFrame([done[x] for x in pairs], columns=[x.split()[0] for x in LOCAL.split(", ")])

    return align


#: Band cells of the reads that are aligned together, so that a row of all of them stays in the processor's cache; with traces
#: they take two bits each.
BAND_CELLS = 1 << 22

BANDED = "score int, start bigint, cigar string, edits int, read_start int, read_end int, window_start bigint"


def _row_bytes(strings: list[str], width: int, pad: bytes) -> np.ndarray:
    packed = b"".join(x.encode("ascii", "replace").ljust(width, pad) for x in strings)
    return np.frombuffer(packed, np.uint8).reshape(len(strings), width)


def banded_fill(reads: list[str], windows: list[str], diagonals: np.ndarray, p: BandedParams, trace: bool):
    """(score, row, lane, steps) of the first best cell of every read in row order; lane b of row i is column i + diagonal - band + b.

    Gaps along a row are a running maximum: a cell's best way in from the left is the best of base - gap * lane so far. With
    ``trace`` steps has two bits a cell, four cells a byte: where the cell came from (0 nowhere, 1 diagonal, 2 the row before,
    3 the left), in this order of preference.
    """
    count, rows, cols, width = len(reads), max(map(len, reads), default=0), max(map(len, windows), default=0), 2 * p.band + 1
    q, t = _row_bytes(reads, rows, b"\0"), _row_bytes(windows, cols, b"\1")
    # windows shifted to their diagonals, so that a row's lanes are a slice of them; no base beyond their ends
    room = np.full((count, cols + 2), 1, np.uint8)
    room[:, 1:-1] = t
    shifted = np.take_along_axis(room, np.clip(np.arange(rows + width) + diagonals[:, None] - p.band, -1, cols) + 1, 1)
    # scores of reads and gaps of a band in half the bytes where they fit
    kind = np.int16 if max(rows, width) * max(abs(p.match), abs(p.mismatch), abs(p.gap)) < 1 << 14 else np.int32
    match, mismatch, gap = (kind(x) for x in (p.match, p.mismatch, p.gap))
    prev = np.zeros((count, width + 2), kind)
    best, best_i, best_lane = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    lane = np.arange(width)
    slope = (p.gap * lane).astype(kind)
    quads = -(-width // 4)
    steps = np.zeros((rows, count, quads), np.uint8) if trace else None
    came = np.zeros((count, quads * 4), np.uint8)
    for i in range(rows):
        c = shifted[:, i : i + width]
        own = q[:, i : i + 1]
        inside = (own > 0) & (c > 1)
        diagonal = prev[:, 1:-1] + np.where((own == c) | (own == 78) | (c == 78), match, mismatch)
        up = prev[:, 2:] + gap
        base = np.maximum(np.maximum(diagonal, up), 0) * inside
        now = (np.maximum.accumulate(base - slope, axis=1) + slope) * inside
        if trace:
            straight = (now == diagonal).view(np.uint8)
            # 1 of the diagonal, else 2 of the row before, else 3
            came[:, :width] = (3 - 2 * straight - ((now == up).view(np.uint8) & (straight ^ 1))) * (now > 0)
            steps[i] = came[:, 0::4] | came[:, 1::4] << 2 | came[:, 2::4] << 4 | came[:, 3::4] << 6
        prev[:, 1:-1] = now
        top = now.argmax(1)
        value = now[np.arange(count), top]
        better = value > best
        best[better], best_i[better], best_lane[better] = value[better], i, top[better]
    return best, best_i, best_lane, steps


def banded_walk(reads: list[str], windows: list[str], diagonals: np.ndarray, filled, p: BandedParams) -> tuple[np.ndarray, ...]:
    """(operations, matches, first row, first column) of all reads' alignments, walked back from their best cells together.

    Operations are rows of M, I (a base of the read alone) and D (a base of the window alone), from the alignment's end to its start, 0 after it.
    """
    best, i, lane, steps = filled
    count = len(best)
    q, t = _row_bytes(reads, max(map(len, reads), default=0), b"\0"), _row_bytes(windows, max(map(len, windows), default=0), b"\1")
    i, lane, live = i.copy(), lane.copy(), np.flatnonzero(best > 0)
    first_i, first_col, same = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    taken: list[np.ndarray] = []
    while len(live):
        row, at = i[live], lane[live]
        step = steps[row, live, at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3
        live, row, at, step = live[step > 0], row[step > 0], at[step > 0], step[step > 0]
        if not len(live):
            break
        op = np.zeros(count, np.uint8)
        op[live] = np.array([0, 77, 73, 68], np.uint8)[step]  # M, I, D
        taken.append(op)
        col = row + diagonals[live] - p.band + at
        first_i[live], first_col[live] = row, col
        a, b = q[live, row], t[live, np.minimum(col, t.shape[1] - 1)]
        same[live] += (step == 1) & ((a == b) | (a == 78) | (b == 78))
        i[live] = row - (step < 3)
        lane[live] = at + (step == 2) - (step == 3)
        live = live[(i[live] >= 0) & (lane[live] >= 0) & (lane[live] <= 2 * p.band)]
    return (np.stack(taken, 1) if taken else np.zeros((count, 0), np.uint8)), same, first_i, first_col


def banded_scores(reads: list[str], windows: list[str], diagonals: np.ndarray, p: BandedParams = BandedParams()) -> tuple[np.ndarray, np.ndarray]:
    """(score, start in window) of the banded local alignment of each read around its seed's diagonal; linear gaps, N matches."""
    best, start = np.zeros(len(reads), np.int32), np.zeros(len(reads), np.int64)
    for part in _alike(reads, windows, p):
        score, i, lane, _ = banded_fill([reads[k][: p.max_length] for k in part], [windows[k] for k in part], diagonals[part], p, False)
        best[part], start[part] = score, np.where(score > 0, np.maximum(0, diagonals[part] - p.band + lane), 0)
    return best, start


def _alike(reads: list[str], windows: list[str], p: BandedParams):
    """Numbers of reads that are aligned together: of like length, and of at most ``BAND_CELLS`` band cells."""
    order = sorted(range(len(reads)), key=lambda k: (len(reads[k]), len(windows[k])))
    part: list[int] = []
    for k in order:
        if part and (len(part) + 1) * max(1, min(len(reads[k]), p.max_length)) * (2 * p.band + 1) > BAND_CELLS:
            yield np.array(part)
            part = []
        part.append(k)
    if part:
        yield np.array(part)


def banded_traces(reads: list[str], windows: list[str], diagonals: np.ndarray, p: BandedParams = BandedParams()) -> pd.DataFrame:
    """Rows of ``BANDED``: the score and the start that ``banded_scores`` gives, and the alignment itself.

    ``cigar`` has M for matches and mismatches, I and D for bases of the read and of the window alone, and S for the read's ends that are
    not aligned; ``edits`` counts mismatches and gap bases. The aligned bases are read_start to read_end (excluded) of the read, from
    ``window_start`` on of the window. Reads without a positive score have no CIGAR ("*").
    """
    out: dict[str, list] = {name.split()[0]: [None] * len(reads) for name in BANDED.split(", ")}
    for part in _alike(reads, windows, p):
        own, wins, diag = [reads[k][: p.max_length] for k in part], [windows[k] for k in part], diagonals[part]
        filled = banded_fill(own, wins, diag, p, True)
        ops, same, first_i, first_col = banded_walk(own, wins, diag, filled, p)
        score, last_i, lane, _ = filled
        sizes = (ops > 0).sum(1)
        edits = sizes - same
        start = np.where(score > 0, np.maximum(0, diag - p.band + lane), 0)
        texts = ops[:, ::-1].tobytes().decode("latin-1")
        wide = ops.shape[1]
        for x, k in enumerate(part.tolist()):
            hit = bool(score[x] > 0)
            a, z = (int(first_i[x]), int(last_i[x]) + 1) if hit else (0, 0)
            cigar = "*"
            if hit:
                inner = run_lengths(texts[(x + 1) * wide - int(sizes[x]) : (x + 1) * wide])
                cigar = (f"{a}S" if a else "") + inner + (f"{len(reads[k]) - z}S" if z < len(reads[k]) else "")
            for name, value in zip(out, (int(score[x]), int(start[x]), cigar, int(edits[x]), a, z, int(first_col[x]) if hit else 0)):
                out[name][k] = value
    return pd.DataFrame(out)


def banded_traces_udf(params: BandedParams = BandedParams()):
    """struct of ``banded_traces``, given the seed's diagonal in the window."""

    @F.pandas_udf(BANDED)
    def align(read: pd.Series, window: pd.Series, diagonal: pd.Series) -> pd.DataFrame:
        return banded_traces(list(read), list(window), diagonal.to_numpy(np.int64), params)

    return align


def banded_udf(params: BandedParams = BandedParams()):
    """struct(score, start) of reads against reference windows, given the seed's diagonal in the window."""

    @F.pandas_udf("score int, start bigint")
    def align(read: pd.Series, window: pd.Series, diagonal: pd.Series) -> pd.DataFrame:
        score, start = banded_scores(list(read), list(window), diagonal.to_numpy(np.int64), params)
        return pd.DataFrame({"score": score, "start": start})

    return align


def _bytes(strings, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes, zero after their end, and their lengths; longer ones are cut."""
    raw = [x[:width].encode("ascii", "replace") for x in strings]
    packed = b"".join(x.ljust(width, b"\0") for x in raw)
    return np.frombuffer(packed, np.uint8).reshape(len(raw), width), np.array([len(x) for x in raw], np.int64)


def _window_mismatches(text: np.ndarray, pattern: bytes, wild: bool) -> np.ndarray:
    """Mismatches of the pattern at every offset of every row; N matches anything if ``wild``."""
    places = text.shape[1] - len(pattern) + 1
    out = np.zeros((len(text), max(places, 0)), np.uint8)
    if places > 0:
        for k, c in enumerate(pattern):
            if wild and c == 78:
                continue
            part = text[:, k : k + places]
            out += (part != c) & (part != 78) if wild else part != c
    return out


def best_codes(strings, codes: list[str], mismatches: int, region: int) -> dict[str, np.ndarray]:
    """Of each string: fewest mismatches of any code in the first ``region`` bases (-1 if over the limit), the first such
    code in the given order, its earliest offset, and how many codes do equally well."""
    text, size = _bytes(strings, region)
    n = len(text)
    mm, which, pos, ties = np.full(n, 255), np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    for j, code in enumerate(codes):
        if not code or len(code) > region:
            continue
        far = _window_mismatches(text, code.encode(), True)
        far[np.arange(far.shape[1]) + len(code) > size[:, None]] = 255
        at = far.argmin(1)
        best = far[np.arange(n), at].astype(int)
        ok = best <= mismatches
        less = ok & (best < mm)
        ties[ok & (best == mm)] += 1
        mm[less], which[less], pos[less], ties[less] = best[less], j, at[less], 1
    mm[which < 0] = -1
    return {"mm": mm, "which": which, "pos": pos, "ties": ties}


def barcode_udf(codes: list[str], mismatches: int, region: int):
    """struct(mm, which, pos, ties) of ``best_codes`` over a string column."""

    @F.pandas_udf("mm int, which int, pos int, ties int")
    def find(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(best_codes(s.fillna(""), codes, mismatches, region))

    return find


def contains_udf(mismatches: int):
    """Whether a pattern stands anywhere in a text with at most so many mismatches; equal patterns share their scan."""

    @F.pandas_udf("boolean")
    def contains(text: pd.Series, pattern: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        width = int(text.str.len().max()) if len(text) else 0
        for p, at in pattern.groupby(pattern).indices.items():
            for lo in range(0, len(at), 2048):
                i = at[lo : lo + 2048]
                t, size = _bytes(text.iloc[i], max(width, 1))
                far = _window_mismatches(t, p.encode("ascii", "replace"), False)
                fits = (far <= mismatches) & (np.arange(far.shape[1]) + len(p) <= size[:, None])
                out[i] = fits.any(1) if len(p) else True
        return pd.Series(out)

    return contains


def best_primers(strings, panel: list[tuple[int, str, str]], p: TrimParams) -> dict[str, np.ndarray]:
    """Of each string: where the best forward primer of a panel (order, forward, complement of reverse) ends at its start, and
    where the best reverse one begins near its end; -1 without one. Fewest mismatches first, then the panel's order. N is wild
    on both sides, and a primer may pass the string's end if enough of it matches."""
    strings = list(strings)
    width = max(map(len, strings), default=0)
    text, size = _bytes(strings, max(width, 1))
    n = len(text)
    at = np.arange(n)

    def far(pattern: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mismatches at each row's start, and whether the pattern fits there."""
        cols = starts[:, None] + np.arange(len(pattern))
        inside = cols < size[:, None]
        c = text[at[:, None], np.minimum(cols, text.shape[1] - 1)]
        code = np.frombuffer(pattern, np.uint8)
        mm = ((c != code) & (c != 78) & (code != 78) & inside).sum(1)
        return mm, (mm <= p.max_mismatches) & (inside.sum(1) - mm >= p.min_overlap)

    out = {}
    for name, which, tries in (("fwd", 1, 1), ("rev", 2, 11)):
        best, cut = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for row in sorted(panel):
            pattern = row[which].encode("ascii", "replace")
            if len(pattern) < p.min_overlap:
                continue
            first = np.zeros(n, np.int64) if which == 1 else np.maximum(size - len(pattern) - 10, 0)
            for k in range(tries):
                mm, fits = far(pattern, first + k)
                better = fits & (mm < best)  # the panel is in order, and offsets rise
                best[better] = mm[better]
                cut[better] = len(pattern) if which == 1 else (first + k)[better]
        out[name] = cut
    return out


def primer_udf(panel: list[tuple[int, str, str]], params: TrimParams):
    """struct(fwd, rev) of ``best_primers`` over a string column."""

    @F.pandas_udf("fwd int, rev int")
    def find(s: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(best_primers(s.iloc[lo : lo + 4096].fillna(""), panel, params)) for lo in range(0, len(s), 4096)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"fwd": [], "rev": []})

    return find


def best_joins(strings, abundance, parents: list[tuple[int, str, int]], p: ChimeraParams, references: bool) -> tuple[np.ndarray, np.ndarray]:
    """(distance, breakpoint) of the best join of two parents' sides for each string, -1 without one.

    De novo, parents are those at least ``abundance_ratio`` times as abundant, two at least, and each side takes its best
    of those that are as long as the string; against references the two sides come from different ones, the left one reaching to the breakpoint and
    the right one to the string's end.
    """
    strings, abundance = list(strings), np.asarray(abundance, np.float64)
    out, spot = np.full(len(strings), -1), np.full(len(strings), -1)
    lengths = np.array([len(x) for x in strings])
    parents = sorted(parents)
    heavy = np.array([x[2] for x in parents], np.float64)
    known = np.array([len(x[1]) for x in parents], np.int64)
    none = np.iinfo(np.int32).max
    for n in np.unique(lengths[lengths >= p.min_length]).tolist():
        points = np.arange(p.edge, n - p.edge + 1, p.step)
        rows = np.flatnonzero(lengths == n)
        if not len(points) or not len(parents):
            continue
        step = max(1, (1 << 22) // (n * len(parents)))
        codes = _letters([x[1][:n] for x in parents], n, -3)
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            own = _letters([strings[i] for i in at], n, -4)
            unequal = np.concatenate((np.zeros((len(at), len(parents), 1), np.int32), np.cumsum(own[:, None] != codes[None], axis=2, dtype=np.int32)), axis=2)
            total = unequal[:, :, -1]  # a longer parent is cut
            whole = known >= n
            best, place = np.full(len(at), none), np.full(len(at), -1)
            for bp in points.tolist():
                left = unequal[:, :, bp]
                right = total - left
                if references:
                    d = _two_sides(np.where(known >= bp, left, none // 4), np.where(whole, right, none // 4))
                    many = d < none // 4
                else:
                    ok = heavy >= p.abundance_ratio * abundance[at][:, None]
                    many, ok = ok.sum(1) >= 2, ok & whole
                    d = np.where(ok, left, none // 4).min(1) + np.where(ok, right, none // 4).min(1)
                    many &= ok.any(1)
                better = many & (d < best)
                best[better], place[better] = d[better], bp
            found = place >= 0
            out[at[found]], spot[at[found]] = best[found], place[found]
    return out, spot


def _two_sides(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least sum of a left and a right value in different columns, from the two least of each side."""
    rows = np.arange(len(left))
    if left.shape[1] < 2:
        return np.full(len(left), np.iinfo(np.int32).max)
    a, b = (np.argsort(x, axis=1, kind="stable")[:, :2] for x in (left, right))
    out = np.full(len(left), np.iinfo(np.int32).max)
    for i in range(2):
        for j in range(2):
            total = left[rows, a[:, i]] + right[rows, b[:, j]]
            out = np.where((a[:, i] != b[:, j]) & (total < out), total, out)
    return out


def joins_udf(parents: list[tuple[int, str, int]], params: ChimeraParams, references: bool):
    """struct(distance, breakpoint) of ``best_joins``; NULL fields without one."""

    @F.pandas_udf("distance int, breakpoint int")
    def find(s: pd.Series, abundance: pd.Series) -> pd.DataFrame:
        d, bp = best_joins(s.fillna(""), abundance.fillna(0), parents, params, references)
        gone = bp < 0
        return pd.DataFrame({"distance": pd.Series(d, dtype="Int32").mask(gone), "breakpoint": pd.Series(bp, dtype="Int32").mask(gone)})

    return find
