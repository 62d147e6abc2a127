"""Batches of reads as byte matrices, and the vectorised scans over bases that SQL expressions cannot say well.

A batch of n reads is a pair of n x L matrices, left-aligned, and n lengths; every scan works on all reads of the batch at once,
position by position, so its cost in Python does not depend on n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in ("AT", "TA", "CG", "GC"):
    COMPLEMENT[ord(_a)] = ord(_b)
A, C, G, T, N = (ord(x) for x in "ACGTN")
GOOD, BAD = 30 + 33, 14 + 33
#: Bases that are compared before whole adapters are.
PREFIX = 16
#: Bases of a window of `windows`, two bits each, and the lower bit of each.
WINDOW, LOWER = 32, np.uint64(0x5555555555555555)
#: Offsets that are tried by windows before rows are compared whole.
STRIDE = 16


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as bytes, one row each, zero-filled; and the lengths. Null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    width = int(size.max(initial=0))
    if len(size) and (size == width).all():
        return data[ends[0] : ends[-1]].reshape(len(size), width), size
    out = np.zeros((len(size), width), np.uint8)
    at = np.arange(out.shape[1])[None, :] < size[:, None]
    out[at] = data[ends[0] : ends[-1]] if len(ends) else 0
    return out, size


def strings(rows: np.ndarray, size: np.ndarray) -> pa.Array:
    """The way back."""
    at = np.arange(rows.shape[1])[None, :] < size[:, None]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((rows if at.all() else rows[at]).tobytes())])
    return raw.cast(pa.string())


class Mates:
    """Reads of one mate: sequences, qualities, lengths."""

    def __init__(self, seq: np.ndarray, qual: np.ndarray, size: np.ndarray):
        self.seq, self.qual, self.size = seq, qual, size.astype(np.int64)

    @classmethod
    def of(cls, seq: pa.Array, qual: pa.Array) -> "Mates":
        s, n = matrix(seq)
        q, _ = matrix(qual)
        return cls(s, q, n)

    def view(self) -> "Mates":
        """The same bases, with a length of its own; arrays are replaced, not changed, but for `correct`, which copies them."""
        return Mates(self.seq, self.qual, self.size)

    def take(self, rows: np.ndarray) -> "Mates":
        return Mates(self.seq[rows], self.qual[rows], self.size[rows])

    @property
    def inside(self) -> np.ndarray:
        return np.arange(self.seq.shape[1])[None, :] < self.size[:, None]

    def resize(self, n: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Keep the first n bases (of the given rows); what stands behind a length is never looked at."""
        n = np.minimum(self.size, n)
        self.size = n if rows is None else np.where(rows, n, self.size)

    def drop_front(self, k: np.ndarray) -> None:
        """Drop the first k bases."""
        k = np.minimum(np.asarray(k, np.int64), self.size)
        if k.any():
            width = self.seq.shape[1]
            at = np.minimum(np.arange(width)[None, :] + k[:, None], max(width - 1, 0))
            self.seq, self.qual = np.take_along_axis(self.seq, at, 1), np.take_along_axis(self.qual, at, 1)
            self.size = self.size - k

    def backwards(self, rows: np.ndarray) -> np.ndarray:
        """Rows of this shape from the last base to the first, left-aligned, zero behind the length."""
        width = rows.shape[1]
        if (self.size == width).all():
            return rows[:, ::-1]
        at = np.clip(self.size[:, None] - 1 - np.arange(width)[None, :], 0, max(width - 1, 0))
        return np.where(self.inside, np.take_along_axis(rows, at, 1), 0)


def first_true(x: np.ndarray, default: np.ndarray) -> np.ndarray:
    """Of each row the first true column, else default."""
    return np.where(x.any(axis=1), x.argmax(axis=1), default) if x.shape[1] else np.asarray(default).copy()


# ---- cuts -------------------------------------------------------------------------------------


def quality_cut(m: Mates, front: int, tail: int, cuts: dict[str, tuple[int, int]]) -> np.ndarray:
    """Fixed trims and sliding-window cuts (`front`, then `right` or `tail`: window, mean quality); returns what went from the front."""
    n, width = m.seq.shape
    size, empty = m.size, front + tail > m.size
    low, high = np.full(n, front), np.maximum(size - tail, 0)
    sums = np.zeros((n, width + 1), np.int64)
    np.cumsum(m.qual, axis=1, out=sums[:, 1:])
    at = np.arange(width)[None, :]

    def poor(w: int, q: int) -> np.ndarray:
        """Whether the window that starts at a column is below the threshold; columns without a whole window are false."""
        out = np.zeros((n, width), bool)
        if width >= w:
            out[:, : width - w + 1] = sums[:, w:] - sums[:, : width - w + 1] < w * (q + 33)
        return out

    if "front" in cuts:
        w, q = cuts["front"]
        empty |= high - low <= w
        fine = ~poor(w, q) & (at >= low[:, None]) & (at + w < high[:, None])
        s = first_true(fine, np.maximum(high - w, low))
        s = np.where(s > 0, s + w - 1, s)
        other = (m.seq != N) & (at >= s[:, None]) & (at < size[:, None])
        low = np.where(empty, low, first_true(other, np.maximum(size, s)))
    if "right" in cuts:
        w, q = cuts["right"]
        empty |= high - low <= w
        bad = poor(w, q) & (at >= low[:, None]) & (at < (high - w)[:, None])
        hit, s = bad.any(axis=1), bad.argmax(axis=1) if width else low
        weak = ((m.qual < q + 33) | (at >= (size - 1)[:, None])) & (at >= np.asarray(s)[:, None])
        high = np.where(hit & ~empty, first_true(weak, size - 1), high)
    elif "tail" in cuts:
        w, q = cuts["tail"]
        empty |= high - low <= w
        ends = np.zeros((n, width), bool)  # by a window's last column
        if width >= w:
            ends[:, w - 1 :] = ~poor(w, q)[:, : width - w + 1]
        ends &= (at >= (low + w)[:, None]) & (at <= (high - 1)[:, None])
        t = np.where(ends.any(axis=1), width - 1 - ends[:, ::-1].argmax(axis=1), low + w - 1) if width else low
        t = np.where(t < size - 1, t + 1 - w, t)
        other = (m.seq != N) & (at <= t[:, None])
        some = other.any(axis=1)
        empty |= ~some
        high = np.where(empty, high, (width - other[:, ::-1].argmax(axis=1)) if width else high)
    empty |= low >= high
    if cuts:
        empty |= low >= np.maximum(size - 1, 0)
    m.resize(np.where(empty, 0, high))
    low = np.where(empty, 0, low)
    m.drop_front(low)
    return low


def poly_g(m: Mates, least: int) -> None:
    back = m.backwards(m.seq)
    width = back.shape[1]
    at = np.arange(1, width + 1)[None, :]
    wrong = np.cumsum((back != G) & m.inside, axis=1)
    stop = ((wrong > 5) | ((wrong > at // 8) & (at >= least))) & m.inside
    compared = first_true(stop, m.size)
    is_g = (back == G) & (at - 1 <= compared[:, None])
    last = np.where(is_g.any(axis=1), width - 1 - is_g[:, ::-1].argmax(axis=1), 0) if width else m.size
    m.resize(np.maximum(m.size - 1 - last, 0), compared >= least)


def poly_x(m: Mates, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Trims the tail of one base; returns its number in ATCG (-1: none) and the bases removed."""
    back = m.backwards(m.seq)
    n, width = back.shape
    if not width:
        return np.full(n, -1), np.zeros(n, np.int64)
    at = np.arange(1, width + 1)[None, :]
    counts = np.stack([np.cumsum((back == b) | (back == N), axis=1) for b in (A, T, C, G)])
    stop = (at - counts > np.minimum(5, at // 8)).all(axis=0) & ((at - 1 >= 8) | (at + 1 >= least)) & m.inside
    pos = first_true(stop, m.size)
    seen = np.clip(np.minimum(pos, m.size - 1), 0, width - 1)
    base = np.take_along_axis(counts, seen[None, :, None], 2)[:, :, 0].argmax(axis=0)
    own = (back == np.array([A, T, C, G], np.uint8)[base][:, None]) & (at <= np.minimum(pos + 1, m.size)[:, None])
    k = np.where(own.any(axis=1), width - own[:, ::-1].argmax(axis=1), 0)
    k = np.where((pos + 1 >= least) & (m.size > 0), k, 0)
    m.resize(m.size - k)
    return np.where(k > 0, base, -1), k


# ---- overlap ----------------------------------------------------------------------------------


def windows(columns: np.ndarray) -> np.ndarray:
    """By position: the WINDOW bases from there on as two bits each, the first one lowest. Equal bases have equal bits, and so have some others: windows differ in at most as many places as their bases."""
    out = np.zeros((len(columns) + 1, columns.shape[1]), np.uint64)
    code = np.ascontiguousarray((columns >> 1) & 3)
    for k in range(len(columns) - 1, -1, -1):
        np.left_shift(out[k + 1], 2, out=out[k])
        out[k] |= code[k]
    return out


def overlap(m1: Mates, m2: Mates, least: int, most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(found, offset, length, differences) of the first accepted overlap of mate 1 and the reverse complement of mate 2.

    Offsets 0, 1, ... then 0, -1, ... up to `least` bases before an end, exclusive; accepted if the first 50 bases differ in at most the limit.
    Windows of 32 bases tell which rows may be accepted; those are compared whole. A row leaves the scan when it has its overlap."""
    n = len(m1.size)
    found, offset, length, diff = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    back = COMPLEMENT[m2.backwards(m2.seq)]
    rows = np.flatnonzero((m1.size > 0) & (m2.size > 0))
    at1, at2 = windows(m1.seq[rows].T), windows(back[rows].T)
    size1, size2 = m1.size[rows], m2.size[rows]

    def compare(own: np.ndarray, k: np.ndarray, sign: int) -> None:
        """Compare rows whole at offsets, which ascend; of those that are accepted a row has the first."""
        start1, start2 = (k, 0 * k) if sign > 0 else (0 * k, k)
        size = np.minimum(m1.size[own] - start1, m2.size[own] - start2)
        at = np.arange(int(size.max()))[None, :]
        a = m1.seq[own[:, None], np.minimum(start1[:, None] + at, m1.seq.shape[1] - 1)]
        b = back[own[:, None], np.minimum(start2[:, None] + at, back.shape[1] - 1)]
        differ = (a != b) & (at < size[:, None])
        near = np.flatnonzero(differ[:, :50].sum(axis=1) <= np.minimum(most, size * percent // 100))
        hit, first = np.unique(own[near], return_index=True)
        first = near[first]
        found[hit], offset[hit], length[hit], diff[hit] = True, sign * k[first], size[first], differ[first].sum(axis=1)

    for sign in (1, -1):
        last = max(len(at1), len(at2)) - 1
        for begin in range(0, last, STRIDE):
            keep = ~found[rows]
            if 2 * np.count_nonzero(keep) < len(rows):
                rows, at1, at2, size1, size2, keep = rows[keep], at1[:, keep], at2[:, keep], size1[keep], size2[keep], keep[keep]
            bound = np.where(size2 > least, np.maximum(size1 - least, 1), size1 - least) if sign > 0 else size2 - least  # of a row's offsets
            bound = np.where(keep, bound, 0)
            if not (begin < bound).any():
                break
            low1, low2 = int(size1.min()), int(size2.min())
            maybe = []
            for k in range(max(begin, int(sign < 0)), min(begin + STRIDE, last, int(bound.max()))):  # offset 0 is tried once
                live = k < bound
                wrong = at1[k] ^ at2[0] if sign > 0 else at1[0] ^ at2[k]
                wrong |= wrong >> 1
                if (min(low1 - k, low2) if sign > 0 else min(low1, low2 - k)) < WINDOW:  # some windows reach beyond their overlap
                    size = np.clip(np.minimum(size1 - k, size2) if sign > 0 else np.minimum(size1, size2 - k), 1, WINDOW)
                    wrong &= LOWER >> (2 * (WINDOW - size)).astype(np.uint64)
                else:
                    wrong &= LOWER
                live &= np.bitwise_count(wrong) <= most
                if np.count_nonzero(live):
                    maybe.append((k, rows[live]))
            own, k = np.concatenate([rows[:0], *(x for _, x in maybe)]), np.repeat([k for k, _ in maybe], [len(x) for _, x in maybe]).astype(np.int64)
            while len(own):
                compare(own[:2048], k[:2048], sign)
                own, k = own[2048:], k[2048:]
                own, k = own[~found[own]], k[~found[own]]
    return found, offset, length, diff


def correct(m1: Mates, m2: Mates, rows: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copy bases of good quality over differing ones of bad quality within the overlap; returns corrected bases and reads of each pair."""
    n = len(m1.size)
    bases, reads = np.zeros(n, np.int64), np.zeros(n, np.int64)
    own = np.flatnonzero(rows)
    if not len(own):
        return bases, reads
    for m in (m1, m2):
        m.seq, m.qual = m.seq.copy(), m.qual.copy()
    i = np.arange(int(length[own].max()))[None, :]
    ok = i < length[own][:, None]
    p1 = np.where(ok, i + np.maximum(offset[own], 0)[:, None], 0)
    p2 = np.where(ok, m2.size[own][:, None] - 1 - i - np.maximum(-offset[own], 0)[:, None], 0)
    r = own[:, None]
    s1, s2, q1, q2 = m1.seq[r, p1], COMPLEMENT[m2.seq[r, p2]], m1.qual[r, p1], m2.qual[r, p2]
    wrong = ok & (s1 != s2)
    to2, to1 = wrong & (q1 >= GOOD) & (q2 <= BAD), wrong & (q2 >= GOOD) & (q1 <= BAD)
    at, col = np.nonzero(to2)
    m2.seq[own[at], p2[at, col]], m2.qual[own[at], p2[at, col]] = COMPLEMENT[s1[at, col]], q1[at, col]
    at, col = np.nonzero(to1)
    m1.seq[own[at], p1[at, col]], m1.qual[own[at], p1[at, col]] = s2[at, col], q2[at, col]
    bases[own] = (to1 | to2).sum(axis=1)
    reads[own] = to1.any(axis=1).astype(int) + to2.any(axis=1)
    return bases, reads


def merged(m1: Mates, m2: Mates, rows: np.ndarray, offset: np.ndarray, length: np.ndarray) -> Mates:
    """Mate 1 up to the overlap's end, then what the reverse complement of mate 2 has beyond it; empty in other rows."""
    own = np.flatnonzero(rows)
    one, two = m1.take(own), m2.take(own)
    back, qual = COMPLEMENT[two.backwards(two.seq)], two.backwards(two.qual)
    len1 = length[own] + np.maximum(offset[own], 0)
    size = len1 + np.where(offset[own] > 0, two.size - length[own], 0)
    seq, quals, sizes = *(np.zeros((len(m1.size), int(size.max(initial=0))), np.uint8) for _ in range(2)), np.zeros(len(m1.size), np.int64)
    if seq.shape[1]:
        at = np.arange(seq.shape[1])[None, :]
        left, inside = at < len1[:, None], at < size[:, None]
        i1 = np.broadcast_to(np.minimum(at, one.seq.shape[1] - 1), left.shape)
        i2 = np.clip(at - (len1 - length[own])[:, None], 0, back.shape[1] - 1)
        for out, x, y in ((seq, one.seq, back), (quals, one.qual, qual)):
            out[own] = np.where(left, np.take_along_axis(x, i1, 1), np.take_along_axis(y, i2, 1)) * inside
    sizes[own] = size
    return Mates(seq, quals, sizes)


# ---- adapters ---------------------------------------------------------------------------------


def gap_near(ins: np.ndarray, normal: np.ndarray, size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether rows of ins, over a size of their own, match rows of normal with one base more, wherever it is; no beginning may be over the limit before it."""
    width = min(ins.shape[1] - 1, normal.shape[1])
    at = np.arange(width)[None, :]
    here = at < size[:, None]
    x = ((ins[:, :width] != normal[:, :width]) & here).astype(np.int16)
    y = ((ins[:, 1 : width + 1] != normal[:, :width]) & here).astype(np.int16)
    tail = np.take_along_axis(y, np.clip(size - 1, 0, max(width - 1, 0))[:, None], 1)
    before = np.cumsum(x, axis=1, dtype=np.int16)
    diff = before - np.cumsum(y, axis=1, dtype=np.int16) + y.sum(axis=1, dtype=np.int16)[:, None]
    open_ = at < (size - 1)[:, None]
    return (x[:, :1] + tail <= limit[:, None])[:, 0] & ~((before + tail > limit[:, None]) & open_).any(axis=1) & ((diff <= limit[:, None]) & open_).any(axis=1)


def find_adapter(m: Mates, adapter: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, position, bases that count as removed) of the first match: without gaps by position, then with one base inserted, then deleted."""
    n, size = len(m.size), m.size
    found, where, gone = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    a, k = np.frombuffer(adapter, np.uint8), len(adapter)
    if k < least or not m.seq.shape[1]:
        return found, where, gone
    can = size > least
    columns = np.ascontiguousarray(m.seq.T)
    start = -4 if k >= 16 else -3 if k >= 12 else -2 if k >= 8 else 0
    for pos in range(start, int(size.max(initial=0)) - least):
        live = can & ~found & (pos < size - least)
        if not live.any():
            break
        skip, begin = max(-pos, 0), max(pos, 0)
        span = np.minimum(size - pos, k)
        wrong = np.zeros(n, np.uint8)
        for i in range(min(PREFIX, int(span[live].min()) - skip)):
            wrong += columns[begin + i] != a[skip + i]
        own = np.flatnonzero(live & (wrong <= span // 8))
        if not len(own):
            continue
        span = span[own]
        part = m.seq[own, begin : begin + int(span.max()) - skip]
        w = part.shape[1]
        hit = ((part != a[None, skip : skip + w]) & (np.arange(w)[None, :] < (span - skip)[:, None])).sum(axis=1) <= span // 8
        at = own[hit]
        found[at], where[at] = True, begin
        gone[at] = k + pos if pos < 0 else size[at] - begin
    for insertion in (True, False):
        rows = np.flatnonzero(can & ~found)
        longest = k if insertion else k - 1
        if longest < 8 or not len(rows):
            continue
        seq = m.seq[rows, : k + 1]
        seq = np.pad(seq, ((0, 0), (0, k + 1 - seq.shape[1])))
        x = seq[:, :longest] != a[None, :longest]
        y = (seq[:, 1 : longest + 1] != a[None, :longest]) if insertion else (seq[:, :longest] != a[None, 1 : longest + 1])
        before, shifted = (np.cumsum(v, axis=1, dtype=np.int16) for v in (x, y))
        lowest = np.minimum.accumulate(before - shifted, axis=1)  # by the number of bases before the gap, from 1
        spans = np.arange(longest, 7, -1)
        fits = lowest[:, spans - 2] + shifted[:, spans - 1] <= (spans // 8 - 1)[None, :]
        free = size[rows][:, None] - insertion  # a whole span stands at the start; a shorter one at the read's end
        pos = np.where(spans[None, :] == longest, 0, free - spans[None, :])
        fits &= (spans[None, :] <= free) & (pos < free - least)
        hit = fits.any(axis=1)
        own, first = rows[hit], fits[hit].argmax(axis=1)
        found[own], where[own] = True, pos[hit, first]
        gone[own] = size[own] - where[own]
    return found, where, gone


def gap_overlap(m1: Mates, m2: Mates, rows: np.ndarray, least: int, most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, offset, length) of the first overlap with one base more in either mate, for the given rows."""
    n = len(m1.size)
    found, offset, length = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    back = COMPLEMENT[m2.backwards(m2.seq)]
    rows = np.flatnonzero(rows)
    for sign in (1, -1):
        for k in range(max(m1.seq.shape[1], back.shape[1])):
            own = rows[k < (m1.size if sign > 0 else m2.size)[rows] - least]
            if not len(own):
                break
            a, b = (m1.seq[own, k:], back[own]) if sign > 0 else (m1.seq[own], back[own, k:])
            size = np.minimum(m1.size[own] - k, m2.size[own]) if sign > 0 else np.minimum(m1.size[own], m2.size[own] - k)
            width = int(size.max(initial=0))
            if width < 3:
                continue
            a, b = (np.pad(x[:, :width], ((0, 0), (0, max(0, width - x.shape[1])))) for x in (a, b))
            limit = np.minimum(most, size * percent // 100)
            hit = (size >= 3) & (gap_near(a, b, size - 1, limit) | gap_near(b, a, size - 1, limit))
            found[own[hit]], offset[own[hit]], length[own[hit]] = True, sign * k, size[hit]
            rows = rows[~found[rows]]
    return found, offset, length
