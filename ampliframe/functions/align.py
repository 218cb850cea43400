"""Pairwise alignment kernels in numpy: one sequence against many of equal length at a time.

Scores follow the inventory's K11 to K24: free terminal gaps, a band widened by
the length difference, and ties decided up, then left, then diagonal. A batch
runs the recurrence over anti-diagonals with one lane per pair, so the Python
overhead is per diagonal and not per cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAP = ord("-")
NO_POSITION = 9999
_DIAG, _LEFT, _UP = 1, 2, 3
_OUT_OF_BAND = -9999
MIN_HOMOPOLYMER = 3


@dataclass(frozen=True)
class Scoring:
    match: int = 5
    mismatch: int = -4
    gap: int = -8
    homopolymer_gap: int | None = None
    band: int = 16

    def __post_init__(self):
        object.__setattr__(self, "gap", -abs(self.gap))
        if self.homopolymer_gap is not None:
            object.__setattr__(self, "homopolymer_gap", -abs(self.homopolymer_gap))


def encoded(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode(), np.uint8)


def homopolymer_runs(s: np.ndarray) -> np.ndarray:
    """Whether each base lies in a run of three or more."""
    if not len(s):
        return np.zeros(0, bool)
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(cut, append=len(s))
    return np.repeat(size >= MIN_HOMOPOLYMER, size)


def _band(n1: int, n2: int, band: int) -> tuple[int, int]:
    """Widths to the left and right of the diagonal."""
    if band < 0:
        return n1 + n2, n1 + n2
    return (band + n1 - n2, band) if n1 > n2 else (band, band + n2 - n1)


def _pointers(first: np.ndarray, many: np.ndarray, scoring: Scoring, free_ends: bool) -> np.ndarray:
    """Traceback of ``first`` (i) against each row of ``many`` (j): i + j by i by lanes.

    Only the last two anti-diagonals of scores are kept, lanes side by side, so every step works on slices.
    """
    lanes, n2 = many.shape
    n1 = len(first)
    left_width, right_width = _band(n1, n2, scoring.band)
    gap = np.int32(scoring.gap)
    homo = scoring.homopolymer_gap
    use_homo = homo is not None and homo != scoring.gap
    if use_homo:
        left_gaps = np.where(np.stack([homopolymer_runs(m) for m in many]).T, homo, gap).astype(np.int32)
        up_gaps = np.where(homopolymer_runs(first), homo, gap).astype(np.int32)[:, None]
    rows, columns = first[:, None], np.ascontiguousarray(many.T)[::-1]
    match, mismatch = np.int32(scoring.match), np.int32(scoring.mismatch)
    border = 0 if free_ends else scoring.gap
    p = np.zeros((n1 + n2 + 1, n1 + 1, lanes), np.uint8)
    p[1 : n2 + 1, 0] = _LEFT
    p[np.arange(1, n1 + 1), np.arange(1, n1 + 1)] = _UP
    blank = np.full((n1 + 1, lanes), _OUT_OF_BAND, np.int32)
    older, last, now = blank.copy(), blank.copy(), blank.copy()
    last[0] = 0
    for s in range(1, n1 + n2 + 1):
        now[:] = _OUT_OF_BAND
        if s <= n2 and (scoring.band < 0 or s <= right_width):
            now[0] = s * border
        if s <= n1 and (scoring.band < 0 or s <= left_width):
            now[s] = s * border
        lo, hi = max(1, s - n2), min(n1, s - 1)
        lo, hi = max(lo, -(-(s - right_width) // 2)), min(hi, (s + left_width) // 2)
        if lo <= hi:
            # the column of row i is s - i, and columns are stored backwards
            mine = slice(n2 - s + lo, n2 - s + hi + 1)
            left = last[lo : hi + 1] + (left_gaps[::-1][mine] if use_homo else gap)
            up = last[lo - 1 : hi] + (up_gaps[lo - 1 : hi] if use_homo else gap)
            if free_ends:
                if hi == n1:
                    left[-1] = last[hi]
                if s - lo == n2:
                    up[0] = last[lo - 1]
            diag = older[lo - 1 : hi] + np.where(columns[mine] == rows[lo - 1 : hi], match, mismatch)
            sides = np.maximum(up, left)
            now[lo : hi + 1] = np.maximum(sides, diag)
            p[s, lo : hi + 1] = np.where(diag > sides, np.uint8(_DIAG), np.where(up >= left, np.uint8(_UP), np.uint8(_LEFT)))
        older, last, now = last, now, older
    return p


def _traced(first: np.ndarray, second: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = len(first), len(second)
    a, b = [], []
    while i or j:
        step = p[i + j, i]
        if step == _DIAG:
            i, j = i - 1, j - 1
            a.append(first[i])
            b.append(second[j])
        elif step == _LEFT:
            j -= 1
            a.append(GAP)
            b.append(second[j])
        else:
            i -= 1
            a.append(first[i])
            b.append(GAP)
    return np.array(a[::-1], np.uint8), np.array(b[::-1], np.uint8)


def align_many(first: np.ndarray, many: list[np.ndarray], scoring: Scoring = Scoring(), free_ends: bool = True, lanes: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gapped sequences of ``first`` against each of ``many``."""
    out: list = [None] * len(many)
    by_length: dict[int, list[int]] = {}
    for k, m in enumerate(many):
        by_length.setdefault(len(m), []).append(k)
    for group in by_length.values():
        for lo in range(0, len(group), lanes):
            part = group[lo : lo + lanes]
            stacked = np.stack([many[k] for k in part])
            p = _pointers(first, stacked, scoring, free_ends)
            for lane, k in enumerate(part):
                out[k] = _traced(first, many[k], p[:, :, lane])
    return out


def align(a: str, b: str, scoring: Scoring = Scoring(), free_ends: bool = True) -> tuple[str, str]:
    x, y = align_many(encoded(a), [encoded(b)], scoring, free_ends)[0]
    return x.tobytes().decode(), y.tobytes().decode()


def gapless(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences from their starts, the shorter padded on the right."""
    n = max(len(first), len(second))
    return tuple(np.concatenate([s, np.full(n - len(s), GAP, np.uint8)]) for s in (first, second))


# --- what an alignment says ---------------------------------------------------


@dataclass(frozen=True)
class Substitutions:
    """Substitutions of a query against a reference (K19): positions in each, bases, and where each reference base went."""

    ref_positions: np.ndarray
    query_positions: np.ndarray
    ref_bases: np.ndarray
    query_bases: np.ndarray
    position_map: np.ndarray

    @property
    def hamming(self) -> int:
        return len(self.ref_positions)


def substitutions(ref: np.ndarray, query: np.ndarray) -> Substitutions:
    r_base, q_base = ref != GAP, query != GAP
    r_pos, q_pos = np.cumsum(r_base) - 1, np.cumsum(q_base) - 1
    both = r_base & q_base
    mapping = np.where(both, q_pos, NO_POSITION)[r_base]
    n = ord("N")
    hit = both & (ref != query) & (ref != n) & (query != n)
    return Substitutions(r_pos[hit], q_pos[hit], ref[hit], query[hit], mapping)


def evaluate(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Matches, mismatches and indels between the terminal gaps: from where each strand has shown a base to where each has its last."""
    x, y = np.flatnonzero(a != GAP), np.flatnonzero(b != GAP)
    if not len(x) or not len(y):
        return 0, 0, 0
    lo, hi = max(x[0], y[0]), min(x[-1], y[-1])
    a, b = a[lo : hi + 1], b[lo : hi + 1]
    gap = (a == GAP) | (b == GAP)
    same = ~gap & (a == b)
    return int(same.sum()), int((~gap & ~same).sum()), int(gap.sum())


def hamming_ends_free(a: np.ndarray, b: np.ndarray) -> int:
    """Mismatches and indels between the terminal gaps."""
    _, mismatch, indel = evaluate(a, b)
    return mismatch + indel


def consensus(a: np.ndarray, b: np.ndarray, prefer: int = 1, trim_overhang: bool = False) -> np.ndarray:
    """One sequence from two aligned ones; where they differ, strand 1 or 2, or N for 0."""
    out = np.where(a == b, a, {1: a, 2: b}.get(prefer, np.full_like(a, ord("N"))))
    out = np.where(a == GAP, b, np.where(b == GAP, a, out))
    inner = (a == GAP) | (b == GAP)
    x, y = np.flatnonzero(a != GAP), np.flatnonzero(b != GAP)
    if len(x) and len(y):
        lo, hi = max(x[0], y[0]), min(x[-1], y[-1])
        inner[:lo] = False
        inner[hi + 1 :] = False
        chosen = {1: a, 2: b}.get(prefer)
        if chosen is not None:
            out = np.where(inner, chosen, out)
        if trim_overhang:
            keep = np.ones(len(a), bool)
            keep[:lo] = (a != GAP)[:lo] & (x[0] < y[0])
            keep[hi + 1 :] = (b != GAP)[hi + 1 :] & (y[-1] > x[-1])
            out = out[keep]
    return out[out != GAP]


def divergence(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Edits and columns between terminal gaps, and the band that the alignment needs."""
    offset = np.abs(np.cumsum((b == GAP).astype(int) - (a == GAP).astype(int)))
    match, mismatch, indel = evaluate(a, b)
    return mismatch + indel, match + mismatch + indel, int(offset.max(initial=0))


# --- k-mers ---------------------------------------------------------------------

_CODE = np.full(256, 255, np.uint8)
for _k, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _k


def kmer_indices(seq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Base-4 number of every window, and whether it has only A, C, G, T."""
    n = len(seq) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    code = _CODE[seq].astype(np.int64)
    value, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        c = code[i : i + n]
        ok &= c < 4
        value = value * 4 + np.minimum(c, 3)
    return value, ok


def kmer_vector(seq: np.ndarray, k: int) -> np.ndarray:
    """Counts of all 4**k k-mers; windows with other symbols are skipped (K5)."""
    value, ok = kmer_indices(seq, k)
    return np.bincount(value[ok], minlength=4**k).astype(np.uint16)


def ordered_kmers(seq: np.ndarray, k: int) -> np.ndarray:
    """k-mer numbers in order, 0 for windows with other symbols (K7)."""
    value, ok = kmer_indices(seq, k)
    return np.where(ok, value, 0).astype(np.uint16)


def kmer_distances(vector: np.ndarray, length: int, vectors: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """1 - shared k-mers / windows of the shorter, of one against many (K8)."""
    shared = np.minimum(vectors, vector).sum(axis=1, dtype=np.int64)
    return 1.0 - shared / (np.minimum(lengths, length) - k + 1)


def ordered_distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 - equal places / windows; -1 for different lengths (K9)."""
    return 1.0 - float((a == b).sum()) / len(a) if len(a) == len(b) and len(a) else -1.0
