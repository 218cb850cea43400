"""Column expressions over sequences and their encoded qualities (evaluated by Spark itself but for the k-mers' entropy)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PHRED_OFFSET = 33

# Nucleotide and ambiguity codes with their complements, and the bases that each code stands for.
IUPAC = "ACGTURYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAAYRSWMKVHDBN"
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


_CODE = np.full(256, 255, np.uint8)
for _k, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _k


def reverse_complement(seq: Column) -> Column:
    """A, C, G, T and U of either case complemented, anything else N; upper case."""
    return F.reverse(F.regexp_replace(F.translate(seq, "ACGTacgtUu", "TGCATGCAAA"), "[^ACGT]", "N"))


def iupac_reverse_complement(primer: Column) -> Column:
    """Reverse complement with ambiguity codes."""
    return F.reverse(F.translate(F.upper(primer), IUPAC, IUPAC_COMPLEMENT))


def n_count(seq: Column) -> Column:
    # strings are searched as bytes here; translate looks every symbol up
    without = F.replace(F.replace(seq, F.lit("N"), F.lit("")), F.lit("n"), F.lit(""))
    return F.length(seq) - F.length(without)


def is_acgt(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def phred(qual: Column, offset: int = PHRED_OFFSET) -> Column:
    """Quality scores of an encoded quality string."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)


def quality_cut(qual: Column, threshold: int, offset: int = PHRED_OFFSET) -> Column:
    """Bases before the first with a quality of ``threshold`` or less; the whole length if there is none."""
    low = "".join(rf"\x{c:02x}" for c in (offset, offset + threshold))
    at = F.regexp_instr(qual, F.lit(f"[{low[:4]}-{low[4:]}]"))
    return F.when(at == 0, F.length(qual)).otherwise(at - 1)


def expected_errors(qual: Column, offset: int = PHRED_OFFSET) -> Column:
    """Sum of error probabilities (F8)."""
    return F.aggregate(F.split(qual, ""), F.lit(0.0), lambda acc, c: acc + F.pow(F.lit(10.0), -(F.ascii(c) - offset) / 10))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once a row: inside a higher-order function a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmers(seq: Column, k: int) -> Column:
    """All windows of ``k`` bases in order."""
    windows = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    return bound(seq, lambda s: F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(windows(s)))


#: Counts of k-mers that are held at once.
HELD_COUNTS = 1 << 22


def effective_kmers_many(seqs: list[str | None], k: int = 2) -> np.ndarray:
    """:func:`effective_kmers` of many sequences at once; NaN for null."""
    out = np.full(len(seqs), np.nan)
    rows = max(HELD_COUNTS // 4**k, 1)
    for lo in range(0, len(seqs), rows):
        part = seqs[lo : lo + rows]
        # a symbol that is no base ends every sequence, so no k-mer spans two of them
        codes = _CODE[np.frombuffer("\n".join([*(x or "" for x in part), ""]).encode("latin-1", "replace"), np.uint8)]
        row = np.repeat(np.arange(len(part)), [len(x or "") + 1 for x in part])
        value, ok = np.zeros(max(len(codes) - k + 1, 0), np.int64), np.ones(max(len(codes) - k + 1, 0), bool)
        for i in range(k):
            c = codes[i : i + len(value)]
            ok &= c < 4
            value = value * 4 + c
        n = np.bincount(row[: len(value)][ok] * 4**k + value[ok], minlength=len(part) * 4**k).reshape(len(part), 4**k).astype(float)
        total = n.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.where(n > 0, n * np.log(n), 0.0).sum(axis=1)
            out[lo : lo + rows] = np.where(total > 0, np.exp(np.log(total) - spread / total), 0.0)
    return np.where([x is None for x in seqs], np.nan, out)


def effective_kmers(seq: Column, k: int = 2) -> Column:
    """exp of the Shannon entropy of the k-mers without ambiguous bases; 0 if there are none (K23, F10). Counted for a batch at once."""

    @F.pandas_udf("double")
    def run(seqs: pd.Series) -> pd.Series:
        return pd.Series(effective_kmers_many([None if x is None else x for x in seqs], k))

    return F.when(seq.isNotNull(), run(seq))


def sequence_id(seq: Column, algorithm: str = "md5") -> Column:
    """Hexadecimal id of a sequence."""
    if algorithm not in ("md5", "sha1"):
        raise ValueError(f"unknown hash algorithm {algorithm!r}")
    return F.md5(seq) if algorithm == "md5" else F.sha1(seq)


def primer_pattern(primer: str) -> str:
    """Regular expression of a primer with ambiguity codes."""
    return "".join(c if len(b := IUPAC_BASES[c]) == 1 and c != "U" else f"[{b}]" for c in primer.upper())


def requantised(qual: Column, bins: list[int], offset: int = PHRED_OFFSET, highest: int = 93) -> Column:
    """Qualities moved to the nearest bin, the lower one of two equally near."""
    nearest = [min(bins, key=lambda b: (abs(b - q), b)) for q in range(highest + 1)]
    return F.translate(qual, "".join(chr(offset + q) for q in range(highest + 1)), "".join(chr(offset + b) for b in nearest))


def _differing(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the places at which two sequences differ, over the shorter length, and that length."""

    def places(x: Column) -> Column:
        n = F.least(F.length(x["a"]), F.length(x["b"]))
        every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return body(F.filter(every, lambda i: F.substring(x["a"], i, F.lit(1)) != F.substring(x["b"], i, F.lit(1))), n)

    return bound(F.struct(a.alias("a"), b.alias("b")), places).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two sequences."""
    return _differing(a, b, lambda places, n: F.coalesce(F.get(places, F.lit(0)) - 1, n))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ, over the shorter length."""
    return _differing(a, b, lambda places, _: F.size(places))
