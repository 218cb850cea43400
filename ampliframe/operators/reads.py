"""Read filters, pairs, primers and quality summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliframe.functions import sequences as sq
from ampliframe.functions.align import encoded
from ampliframe.params import FilterParams, PrimerParams


def filtered(reads: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    """Reads that pass, cut as the parameters say; the steps keep their fixed order (T22), all inside one stage."""
    p, out = params, reads
    if p.max_len:
        out = out.where(F.length("seq") <= p.max_len)
    if p.trim_left or p.trim_right:
        out = _cut(out.where(F.length("seq") > p.trim_left + p.trim_right), F.lit(p.trim_left + 1), F.length("seq") - p.trim_left - p.trim_right)
    if p.trunc_q:
        out = _cut(out, F.lit(1), sq.quality_cut(F.col("qual"), p.trunc_q, p.offset))
    if p.trunc_len:
        out = _cut(out.where(F.length("seq") >= p.trunc_len), F.lit(1), F.lit(p.trunc_len))
    if p.min_len:
        out = out.where(F.length("seq") >= p.min_len)
    if p.max_n is not None:
        out = out.where(sq.n_count(F.col("seq")) <= p.max_n)
    if p.min_q:
        out = out.where(F.array_min(sq.phred(F.col("qual"), p.offset)) >= p.min_q)
    if p.max_ee is not None:
        out = out.where(sq.expected_errors(F.col("qual"), p.offset) <= p.max_ee)
    if p.low_complexity:
        out = out.where(sq.effective_kmers(F.col("seq")) >= p.low_complexity)
    return out


def _cut(reads: DataFrame, start: Column, length: Column) -> DataFrame:
    return reads.withColumn("_n", length).withColumns({c: F.substring(c, start, F.col("_n")) for c in ("seq", "qual")}).drop("_n")


def filtered_pairs(forward: DataFrame, reverse: DataFrame, params: FilterParams = FilterParams(), reverse_params: FilterParams | None = None) -> DataFrame:
    """Pairs of which both mates pass (T24, J1): ``sample_id, read_no, seq_f, qual_f, seq_r, qual_r``."""
    keys = ["sample_id", "read_no"]
    f = filtered(forward, params).select(*keys, F.col("seq").alias("seq_f"), F.col("qual").alias("qual_f"))
    r = filtered(reverse, reverse_params or params).select(*keys, F.col("seq").alias("seq_r"), F.col("qual").alias("qual_r"))
    return f.join(r, keys)


def filter_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """``sample_id, reads_in, reads_out, bases_in, bases_out`` of a filter; samples that lose all reads stay."""
    summed = lambda df, side: df.groupBy("sample_id").agg(F.count("*").alias(f"reads_{side}"), F.sum(F.length("seq")).alias(f"bases_{side}"))
    joined = summed(before, "in").join(summed(after, "out"), "sample_id", "left").na.fill(0)
    return joined.select("sample_id", "reads_in", "reads_out", "bases_in", "bases_out")


def without_phix(reads: DataFrame, genome: str, word: int = 16, min_hits: int = 2) -> DataFrame:
    """Reads with fewer than ``min_hits`` separate words of a circular genome, on either strand."""
    both = [genome.upper(), "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(genome.upper()))]
    words = frozenset(g2[i : i + word] for g in both for g2 in [g + g[: word - 1]] for i in range(len(g)))

    @F.pandas_udf("boolean")
    def contaminated(seqs: pd.Series) -> pd.Series:
        def hit(s: str) -> bool:
            found = at = 0
            while at <= len(s) - word:
                if s[at : at + word] in words:
                    found += 1
                    if found >= min_hits:
                        return True
                    at += word
                else:
                    at += 1
            return False

        return seqs.map(hit)

    return reads.where(~contaminated("seq"))


# --- primers ---------------------------------------------------------------------

_MASK = np.zeros(256, np.uint8)
for _code, _bases in sq.IUPAC_BASES.items():
    _MASK[ord(_code)] = sum(1 << "ACGT".index(b) for b in _bases)


def find_primer(seq: str, primer: str, max_mismatch: int, last: bool = False) -> tuple[int, int] | None:
    """First (or last) place of a primer with at most ``max_mismatch`` mismatches; bases beyond the read's ends are mismatches."""
    s, p = _MASK[encoded(seq)], _MASK[encoded(primer)]
    n, k = len(s), len(p)
    if not n or not k:
        return None
    padded = np.concatenate([np.zeros(max_mismatch, np.uint8), s, np.zeros(max_mismatch, np.uint8)])
    if len(padded) < k:
        return None
    windows = np.lib.stride_tricks.sliding_window_view(padded, k)
    hits = np.flatnonzero(((windows & p) == 0).sum(axis=1) <= max_mismatch) - max_mismatch
    if not len(hits):
        return None
    at = int(hits[-1] if last else hits[0])
    return max(at, 0), min(at + k, n)


def find_primer_indels(seq: str, primer: str, max_edits: int, last: bool = False) -> tuple[int, int] | None:
    """As :func:`find_primer` with insertions and deletions counted as edits; smallest (largest) start, then end (F16)."""
    s, p = _MASK[encoded(seq)], _MASK[encoded(primer)]
    n, k = len(s), len(p)
    best: list[tuple[int, int]] = []
    cost = np.arange(k + 1)
    start = np.zeros(k + 1, int)
    for j in range(n + 1):
        if j:
            new, begin = cost.copy(), start.copy()
            new[0], begin[0] = 0, j
            for i in range(1, k + 1):
                options = ((cost[i - 1] + (0 if s[j - 1] & p[i - 1] else 1), start[i - 1]), (cost[i] + 1, start[i]), (new[i - 1] + 1, begin[i - 1]))
                new[i], begin[i] = min(options, key=lambda o: (o[0], o[1]))
            cost, start = new, begin
        if cost[k] <= max_edits:
            best.append((int(start[k]), j))
    return (max(best) if last else min(best)) if best else None


def _reversed(seq: str, qual: str) -> tuple[str, str]:
    table = str.maketrans("ACGTUacgtu", "TGCAATGCAA")
    return "".join(c if c in "ACGT" else "N" for c in seq.translate(table))[::-1], qual[::-1]


def trimmed(seq: str, qual: str, params: PrimerParams) -> tuple[str, str] | None:
    """A read without its primers, or none if a primer is missing; tries the other strand if told to."""
    find = find_primer_indels if params.allow_indels else find_primer
    reverse = "".join(sq.IUPAC_COMPLEMENT[sq.IUPAC.index(c)] for c in reversed(params.reverse.upper())) if params.reverse else ""
    for s, q in ((seq, qual), _reversed(seq, qual))[: 2 if params.orient else 1]:
        head = find(s, params.forward.upper(), params.max_mismatch) if params.forward else (0, 0)
        tail = find(s, reverse, params.max_mismatch, True) if reverse else (len(s), len(s))
        if head is not None and tail is not None:
            lo = head[1] if params.trim_forward else head[0]
            hi = tail[0] if params.trim_reverse else tail[1]
            if lo < hi:
                return s[lo:hi], q[lo:hi]
    return None


def _tables(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of single bytes as rows of a table filled up with zeros, and their lengths."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(length.max(initial=0))
    joined = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    if len(joined) == len(texts) * width:
        return joined.reshape(len(texts), width), length
    out = np.zeros((len(texts), width), np.uint8)
    out[np.arange(width) < length[:, None]] = joined
    return out, length


def find_primer_many(masks: np.ndarray, length: np.ndarray, primer: str, max_mismatch: int, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`find_primer` in many reads at once: whether it is there, its starts and ends. ``masks``: bases as bits, zeros beyond a read's end."""
    p = _MASK[encoded(primer)]
    k, (rows, width) = len(p), masks.shape
    found, at = np.zeros(rows, bool), np.zeros(rows, np.int64)
    if k and width:
        padded = np.pad(masks, ((0, 0), (max_mismatch, max_mismatch + k)))
        # places from -max_mismatch on; the last one of a read ends max_mismatch beyond it
        order = range(width + 2 * max_mismatch - k, -1, -1) if last else range(width + 2 * max_mismatch - k + 1)
        left = np.flatnonzero(length > 0)
        for start in order:
            mine = left[start + k <= length[left] + 2 * max_mismatch]
            hit = mine[((padded[mine, start : start + k] & p) == 0).sum(axis=1) <= max_mismatch]
            found[hit], at[hit] = True, start - max_mismatch
            left = left[~found[left]]
            if not len(left):
                break
    return found, np.maximum(at, 0), np.minimum(at + k, length)


def trimmed_many(seqs: list[str], quals: list[str], params: PrimerParams) -> list[tuple[str, str] | None]:
    """:func:`trimmed` of many reads at once where primers have no indels; bases are single bytes."""
    reverse = "".join(sq.IUPAC_COMPLEMENT[sq.IUPAC.index(c)] for c in reversed(params.reverse.upper())) if params.reverse else ""
    out: list[tuple[str, str] | None] = [None] * len(seqs)
    rest = np.arange(len(seqs))
    for strand in range(2 if params.orient else 1):
        mine = [(seqs[i], quals[i]) if strand == 0 else _reversed(seqs[i], quals[i]) for i in rest.tolist()]
        table, length = _tables([s for s, _ in mine])
        masks = _MASK[table]
        ok, lo, hi = np.ones(len(mine), bool), np.zeros(len(mine), np.int64), length.copy()
        if params.forward:
            found, start, end = find_primer_many(masks, length, params.forward.upper(), params.max_mismatch)
            ok, lo = ok & found, end if params.trim_forward else start
        if reverse:
            found, start, end = find_primer_many(masks, length, reverse, params.max_mismatch, True)
            ok, hi = ok & found, start if params.trim_reverse else end
        ok &= lo < hi
        for place in np.flatnonzero(ok).tolist():
            s, q = mine[place]
            out[rest[place]] = s[lo[place] : hi[place]], q[lo[place] : hi[place]]
        rest = rest[~ok]
    return out


def primers_removed(reads: DataFrame, params: PrimerParams) -> DataFrame:
    """All reads with ``outcome`` (passed, no_primer or filter_fail), those that passed trimmed.

    The filter's steps for contaminants and complexity apply here too where they
    are asked for (T23: a documented difference).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if params.allow_indels or not all(s.isascii() for s in pdf["seq"]):
                found = [trimmed(s, q, params) for s, q in zip(pdf["seq"], pdf["qual"], strict=True)]
            else:
                found = trimmed_many(list(pdf["seq"]), list(pdf["qual"]), params)
            pdf["outcome"] = ["no_primer" if f is None else "passed" for f in found]
            pdf["seq"] = [s if f is None else f[0] for f, s in zip(found, pdf["seq"], strict=True)]
            pdf["qual"] = [q if f is None else f[1] for f, q in zip(found, pdf["qual"], strict=True)]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema) + ", outcome string"
    out = reads.mapInPandas(run, schema)
    if params.filter is None:
        return out
    passed = filtered(out.where("outcome = 'passed'"), params.filter)
    kept = passed.select("sample_id", "read_no").withColumn("_kept", F.lit(True))
    joined = out.join(kept, ["sample_id", "read_no"], "left")
    failed = F.when((F.col("outcome") == "passed") & F.col("_kept").isNull(), F.lit("filter_fail")).otherwise(F.col("outcome"))
    return joined.withColumn("outcome", failed).drop("_kept").where("outcome <> 'passed'").unionByName(passed)


def outcome_counts(reads: DataFrame) -> DataFrame:
    """Reads by sample and outcome."""
    return reads.groupBy("sample_id", "outcome").agg(F.count("*").alias("n"))


# --- summaries -------------------------------------------------------------------


def per_base(reads: DataFrame, offset: int = 33) -> DataFrame:
    """``sample_id, pos, q`` and the read's name of every base."""
    return reads.select("sample_id", "read_id", F.posexplode(sq.phred(F.col("qual"), offset)).alias("pos", "q"))


def cycle_quality(reads: DataFrame) -> DataFrame:
    return per_base(reads).groupBy("sample_id", "pos").agg(F.avg("q").alias("mean_q"), F.count("*").alias("coverage"))


def cycle_histogram(reads: DataFrame) -> DataFrame:
    return per_base(reads).groupBy("sample_id", "pos", "q").agg(F.count("*").alias("n"))


def cumulative_errors(reads: DataFrame, offset: int = 33) -> DataFrame:
    """``sample_id, pos, ee``: expected errors of every read up to each position, summed inside the row, without a shuffle."""
    probability = F.transform(sq.phred(F.col("qual"), offset), lambda q: F.pow(F.lit(10.0), -q / 10))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    running = F.aggregate(
        probability,
        start,
        lambda acc, p: F.struct((acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all")),
        lambda acc: acc["all"],
    )
    return reads.select("sample_id", F.posexplode(running).alias("pos", "ee"))


#: Cells of the histogram that a task holds before it passes them on.
HELD_CELLS = 1 << 22


def _error_cells(bins: int, offset: int):
    """Of a task's reads: ``sample_id, pos, bin, n, s, lo, hi``, expected errors up to each position added up by cell."""
    rate = 10.0 ** (-(np.arange(256) - offset) / 10)

    def rows(sample: str | None, cells: list[np.ndarray]) -> pa.RecordBatch:
        pos, cell = np.nonzero(cells[0])
        own = [pa.array(x[pos, cell]) for x in cells]
        return pa.RecordBatch.from_arrays([pa.array([sample] * len(pos), pa.string()), pa.array(pos.astype(np.int32)), pa.array(cell.astype(np.int32)), *own], ["sample_id", "pos", "bin", "n", "s", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[np.ndarray]] = {}
        for batch in batches:
            samples = batch.column(0).dictionary_encode(null_encoding="encode")
            of = samples.indices.to_numpy()
            table, length = _tables([q or "" for q in batch.column(1).to_pylist()])
            width = table.shape[1]
            for k, sample in enumerate(samples.dictionary.to_pylist()):
                mine = of == k
                ee = np.cumsum(rate[table[mine]], axis=1)
                cell = np.clip(np.floor((np.log10(np.maximum(ee, 1e-300)) + 4) / 7 * bins), 0, bins - 1).astype(np.int64)
                there = np.arange(width) < length[mine][:, None]
                at, ee = (np.arange(width) * bins + cell)[there], ee[there]
                known = held.setdefault(sample, [np.zeros((0, bins), np.int64), np.zeros((0, bins)), np.zeros((0, bins)), np.zeros((0, bins))])
                if len(known[0]) < width:
                    more = ((0, width - len(known[0])), (0, 0))
                    known[:] = [np.pad(x, more, constant_values=fill) for x, fill in zip(known, (0, 0.0, np.inf, -np.inf), strict=True)]
                n, total, lo, hi = (x.reshape(-1) for x in known)
                size = width * bins
                n[:size] += np.bincount(at, minlength=size)
                total[:size] += np.bincount(at, ee, size)
                np.minimum.at(lo, at, ee)
                np.maximum.at(hi, at, ee)
            if sum(x[0].size for x in held.values()) > HELD_CELLS:
                yield from (rows(sample, x) for sample, x in held.items())
                held = {}
        yield from (rows(sample, x) for sample, x in held.items())

    return run


def cumulative_error_summary(reads: DataFrame, bins: int = 200, offset: int = 33) -> DataFrame:
    """Mean, least, most and quartiles of expected errors by position; quartiles from a histogram of log10 over -4..3."""
    cells = reads.select("sample_id", "qual").mapInArrow(_error_cells(bins, offset), "sample_id string, pos int, bin int, n long, s double, lo double, hi double")
    hist = cells.groupBy("sample_id", "pos", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    place = Window.partitionBy("sample_id", "pos")
    upto = F.sum("n").over(place.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumn("upto", upto).withColumn("total", F.sum("n").over(place))
    centre = F.pow(F.lit(10.0), (F.col("bin") + 0.5) / bins * 7 - 4)
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), centre))
    return hist.groupBy("sample_id", "pos").agg(
        (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        quantile(0.25).alias("q25"), quantile(0.5).alias("median"), quantile(0.75).alias("q75"),
    )


def complexity_histogram(reads: DataFrame, k: int = 2, bins: int = 100) -> DataFrame:
    """Reads by complexity bin."""
    cell = F.least(F.floor(sq.effective_kmers(F.col("seq"), k) / 4**k * bins), F.lit(bins - 1)).cast("int")
    return reads.groupBy("sample_id", cell.alias("bin")).agg(F.count("*").alias("n"))


def quality_values(reads: DataFrame) -> DataFrame:
    return per_base(reads).groupBy("sample_id", "q").agg(F.count("*").alias("n"))


def binned_verdict(values: DataFrame, most: int = 8) -> DataFrame:
    """Whether a sample's qualities are binned: between 2 and ``most`` different values."""
    return values.groupBy("sample_id").agg(F.count("q").alias("n_values")).withColumn("binned", F.col("n_values").between(2, most))


def merged_summary(values: DataFrame, expected: list[int] | None = None) -> DataFrame:
    """Counts over all samples, and whether each value is among the expected bins."""
    merged = values.groupBy("q").agg(F.sum("n").alias("n"))
    return merged if expected is None else merged.withColumn("expected", F.col("q").isin(expected))


def step_tracking(**steps: DataFrame) -> DataFrame:
    """Reads of every sample after each step, 0 where a sample is gone (J15). Each step: ``sample_id, n``."""
    tables = [df.select("sample_id", F.col("n").alias(name)) for name, df in steps.items()]
    joined = reduce(lambda a, b: a.join(b, "sample_id", "full"), tables)
    return joined.na.fill(0, list(steps))


