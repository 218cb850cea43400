"""Error models: transition counts in long form, fitted rates, and the self-consistent learning loop.

Counts and rates are long tables ``ref_nt, query_nt, q, n | rate``. The fits
work on at most 16 by 94 numbers on the driver; everything that grows with the
reads is added up by Spark.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliframe.functions.stats import loess, poisson_upper_tail
from ampliframe.operators.denoise import transition_counts
from ampliframe.operators.derep import within_bases
from ampliframe.params import DenoiseParams, LearnParams

NT = "ACGT"
DIAGONAL = (0, 5, 10, 15)
ROWS = [f"{a}2{b}" for a in NT for b in NT]


def accumulated(counts: DataFrame) -> DataFrame:
    """Transitions of all samples added up (E5)."""
    return counts.groupBy("ref_nt", "query_nt", "q").agg(F.sum("n").alias("n"))


def noqual_rates(counts: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """Rates that don't depend on quality (E7): ``ref_nt, query_nt, rate``."""
    spark = counts.sparkSession
    cells = spark.createDataFrame([(a, b) for a in NT for b in NT], "ref_nt string, query_nt string")
    sums = counts.groupBy("ref_nt", "query_nt").agg(F.sum("n").alias("n"))
    full = cells.join(sums, ["ref_nt", "query_nt"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + pseudocount)
    return full.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("ref_nt"))).drop("n")


def inflated(rates: DataFrame, factor: float) -> DataFrame:
    """Rates r as k r / (1 + (k - 1) r)."""
    return rates.withColumn("rate", factor * F.col("rate") / (1 + (factor - 1) * F.col("rate")))


def to_matrix(counts: DataFrame, nq: int) -> np.ndarray:
    """16 by ``nq`` counts; the table has at most so many rows."""
    out = np.zeros((16, nq))
    for r in accumulated(counts).collect():
        if r["q"] < nq:
            out[NT.index(r["ref_nt"]) * 4 + NT.index(r["query_nt"]), r["q"]] = r["n"]
    return out


def to_table(spark: SparkSession, rates: np.ndarray) -> DataFrame:
    rows = [(NT[i // 4], NT[i % 4], q, float(rates[i, q])) for i in range(16) for q in range(rates.shape[1])]
    return spark.createDataFrame(rows, "ref_nt string, query_nt string, q int, rate double")


def _with_diagonal(rates: np.ndarray) -> np.ndarray:
    for r in range(4):
        others = [4 * r + c for c in range(4) if c != r]
        rates[5 * r] = 1 - rates[others].sum(axis=0)
    return rates


def _totals(counts: np.ndarray, row: int) -> np.ndarray:
    return counts[4 * (row // 4) : 4 * (row // 4) + 4].sum(axis=0)


def loess_rates(counts: np.ndarray, params: LearnParams = LearnParams(), surface: str = "interpolate") -> np.ndarray:
    """Local regression of log10 rates on quality, weighted by reads."""
    q = np.arange(counts.shape[1], dtype=float)
    out, fitted = np.full(counts.shape, params.min_rate), 0
    for row in range(16):
        if row in DIAGONAL:
            continue
        total = _totals(counts, row)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.where(total > 0, np.log10((counts[row] + 1) / total), np.nan)
        fit = loess(q, y, total, q, surface=surface)
        if np.isfinite(fit).any():
            fitted += 1
        rate = 10.0 ** np.where(np.isfinite(fit), fit, np.log10(params.min_rate))
        out[row] = np.clip(rate, params.min_rate, params.max_rate)
    if not fitted:
        raise ValueError("no transition has enough reads for a fit")
    return _with_diagonal(out)


def noqual_matrix(counts: np.ndarray, params: LearnParams = LearnParams()) -> np.ndarray:
    sums = counts.sum(axis=1).reshape(4, 4) + params.pseudocount
    return np.repeat((sums / sums.sum(axis=1, keepdims=True)).reshape(16, 1), counts.shape[1], axis=1)


def binned_rates(counts: np.ndarray, params: LearnParams = LearnParams()) -> np.ndarray:
    """Straight lines between the qualities of the instrument's bins, level outside them."""
    bins = sorted(params.bins)
    seen = np.flatnonzero(counts.sum(axis=0))
    if not bins or (len(seen) and (seen[0] < bins[0] or seen[-1] > bins[-1])):
        raise ValueError(f"the data have qualities {seen.min(initial=0)} to {seen.max(initial=0)}, beyond the bins {bins}")
    q = np.arange(counts.shape[1])
    out = np.full(counts.shape, params.min_rate)
    for row in range(16):
        if row not in DIAGONAL:
            total = _totals(counts, row)
            at = [b for b in bins if b < len(total) and total[b] > 0]
            if at:
                out[row] = np.clip(np.interp(q, at, [(counts[row, b] + params.pseudocount) / (total[b] + 4 * params.pseudocount) for b in at]), params.min_rate, params.max_rate)
    return _with_diagonal(out)


def pacbio_rates(counts: np.ndarray, params: LearnParams = LearnParams()) -> np.ndarray:
    """Local regression up to quality 92 and plain shares at 93."""
    if counts.shape[1] != 94:
        return loess_rates(counts, params)
    out = np.empty(counts.shape)
    out[:, :93] = loess_rates(counts[:, :93], params)
    out[:, 93] = [(counts[row, 93] + 1) / (_totals(counts, row)[93] + 4) for row in range(16)]
    return out


def external_rates(command: list[str]) -> Callable[[np.ndarray, LearnParams], np.ndarray]:
    """A program that reads counts as tab-separated text and writes rates in the same form."""

    def fit(counts: np.ndarray, params: LearnParams) -> np.ndarray:
        text = "\n".join(["\t" + "\t".join(map(str, range(counts.shape[1])))] + ["\t".join([name, *(str(int(v)) for v in row)]) for name, row in zip(ROWS, counts, strict=True)])
        done = subprocess.run(command, input=text + "\n", capture_output=True, text=True, check=True)
        lines = [x.split("\t") for x in done.stdout.strip("\n").split("\n")][1:]
        if [x[0] for x in lines] != ROWS:
            raise ValueError(f"the program's rows are {[x[0] for x in lines]}")
        out = np.array([[float(v) for v in x[1:]] for x in lines])
        if out.shape != counts.shape or not ((out >= 0) & (out <= 1)).all():
            raise ValueError("the program must give as many rates as there are counts, each from 0 to 1")
        return out

    return fit


MODELS: dict[str, Callable[[np.ndarray, LearnParams], np.ndarray]] = {
    "loess": loess_rates,
    "noqual": noqual_matrix,
    "binned": binned_rates,
    "pacbio": pacbio_rates,
}


def detect_nq(uniques: DataFrame) -> int:
    """One more than the highest mean quality of any unique, over all samples."""
    top = uniques.select(F.explode(F.transform("qual_sum", lambda s: F.floor(s / F.col("count") + 0.5))).alias("q")).agg(F.max("q")).collect()[0][0]
    return 41 if top is None else int(top) + 1


def learn_errors(uniques: DataFrame, params: LearnParams = LearnParams(), fit: Callable | None = None) -> tuple[np.ndarray, list[dict]]:
    """Error rates by alternating denoising and fitting until a model comes back (E1, T15); and a record of each round.

    Samples are taken until they have ``params.bases`` bases (in the order of their names or, with a seed, shuffled).
    A round is one Spark job over the samples; its result is one table of transition counts.
    """
    fit = fit or MODELS[params.model]
    uniques = within_bases(uniques, params.bases, params.seed).persist()
    nq = detect_nq(uniques)
    from dataclasses import replace

    first = to_matrix(transition_counts(uniques, np.ones((16, nq)), replace(params.denoise, max_clusters=1, omega_c=0.0)), nq)
    err = fit(first, params)
    err[list(DIAGONAL)] = 1.0
    history, rounds = [], []
    for number in range(1, params.max_rounds + 1):
        history.append(err)
        counts = to_matrix(transition_counts(uniques, err, params.denoise), nq)
        new = fit(counts, params)
        back = next((i for i, old in enumerate(history) if np.array_equal(old, new)), None)
        rounds.append({"round": number, "transitions": int(counts.sum()), "change": float(np.abs(new - err).max()), "converged": back is not None})
        err = new
        if back is not None:
            break
    uniques.unpersist()
    return err, rounds


def suspicious_positions(births: DataFrame, alpha: float = 1e-3) -> DataFrame:
    """Positions that more variants differ at than chance allows: ``pos, n, pval`` (E12). ``births``: a row ``pos`` per birth substitution."""
    counts = births.groupBy("pos").agg(F.count("*").alias("n")).persist()
    mean = counts.agg(F.avg("n")).collect()[0][0] or 0.0

    @F.pandas_udf("double")
    def tail(n: pd.Series) -> pd.Series:
        known = {k: poisson_upper_tail(int(k), mean) for k in n.unique()}
        return n.map(known).astype(float)

    return counts.withColumn("pval", tail("n")).where(F.col("pval") < alpha)


def default_model(nq: int = 41, params: DenoiseParams | None = None) -> np.ndarray:
    """Rates that the qualities themselves state, errors shared evenly."""
    p = np.clip(10.0 ** (-np.arange(nq) / 10), 1e-7, 0.75) / 3
    out = np.repeat(p[None, :], 16, axis=0)
    return _with_diagonal(out)
