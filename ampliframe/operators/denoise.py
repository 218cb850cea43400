"""Denoising: greedy divisive partition of unique sequences under a quality-aware error model.

A sample is one group: its uniques are partitioned inside one task, samples
side by side. Pooled denoising merges uniques over samples first; pseudo-pooled
denoising runs twice, the second time with sequences seen in several samples as
priors.

Tables: uniques ``sample_id, uniq_idx, seq, count, qual_sum`` and optionally
``prior``; results have a row per unique with its cluster (null if it failed),
and :func:`variants` sums them up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliframe.functions import align as al
from ampliframe.functions.stats import abundance_pvalue, poisson_upper_tail
from ampliframe.operators.derep import merged_uniques, rank_uniques
from ampliframe.params import LONGEST_SEQUENCE, MOST_SHUFFLES, DenoiseParams

RESULT = (
    "sample_id string, uniq_idx int, seq string, count long, cluster int, assigned int, pval double, lambda double, hamming int, "
    "is_center boolean, cluster_reads long, birth_type string, birth_from int, birth_pval double, birth_fold double, birth_e double, birth_hamming int"
)
TRANSITIONS = "sample_id string, ref_nt string, query_nt string, q int, n long"
_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _i


def mean_qualities(qual_sum: np.ndarray, count: int) -> np.ndarray:
    """Mean quality per position, halves rounded up."""
    return np.floor(np.asarray(qual_sum, float) / count + 0.5).astype(np.int64)


def extended_model(err: np.ndarray, highest: int) -> np.ndarray:
    """The model with its last column repeated up to quality ``highest``."""
    more = highest + 1 - err.shape[1]
    return np.concatenate([err, np.repeat(err[:, -1:], more, axis=1)], axis=1) if more > 0 else err


def _padded(rows: list[np.ndarray], kind: type) -> np.ndarray:
    """A table of rows of different lengths, filled up with zeros."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), kind)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class _Stored:
    """Comparisons of uniques with clusters that may still win them, in the order of clusters; room is doubled as it fills up."""

    def __init__(self):
        self.n = 0
        self.cluster, self.unique, self.lam, self.ham = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32)

    def add(self, cluster: int, uniques: np.ndarray, lam: np.ndarray, ham: np.ndarray) -> None:
        end = self.n + len(uniques)
        if end > len(self.cluster):
            more = max(end, 2 * len(self.cluster)) - len(self.cluster)
            self.cluster, self.unique, self.lam, self.ham = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.cluster, self.unique, self.lam, self.ham))
        self.cluster[self.n : end], self.unique[self.n : end] = cluster, uniques
        self.lam[self.n : end], self.ham[self.n : end] = lam[uniques], ham[uniques]
        self.n = end

    def best(self, n: int, reads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every unique: the most reads that a cluster expects of it, the first such cluster, and the comparison's place."""
        cluster, unique = self.cluster[: self.n], self.unique[: self.n]
        e = self.lam[: self.n] * reads[cluster]
        best_e, best_c, at = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.maximum.at(best_e, unique, e)
        first = np.flatnonzero(e == best_e[unique])[::-1]
        at[unique[first]] = first
        best_c[unique[first]] = cluster[first]
        return best_e, best_c, at


class Partition:
    """The state of one sample's partition."""

    def __init__(self, seqs: list[str], reads: np.ndarray, quals: list[np.ndarray], prior: np.ndarray, err: np.ndarray, params: DenoiseParams):
        for s in seqs:
            bad = set(s) - set("ACGT")
            if bad:
                raise ValueError(f"sequences may hold A, C, G and T only, found {''.join(sorted(bad))!r}; filter with max_n = 0 first")
            if not params.k < len(s) < LONGEST_SEQUENCE:
                raise ValueError(f"a sequence has {len(s)} bases; it needs more than {params.k} and fewer than {LONGEST_SEQUENCE}")
        self.params, self.n = params, len(seqs)
        self.seqs = [al.encoded(s) for s in seqs]
        self.codes = [_CODE[s] for s in self.seqs]
        self.lengths = np.array([len(s) for s in self.seqs])
        self.reads = np.asarray(reads, np.int64)
        self.total = int(self.reads.sum())
        self.prior = np.asarray(prior, bool)
        self.quals = quals if params.use_quals else [np.zeros(len(q), np.int64) for q in quals]
        self.err = extended_model(err, max((int(q.max()) for q in self.quals if len(q)), default=0))
        self.vectors = np.stack([al.kmer_vector(s, params.k) for s in self.seqs])
        self.ordered = _padded([al.ordered_kmers(s, params.k) for s in self.seqs], np.uint16)
        self.code_table, self.qual_table = _padded(self.codes, np.uint8), _padded(self.quals, np.int16)
        self.selves = np.array([self._product(c, c, q) for c, q in zip(self.codes, self.quals, strict=True)])
        self.locked = np.zeros(self.n, bool)
        self.best_known = np.full(self.n, -999.0)
        # by cluster: members in order, centre, reads
        self.members: list[list[int]] = [list(range(self.n))]
        self.centers = [int(self.n - 1 - np.argmax(self.reads[::-1]))] if self.n else []
        self.cluster_reads = [self.total]
        # stored comparisons, cluster by cluster
        self.stored = _Stored()
        self.births: list[dict] = [{"type": "Initial", "from": 0, "pval": None, "fold": None, "e": None, "hamming": None}]
        self.cluster_of = np.zeros(self.n, np.int64)
        self.own_lam = np.zeros(self.n)
        self.own_ham = np.zeros(self.n, np.int64)
        self.p = np.ones(self.n)
        self.lock_checked: set[int] = set()
        self.n_aligned = self.n_screened = 0

    def _product(self, ref: np.ndarray, query: np.ndarray, q: np.ndarray) -> float:
        return float(np.multiply.reduce(self.err[ref.astype(np.int64) * 4 + query, q]))

    # -- comparisons

    def aligned(self, center: int, others: list[int]) -> list[al.Substitutions]:
        pairs = al.align_many(self.seqs[center], [self.seqs[i] for i in others], self.params.scoring)
        return [al.substitutions(a, b) for a, b in pairs]

    def rate(self, i: int, subs: al.Substitutions) -> float:
        """Product over the read's positions of the error model's rates."""
        ref = self.codes[i].copy()
        ref[subs.query_positions] = _CODE[subs.ref_bases]
        return self._product(ref, self.codes[i], self.quals[i])

    def compare(self, cluster: int, cutoff: float) -> None:
        center, p = self.centers[cluster], self.params
        lam, ham = np.zeros(self.n), np.zeros(self.n, np.int64)
        consider = np.ones(self.n, bool)
        if p.greedy:
            consider &= (self.reads <= self.reads[center]) & ~self.locked
        consider[center] = True
        candidates = np.flatnonzero(consider)
        plain = np.full(len(candidates), p.scoring.band == 0)
        if p.use_kmers:
            distance = al.kmer_distances(self.vectors[center], self.lengths[center], self.vectors[candidates], self.lengths[candidates], p.k)
            near = distance <= cutoff
            self.n_screened += int((~near).sum())
            candidates, distance, plain = candidates[near], distance[near], plain[near]
            if p.gapless:
                windows = self.lengths[center] - p.k + 1
                same = (self.ordered[candidates, :windows] == self.ordered[center, :windows]).sum(axis=1)
                plain |= (self.lengths[candidates] == self.lengths[center]) & (np.abs(1.0 - same / windows - distance) < 1e-12)
        # of one length and without gaps, the bases that differ are the substitutions
        level = candidates[plain & (self.lengths[candidates] == self.lengths[center])]
        size = self.lengths[center]
        codes = self.code_table[level, :size]
        ham[level] = (codes != self.codes[center]).sum(axis=1)
        lam[level] = np.multiply.reduce(self.err[self.codes[center].astype(np.int64) * 4 + codes, self.qual_table[level, :size]], axis=1)
        for i in candidates[plain & (self.lengths[candidates] != size)].tolist():
            subs = al.substitutions(*al.gapless(self.seqs[center], self.seqs[i]))
            lam[i], ham[i] = self.rate(i, subs), subs.hamming
        full = candidates[~plain].tolist()
        for i, subs in zip(full, self.aligned(center, full), strict=True):
            lam[i], ham[i] = self.rate(i, subs), subs.hamming
        self.n_aligned += len(candidates)
        keep = lam * self.total > self.best_known
        self.best_known = np.where(keep, np.maximum(self.best_known, lam * self.reads[center]), self.best_known)
        self.stored.add(cluster, np.flatnonzero(keep), lam, ham)
        if cluster == 0:
            self.own_lam, self.own_ham = lam.copy(), ham.copy()
        else:
            self.own_lam[center], self.own_ham[center] = lam[center], ham[center]

    # -- p-values and splits

    def reprice(self, clusters: set[int]) -> None:
        p = self.params
        for c in clusters:
            for i in self.members[c]:
                if self.reads[i] == 1 and not self.prior[i] and not p.detect_singletons:
                    self.p[i] = 1.0
                elif self.own_ham[i] == 0:
                    self.p[i] = 1.0
                elif self.own_lam[i] == 0:
                    self.p[i] = 0.0
                else:
                    self.p[i] = abundance_pvalue(int(self.reads[i]), self.own_lam[i] * self.cluster_reads[c], bool(self.prior[i]), p.detect_singletons)
            if p.greedy and c not in self.lock_checked:
                self.lock_checked.add(c)
                reads = self.reads[self.centers[c]]
                for i in self.members[c]:
                    if reads * self.own_lam[i] > self.reads[i] or i == self.centers[c]:
                        self.locked[i] = True

    def _candidate(self, priors_only: bool) -> tuple[float, int, int, int] | None:
        """The least p-value, then the most reads, then the first place; it has to beat the first centre."""
        p = self.params
        # the first place of a cluster is its centre's
        i = np.fromiter((i for m in self.members for i in m[1:]), np.int64)
        sizes = np.array([len(m) - 1 for m in self.members])
        fit = (self.reads[i] >= p.min_abundance) & (self.own_ham[i] >= p.min_hamming)
        if priors_only:
            fit &= self.prior[i]
        if p.min_fold > 1:
            fit &= self.reads[i] >= p.min_fold * self.own_lam[i] * np.repeat(np.array(self.cluster_reads), sizes)
        fit = np.flatnonzero(fit)
        if not len(fit):
            return None
        least = fit[self.p[i[fit]] == self.p[i[fit]].min()]
        at = int(least[np.argmax(self.reads[i[least]])])
        found, first = int(i[at]), self.centers[0]
        if not (self.p[found] < self.p[first] or (self.p[found] == self.p[first] and self.reads[found] > self.reads[first])):
            return None
        ends = np.cumsum(sizes)
        c = int(np.searchsorted(ends, at, "right"))
        return float(self.p[found]), c, at - int(ends[c] - sizes[c]) + 1, found

    def split(self) -> int | None:
        """The new cluster, or none if no unique is unexpected enough."""
        found = self._candidate(False)
        kind = "Abundance"
        if found is None or not found[0] * self.n < self.params.omega_a:
            found = self._candidate(True) if self.prior.any() else None
            kind = "Prior"
            if found is None or not found[0] < self.params.omega_p:
                return None
        pval, c, place, i = found
        expected = self.own_lam[i] * self.cluster_reads[c]
        self.births.append(
            {
                "type": kind,
                "from": c if kind == "Abundance" else 0,
                "pval": pval * self.n if kind == "Abundance" else pval,
                "fold": float(self.reads[i] / max(expected, np.finfo(float).tiny)),
                "e": float(expected),
                "hamming": int(self.own_ham[i]),
            }
        )
        self._remove(c, place)
        self.members.append([i])
        self.centers.append(i)
        self.cluster_reads.append(int(self.reads[i]))
        self.cluster_of[i] = len(self.members) - 1
        return len(self.members) - 1

    def _remove(self, c: int, place: int) -> None:
        members = self.members[c]
        self.cluster_reads[c] -= int(self.reads[members[place]])
        members[place] = members[-1]
        members.pop()

    def shuffle(self) -> set[int]:
        """Clusters that changed; every unique but the centres goes where most of its reads are expected."""
        changed: set[int] = set()
        free = np.ones(self.n, bool)
        free[self.centers] = False
        for _ in range(MOST_SHUFFLES):
            best_e, best_c, best_at = self.stored.best(self.n, np.array(self.cluster_reads))
            moves = free & (best_c != self.cluster_of) & (best_e > -np.inf)
            moved = bool(moves.any())
            for c in np.unique(self.cluster_of[moves]).tolist():
                own = np.array(self.members[c])
                for place in np.flatnonzero(moves[own] & (best_c[own] != c))[::-1].tolist():
                    i = self.members[c][place]
                    to = int(best_c[i])
                    self._remove(c, place)
                    self.members[to].append(i)
                    self.cluster_reads[to] += int(self.reads[i])
                    self.cluster_of[i] = to
                    self.own_lam[i], self.own_ham[i] = self.stored.lam[best_at[i]], self.stored.ham[best_at[i]]
                    changed |= {c, to}
            if not moved:
                break
        return changed

    def run(self) -> Partition:
        if not self.n:
            return self
        self.compare(0, 1.0)
        self.reprice({0})
        most = self.params.max_clusters or self.n
        while len(self.members) < most:
            parents = list(self.cluster_reads)
            new = self.split()
            if new is None:
                break
            self.compare(new, self.params.kdist_cutoff)
            changed = self.shuffle() | {new} | {c for c, r in enumerate(parents) if r != self.cluster_reads[c]}
            self.reprice(changed)
        return self

    # -- results

    def final_p(self) -> np.ndarray:
        out = np.ones(self.n)
        for i in range(self.n):
            c = int(self.cluster_of[i])
            if i != self.centers[c]:
                out[i] = poisson_upper_tail(int(self.reads[i]), self.own_lam[i] * self.cluster_reads[c])
        return out

    def transitions(self, assigned: np.ndarray) -> dict[tuple[int, int], int]:
        """Reads by (reference * 4 + query, quality), kept uniques aligned with their centres, screen off."""
        out: dict[tuple[int, int], int] = {}
        for c, center in enumerate(self.centers):
            mine = [i for i in self.members[c] if assigned[i]]
            # a sequence aligns with itself base by base
            others = [i for i in mine if i != center]
            found = dict(zip(others, self.aligned(center, others), strict=True))
            for i in mine:
                subs = found[i] if i != center else al.substitutions(self.seqs[center], self.seqs[center])
                places = subs.position_map[subs.position_map != al.NO_POSITION]
                refs = self.codes[center][subs.position_map != al.NO_POSITION].astype(np.int64)
                cell = refs * 4 + self.codes[i][places]
                for t, q in zip(cell.tolist(), self.quals[i][places].tolist(), strict=True):
                    out[t, q] = out.get((t, q), 0) + int(self.reads[i])
        return out


def _partition(pdf: pd.DataFrame, err: np.ndarray, params: DenoiseParams) -> tuple[pd.DataFrame, Partition]:
    pdf = pdf.sort_values("uniq_idx", kind="stable").reset_index(drop=True)
    quals = [mean_qualities(q, c) for q, c in zip(pdf["qual_sum"], pdf["count"], strict=True)]
    prior = pdf["prior"].to_numpy(bool) if "prior" in pdf else np.zeros(len(pdf), bool)
    return pdf, Partition(list(pdf["seq"]), pdf["count"].to_numpy(), quals, prior, err, params).run()


def _denoised(err: np.ndarray, params: DenoiseParams) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, b = _partition(pdf, err, params)
        p = b.final_p()
        c = b.cluster_of
        births = [b.births[k] for k in c]
        return pd.DataFrame(
            {
                "sample_id": pdf["sample_id"],
                "uniq_idx": pdf["uniq_idx"].astype("int32"),
                "seq": pdf["seq"],
                "count": pdf["count"].astype("int64"),
                "cluster": c.astype("int32"),
                "assigned": pd.array(np.where(p >= params.omega_c, c, -1), "Int32").copy(),
                "pval": p,
                "lambda": b.own_lam,
                "hamming": b.own_ham.astype("int32"),
                "is_center": np.array([i == b.centers[k] for i, k in enumerate(c)], bool),
                "cluster_reads": np.array([b.cluster_reads[k] for k in c], np.int64),
                "birth_type": [x["type"] for x in births],
                "birth_from": pd.array([x["from"] for x in births], "Int32"),
                "birth_pval": pd.array([x["pval"] for x in births], "Float64"),
                "birth_fold": pd.array([x["fold"] for x in births], "Float64"),
                "birth_e": pd.array([x["e"] for x in births], "Float64"),
                "birth_hamming": pd.array([x["hamming"] for x in births], "Int32"),
            }
        )

    return run


def denoise(uniques: DataFrame, err: np.ndarray, params: DenoiseParams = DenoiseParams()) -> DataFrame:
    """Partition of every sample (N1, N13): a row per unique; ``assigned`` is null where its p-value is under omega_c."""
    out = uniques.groupBy("sample_id").applyInPandas(_denoised(err, params), RESULT)
    # a row a unique, and most callers need them more than once: the partition is made once
    return out.withColumn("assigned", F.when(F.col("assigned") >= 0, F.col("assigned"))).persist()


def transition_counts(uniques: DataFrame, err: np.ndarray, params: DenoiseParams) -> DataFrame:
    """Transitions of every sample's partition under ``err``: the counts that a new model is fitted to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, b = _partition(pdf, err, params)
        counts = b.transitions(b.final_p() >= params.omega_c)
        keys = sorted(counts)
        return pd.DataFrame(
            {
                "sample_id": [pdf["sample_id"].iloc[0]] * len(keys),
                "ref_nt": ["ACGT"[t // 4] for t, _ in keys],
                "query_nt": ["ACGT"[t % 4] for t, _ in keys],
                "q": np.array([q for _, q in keys], np.int32),
                "n": np.array([counts[k] for k in keys], np.int64),
            }
        )

    return uniques.groupBy("sample_id").applyInPandas(run, TRANSITIONS)


def variants(result: DataFrame) -> DataFrame:
    """One row per cluster: its centre, the reads of all members, of those kept (T14), and how it was born."""
    sums = result.groupBy("sample_id", "cluster").agg(
        F.sum("count").alias("abundance"),
        F.sum(F.when(F.col("assigned").isNotNull(), F.col("count")).otherwise(0)).alias("kept_abundance"),
        F.count_if(F.col("assigned").isNotNull()).alias("n_uniques"),
        F.sum(F.when((F.col("hamming") == 0) & F.col("assigned").isNotNull(), F.col("count")).otherwise(0)).alias("n0"),
        F.sum(F.when((F.col("hamming") == 1) & F.col("assigned").isNotNull(), F.col("count")).otherwise(0)).alias("n1"),
    )
    births = result.where("is_center").select(
        "sample_id", "cluster", "seq", "birth_type", "birth_from", "birth_pval", "birth_fold", "birth_e", "birth_hamming"
    )
    return sums.join(births, ["sample_id", "cluster"]).withColumnRenamed("cluster", "asv_idx")


def mark_priors(uniques: DataFrame, priors: DataFrame) -> DataFrame:
    """``uniques`` with ``prior``: whether the sequence is among ``priors`` (upper-cased, exact; N12, J10)."""
    known = priors.select(F.upper("seq").alias("seq")).distinct().withColumn("prior", F.lit(True))
    return uniques.drop("prior").join(known, "seq", "left").withColumn("prior", F.coalesce("prior", F.lit(False)))


def pooled_uniques(uniques: DataFrame) -> DataFrame:
    """Uniques over all samples, counts and quality sums added up, ranked anew."""
    return rank_uniques(merged_uniques(uniques.withColumn("sample_id", F.lit("pooled"))))


def denoise_pooled(uniques: DataFrame, err: np.ndarray, params: DenoiseParams = DenoiseParams()) -> DataFrame:
    """All samples as one, projected back: ``sample_id, asv_idx, seq, abundance``; abundances of mapped uniques only."""
    uniques = uniques.persist()
    pooled = denoise(pooled_uniques(uniques), err, params)
    centers = pooled.where("is_center").select(F.col("cluster").alias("asv_idx"), F.col("seq").alias("asv_seq"))
    mapped = pooled.where("assigned is not null").select("seq", F.col("assigned").alias("asv_idx"))
    joined = uniques.join(mapped, "seq").join(centers, "asv_idx")
    return joined.groupBy("sample_id", "asv_idx", F.col("asv_seq").alias("seq")).agg(F.sum("count").alias("abundance"))


def pseudo_priors(first: DataFrame, min_prevalence: int = 2, min_abundance: int | None = None) -> DataFrame:
    """Sequences of a first round that occur in enough samples, or often enough."""
    found = variants(first).groupBy("seq").agg(F.count("*").alias("samples"), F.sum("abundance").alias("total"))
    wanted = F.col("samples") >= min_prevalence
    return found.where(wanted if min_abundance is None else wanted | (F.col("total") >= min_abundance)).select("seq")


def denoise_pseudo(
    uniques: DataFrame,
    err: np.ndarray,
    params: DenoiseParams = DenoiseParams(),
    min_prevalence: int = 2,
    min_abundance: int | None = None,
    refit: Callable[[DataFrame], np.ndarray] | None = None,
) -> DataFrame:
    """Two rounds per sample, the second with the first's shared sequences as priors.

    ``refit`` makes the second round's model from the first round's transition counts (N16).
    """
    uniques = uniques.persist()
    priors = pseudo_priors(denoise(uniques, err, params), min_prevalence, min_abundance)
    if refit is not None:
        err = refit(transition_counts(uniques, err, params))
    # few rows, needed by every sample of the second round: they are made once
    priors = priors.persist()
    return denoise(mark_priors(uniques, priors), err, params)


def posthoc_pvalues(found: DataFrame) -> DataFrame:
    """:func:`variants` with ``post_pval``: how likely so many reads are if all reads of the cluster that it was split from had been its errors' source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf["birth_e"].notna()
            pdf["post_pval"] = [poisson_upper_tail(int(n), float(e)) if ok else None for n, e, ok in zip(pdf["abundance"], pdf["birth_e"].fillna(0.0), known, strict=True)]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", post_pval double"
    return found.mapInPandas(run, schema)


def _compared(ref: str, query: str, params: DenoiseParams) -> al.Substitutions:
    """Substitutions as the partition counts them: position by position where the k-mers say that there are no indels."""
    a, b = al.encoded(ref), al.encoded(query)
    plain = params.scoring.band == 0
    if params.gapless and params.use_kmers and len(a) == len(b):
        vectors = [al.kmer_vector(x, params.k) for x in (a, b)]
        distance = al.kmer_distances(vectors[0], len(a), vectors[1][None, :], np.array([len(b)]), params.k)[0]
        plain |= abs(al.ordered_distance(al.ordered_kmers(a, params.k), al.ordered_kmers(b, params.k)) - distance) < 1e-12
    return al.substitutions(*(al.gapless(a, b) if plain else al.align_many(a, [b], params.scoring)[0]))


def birth_substitutions(found: DataFrame, params: DenoiseParams = DenoiseParams()) -> DataFrame:
    """``sample_id, asv_idx, pos, ref_nt, query_nt``: where each variant differs from the one that it was split from."""
    own = found.select("sample_id", "asv_idx", "birth_from", F.col("seq").alias("query"))
    parents = found.select("sample_id", F.col("asv_idx").alias("birth_from"), F.col("seq").alias("ref"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sample, asv, ref, query in zip(pdf["sample_id"], pdf["asv_idx"], pdf["ref"], pdf["query"], strict=True):
                subs = _compared(ref, query, params)
                rows += [(sample, asv, int(p), chr(r), chr(q)) for p, r, q in zip(subs.ref_positions, subs.ref_bases, subs.query_bases, strict=True)]
            yield pd.DataFrame(rows, columns=["sample_id", "asv_idx", "pos", "ref_nt", "query_nt"])

    pairs = own.join(parents, ["sample_id", "birth_from"]).where("asv_idx <> birth_from")
    return pairs.mapInPandas(run, "sample_id string, asv_idx int, pos int, ref_nt string, query_nt string")


def generations(births: DataFrame) -> DataFrame:
    """``sample_id, depth, n``: of rows ``sample_id, idx, parent``, how many descend from 0 in so many steps."""
    name = f"births_{uuid.uuid4().hex}"
    # every step of the descent reads the births again
    births.select("sample_id", "idx", "parent").persist().createOrReplaceTempView(name)
    return births.sparkSession.sql(
        f"""with recursive tree(sample_id, idx, depth) as (
              select sample_id, idx, 0 from {name} where idx = 0
              union all select k.sample_id, k.idx, t.depth + 1 from {name} k join tree t on k.sample_id = t.sample_id and k.parent = t.idx where k.idx > 0)
            select sample_id, depth, count(*) as n from tree group by sample_id, depth"""
    )


def failed_uniques(result: DataFrame) -> DataFrame:
    """Uniques that no cluster keeps, by sample, reads (most first) and sequence (SK8)."""
    return result.where("assigned is null").select(F.col("seq").alias("sequence"), F.col("sample_id").alias("sample"), F.col("count").alias("reads")).orderBy(
        "sample", F.desc("reads"), "sequence"
    )


def trace(result: DataFrame, min_abundance: int = 0) -> DataFrame:
    """Clusters with their members nested (SK9)."""
    members = F.array_sort(F.collect_list(F.struct("uniq_idx", "count", "hamming", "lambda", "pval")))
    return result.where(F.col("count") >= min_abundance).groupBy("sample_id", "cluster").agg(members.alias("members"), F.sum("count").alias("reads"))


def cluster_quality(result: DataFrame, uniques: DataFrame) -> DataFrame:
    """Read-weighted mean quality of each cluster at each position."""
    rows = result.where("assigned is not null").select("sample_id", "uniq_idx", "cluster").join(uniques.select("sample_id", "uniq_idx", "count", "qual_sum"), ["sample_id", "uniq_idx"])
    spread = rows.select("sample_id", "cluster", "count", F.posexplode("qual_sum").alias("pos", "q"))
    return spread.groupBy("sample_id", "cluster", "pos").agg((F.sum("q") / F.sum("count")).alias("quality"))
