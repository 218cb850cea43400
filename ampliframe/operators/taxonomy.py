"""Taxonomy by naive Bayes over 8-mers, and species by exact match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliframe.functions import align as al
from ampliframe.functions import sequences as sq
from ampliframe.params import BOOTSTRAPS, MIN_QUERY, TAXONOMY_K, TaxonomyParams

PAD = "?unspecified"
MIN_REFERENCE = 20


def lineages(references: DataFrame, depth: int) -> DataFrame:
    """``lineage, seq`` of references ``header, seq``: levels split at semicolons and filled up; short sequences left out (SC11)."""
    levels = F.filter(F.split("header", ";"), lambda x: F.trim(x) != "")
    filled = F.slice(F.concat(F.transform(levels, lambda x: F.trim(x)), F.array_repeat(F.lit(PAD), depth)), 1, depth)
    return references.where(F.length("seq") >= MIN_REFERENCE).select(filled.alias("lineage"), F.upper("seq").alias("seq"))


def genus_model(references: DataFrame, k: int = TAXONOMY_K) -> DataFrame:
    """``genus, kmer, n_refs, n_genus, prior, log_p``: of every k-mer of a genus (A14). ``references``: ``genus, seq``."""
    refs = references.select("genus", "seq", F.monotonically_increasing_id().alias("ref"))
    kmers = refs.select("genus", "ref", F.explode(F.array_distinct(sq.kmers(F.col("seq"), k))).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$"))
    by_genus = kmers.groupBy("genus", "kmer").agg(F.count("*").alias("n_refs"))
    total = references.count()
    priors = by_genus.groupBy("kmer").agg(((F.sum("n_refs") + 0.5) / (1 + total)).alias("prior"))
    sizes = references.groupBy("genus").agg(F.count("*").alias("n_genus"))
    p = (F.col("n_refs") + F.col("prior")) / (F.col("n_genus") + 1)
    return by_genus.join(priors, "kmer").join(sizes, "genus").withColumn("log_p", F.ln(p))


class _Classifier:
    """log P(k-mer | genus) as a matrix, genera in the order of their lineages."""

    def __init__(self, refs: list[tuple[tuple[str, ...], str]], params: TaxonomyParams):
        self.lineages = sorted({lineage for lineage, _ in refs})
        place = {g: i for i, g in enumerate(self.lineages)}
        counts = np.zeros((len(self.lineages), 4**TAXONOMY_K), np.float32)
        sizes = np.zeros(len(self.lineages), np.float32)
        for lineage, seq in refs:
            value, ok = al.kmer_indices(al.encoded(seq), TAXONOMY_K)
            counts[place[lineage], np.unique(value[ok])] += 1
            sizes[place[lineage]] += 1
        prior = (counts.sum(axis=0) + np.float32(0.5)) / np.float32(1 + len(refs))
        self.log_p = np.log((counts + prior) / (sizes[:, None] + 1)).astype(np.float32)
        self.params = params

    def _best(self, kmers: np.ndarray, rng: np.random.Generator) -> tuple[int, float]:
        scores = self.log_p[:, np.sort(kmers)].sum(axis=1, dtype=np.float32)
        top = np.flatnonzero(scores == scores.max())
        return int(rng.choice(top)) if len(top) > 1 else int(top[0]), float(scores.max())

    def classify(self, seq: str) -> tuple[list[str | None], list[int]] | None:
        """Lineage and bootstrap support by level; none for a query that is too short."""
        if len(seq) < MIN_QUERY:
            return None
        rng = np.random.default_rng([self.params.seed, *al.encoded(seq).tolist()[:64], len(seq)])
        strands = [seq.upper()]
        if self.params.try_reverse:
            strands.append("".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(seq.upper())))
        best = None
        for s in strands:
            value, ok = al.kmer_indices(al.encoded(s), TAXONOMY_K)
            kmers = value[ok]
            if len(kmers):
                genus, score = self._best(kmers, rng)
                if best is None or score > best[1]:
                    best = (genus, score, kmers)
        if best is None:
            return None
        genus, _, kmers = best
        lineage = self.lineages[genus]
        support = [0] * len(lineage)
        for _ in range(BOOTSTRAPS):
            other = self.lineages[self._best(rng.choice(kmers, max(1, len(kmers) // 8)), rng)[0]]
            for level, (a, b) in enumerate(zip(lineage, other, strict=True)):
                if a != b:
                    break
                support[level] += 1
        return [None if x == PAD else x for x in lineage], support


def truncated(taxonomy: Column, bootstrap: Column, min_boot: int) -> Column:
    """Levels up to the first with too little support; null from there on."""
    weak = F.array_position(F.transform(bootstrap, lambda b: b < min_boot), True)
    return F.transform(taxonomy, lambda x, i: F.when((weak == 0) | (i + 1 < weak), x))


def assign_taxonomy(sequences: DataFrame, references: DataFrame, params: TaxonomyParams = TaxonomyParams()) -> DataFrame:
    """``seq, taxonomy, bootstrap`` of every distinct sequence (C10). ``references``: ``header, seq`` with lineages as headers.

    The reference set is collected once and its matrix broadcast: 256 kB a genus.
    """
    refs = [(tuple(r["lineage"]), r["seq"]) for r in lineages(references, len(params.levels)).collect()]
    model = sequences.sparkSession.sparkContext.broadcast(_Classifier(refs, params))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.value.classify(s) for s in pdf["seq"]]
            depth = len(params.levels)
            yield pd.DataFrame({"seq": pdf["seq"], "taxonomy": [[None] * depth if f is None else f[0] for f in found], "bootstrap": [[0] * depth if f is None else f[1] for f in found]})

    out = sequences.select("seq").distinct().mapInPandas(run, "seq string, taxonomy array<string>, bootstrap array<int>")
    return out.withColumn("taxonomy", truncated(F.col("taxonomy"), F.col("bootstrap"), params.min_boot))


def species_references(references: DataFrame) -> DataFrame:
    """``seq, genus, species`` of references with headers ``id genus species`` (SC12)."""
    parts = F.split("header", r"\s+")
    return references.where(F.length("seq") >= MIN_REFERENCE).select(F.upper("seq").alias("seq"), F.get(parts, F.lit(1)).alias("genus"), F.get(parts, F.lit(2)).alias("species"))


def genus_matches(own: Column, classified: Column) -> Column:
    """Whether an exact match's genus agrees with the classifier's: equal, a first word, or first or last of names joined by slashes."""
    slash = F.split(classified, "/")
    return (own == classified) | classified.startswith(F.concat(own, F.lit(" "))) | (F.get(slash, F.lit(0)) == own) | (F.element_at(slash, -1) == own)


def species_of_genus(found: DataFrame, taxonomy: DataFrame, level: int = 5) -> DataFrame:
    """:func:`assign_species` beside the classifier's ``seq, taxonomy``: species only where both name the same genus."""
    classified = taxonomy.select("seq", F.get("taxonomy", F.lit(level)).alias("classified"))
    agree = F.coalesce(genus_matches(F.col("genus"), F.col("classified")), F.lit(False))
    return found.join(classified, "seq", "left").withColumn("species", F.when(agree, F.col("species")))


def assign_species(sequences: DataFrame, references: DataFrame, allow_multiple: int = 1, try_reverse: bool = False, merge_genera: bool = True) -> DataFrame:
    """``seq, genus, species``: exact matches whose genera agree, species joined by slashes up to ``allow_multiple`` (0: any number; J9, A17)."""
    refs = references
    if merge_genera:
        shared = F.col("genus").isin("Escherichia", "Shigella")
        refs = refs.withColumn("genus", F.when(shared, F.lit("Escherichia/Shigella")).otherwise(F.col("genus")))
    queries = sequences.select("seq").distinct()
    hits = queries.join(refs, "seq").select("seq", "genus", "species")
    if try_reverse:
        back = queries.withColumn("rc", sq.reverse_complement(F.col("seq")))
        hits = hits.unionByName(back.join(refs.withColumnRenamed("seq", "rc"), "rc").select("seq", "genus", "species"))
    sets = hits.groupBy("seq").agg(F.array_sort(F.collect_set("genus")).alias("genera"), F.array_sort(F.collect_set("species")).alias("kinds"))
    few = F.lit(True) if allow_multiple == 0 else F.size("kinds") <= allow_multiple
    one = F.size("genera") == 1
    return queries.join(sets, "seq", "left").select("seq", F.when(one, F.get("genera", F.lit(0))).alias("genus"), F.when(one & few, F.array_join("kinds", "/")).alias("species"))
