"""Work that must not be done more than once, and kernels that must give what their plain versions give."""

import random

import numpy as np
from pyspark.sql import functions as F

from ampliframe.operators import denoise as dn
from ampliframe.operators import derep, errors


def counted(df):
    """``df`` and a counter of the rows that are computed of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(run, df.schema), seen


def test_descent_reads_its_births_once(spark):
    births, seen = counted(spark.createDataFrame([("s", i, max(i - 1, 0)) for i in range(8)], "sample_id string, idx int, parent int"))
    assert sorted((r["depth"], r["n"]) for r in dn.generations(births).collect()) == [(d, 1) for d in range(8)]
    assert seen.value == 8


def test_samples_are_partitioned_once_for_all_their_figures(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT", k=40)) for _ in range(5)]
    table = spark.createDataFrame([("s", i, q, 90 - i, [38 * (90 - i)] * 40) for i, q in enumerate(seqs)], "sample_id string, uniq_idx int, seq string, count long, qual_sum array<long>")
    uniques, seen = counted(table)
    found = dn.variants(dn.denoise_pseudo(uniques, errors.default_model(41)))
    assert found.agg(F.sum("abundance")).collect()[0][0] == 440
    assert seen.value == 5


def test_stored_comparisons_give_the_first_of_the_best_clusters():
    rng = np.random.default_rng(1)
    stored, dense = dn._Stored(), []
    for c in range(30):
        uniques, lam = np.flatnonzero(rng.random(50) < 0.3), rng.integers(0, 4, 50) / 4
        stored.add(c, uniques, lam, np.arange(50))
        dense.append(np.where(np.isin(np.arange(50), uniques), lam, -np.inf))
    reads = rng.integers(1, 4, 30)
    e = np.array(dense) * reads[:, None]
    best, cluster, at = stored.best(50, reads)
    known = np.isfinite(e.max(axis=0))
    assert (best == e.max(axis=0)).all() and (cluster[known] == e.argmax(axis=0)[known]).all()
    assert (stored.unique[at[known]] == np.flatnonzero(known)).all() and (stored.cluster[at[known]] == cluster[known]).all()


def test_dereplication_passes_few_partial_rows_on(spark):
    reads = spark.range(40_000, numPartitions=1).select(F.lit("s").alias("sample_id"), F.concat(F.lit("ACGT"), F.col("id").cast("string")).alias("seq"), F.lit("IIII").alias("qual"))
    reads = reads.withColumn("seq", F.concat(F.lit("A"), (F.xxhash64("seq") % 100).cast("string"))).withColumn("qual", F.rpad(F.lit(""), F.length("seq"), F.lit("I")))
    partial = reads.mapInArrow(derep._from_reads(33), derep._UNIQUE)
    assert partial.count() == reads.select("seq").distinct().count()
    assert partial.agg(F.sum("count")).collect()[0][0] == 40_000


def test_errors_that_the_reads_themselves_explain_are_no_variants(spark, monkeypatch):
    """Substitutions at fifteen times the rate that qualities state, seen often enough to tell."""
    from ampliframe.plans import registry

    rng = random.Random(8)
    rows = []
    for reads in (160_000, 150_000, 140_000):
        template = "".join(rng.choices("ACGT", k=64))
        seqs = [template, *(template[:i] + b + template[i + 1 :] for i in range(64) for b in "ACGT" if b != template[i])]
        for n, q in zip([reads] + [80] * 192, seqs, strict=True):
            rows += [(sample, q, n, [n * rng.choice((38, 39)) for _ in range(64)]) for sample in ("s0", "s1")]
    table = derep.rank_uniques(spark.createDataFrame(rows, "sample_id string, seq string, count long, qual_sum array<long>"))
    monkeypatch.setattr(registry.derep, "dereplicate", lambda reads: table)
    found = registry.denoise_variants(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["abundance"], r["n_uniques"]) for r in found) == [(n + 192 * 80, 193) for n in (140_000, 140_000, 150_000, 150_000, 160_000, 160_000)]
    assert registry.denoise_pooled_variants(spark, "/root/testdata/sf0.001").count() == 6
    assert registry.transition_counts(spark, "/root/testdata/sf0.001").where("ref_nt <> query_nt").agg(F.sum("n")).collect()[0][0] == 6 * 192 * 80


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_gzip_reads_are_put_together_without_a_shuffle(spark, tmp_path):
    from ampliframe.sources import files

    rows = spark.range(50_000, numPartitions=3).select(F.col("id").cast("string").alias("name"), F.lit("d").alias("descr"), F.lit("ACGT").alias("seq"), F.lit("@III").alias("qual"))
    files.write_fastq(rows, str(tmp_path / "zipped"))
    files.write_fastq(rows, str(tmp_path / "plain"), "none")
    zipped, plain = (files.read_fastq(spark, str(tmp_path / x)) for x in ("zipped", "plain"))
    assert shuffles(zipped) == 0
    columns = ["name", "descr", "seq", "qual"]
    assert zipped.select(columns).exceptAll(plain.select(columns)).count() == 0 and zipped.count() == plain.count() == 50_000
    assert zipped.groupBy("sample_id").agg(F.max("read_no") + 1 - F.count("*")).distinct().collect()[0][1] == 0
    both = files.read_fastq(spark, [str(tmp_path / "zipped"), str(tmp_path / "plain")])
    assert both.count() == 100_000


def test_primers_of_many_reads_equal_those_of_each():
    from ampliframe.operators import reads
    from ampliframe.params import PrimerParams

    rng = random.Random(6)
    word = lambda symbols, lo, hi: "".join(rng.choices(symbols, k=rng.randint(lo, hi)))
    for _ in range(60):
        params = PrimerParams(forward=word("ACGTYRMN", 0, 8), reverse=word("ACGTYRMN", 0, 6), max_mismatch=rng.randint(0, 2), trim_forward=rng.random() < 0.5, trim_reverse=rng.random() < 0.5, orient=rng.random() < 0.7)
        seqs = [word("ACGTNacgt-", 0, 20) for _ in range(30)]
        quals = [word("!5GHI", len(s), len(s)) for s in seqs]
        assert reads.trimmed_many(seqs, quals, params) == [reads.trimmed(s, q, params) for s, q in zip(seqs, quals, strict=True)]


def test_cumulative_errors_are_added_up_before_the_shuffle(spark):
    from ampliframe.operators import reads

    r = spark.range(3_000, numPartitions=1).select((F.col("id") % 2).cast("string").alias("sample_id"), F.when(F.col("id") % 3 == 0, "I5#").otherwise("I5").alias("qual"))
    found = {(x["sample_id"], x["pos"]): (x["mean"], x["min"], x["max"]) for x in reads.cumulative_error_summary(r).collect()}
    sums = np.cumsum(10.0 ** (-np.array([40, 20, 2]) / 10))
    assert set(found) == {(s, p) for s in "01" for p in range(3)}
    assert all(np.allclose(v, sums[p]) for (_, p), v in found.items())
    cells = r.mapInArrow(reads._error_cells(200, 33), "sample_id string, pos int, bin int, n long, s double, lo double, hi double") if r.columns == ["sample_id", "qual"] else None
    assert cells.count() == 6 and cells.agg(F.sum("n")).collect()[0][0] == 7_000


def test_complexity_of_many_sequences_equals_that_of_each():
    import math
    from collections import Counter

    from ampliframe.functions import sequences as sq

    rng = random.Random(2)
    seqs = ["".join(rng.choices("ACGTNa", (9, 9, 9, 9, 1, 1), k=rng.randint(0, 70))) for _ in range(200)] + ["", "A", None]
    for k in (1, 2, 5):
        for seq, found in zip(seqs, sq.effective_kmers_many(seqs, k), strict=True):
            n = Counter(w for i in range(len(seq or "") - k + 1) if set(w := seq[i : i + k]) <= set("ACGT"))
            total = sum(n.values())
            plain = math.exp(-sum(v / total * math.log(v / total) for v in n.values())) if total else 0.0
            assert math.isnan(found) if seq is None else math.isclose(found, plain, rel_tol=1e-12)


def test_reads_are_filtered_once_for_all_steps(spark, monkeypatch):
    from ampliframe.plans import registry

    calls, filtered = [], registry.reads.filtered

    def once(df, params):
        df, seen = counted(df.select("sample_id", "read_id", "seq", "qual"))
        calls.append((seen, df))
        return filtered(df, params)

    monkeypatch.setattr(registry.reads, "filtered", once)
    n = sum(r["input"] for r in registry.step_tracking(spark, "/root/testdata/sf0.001").collect())
    assert sum(seen.value for seen, _ in calls) == n


def test_ambiguous_bases_are_counted_without_looking_up_every_symbol(spark):
    from ampliframe.functions import sequences as sq

    found = spark.createDataFrame([("",), ("NNn",), ("ACGT",), ("AnCN",), (None,)], "seq string").select(sq.n_count(F.col("seq")).alias("n"))
    assert [r["n"] for r in found.collect()] == [0, 3, 0, 2, None]
    assert "translate" not in found._jdf.queryExecution().optimizedPlan().toString()
