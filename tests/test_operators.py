"""Operators over small tables, and their queries over the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

from ampliframe.functions import sequences as sq
from ampliframe.operators import denoise as dn
from ampliframe.operators import derep, errors, reads, tables, taxonomy
from ampliframe.params import BimeraParams, FilterParams, PrimerParams, TaxonomyParams
from ampliframe.sources import files

SMALL = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def uniques(spark):
    import random

    rng = random.Random(9)
    a = "".join(rng.choices("ACGT", k=50))
    b = a[:25] + {"A": "C", "C": "A", "G": "T", "T": "G"}[a[25]] + a[26:]
    data = [("x", a, 500), ("x", b, 300), ("y", a, 200), ("y", b, 2)]
    df = spark.createDataFrame([(s, q, n, [38 * n] * 50) for s, q, n in data], "sample_id string, seq string, count long, qual_sum array<long>")
    return derep.rank_uniques(df)


def test_filter_steps(spark):
    r = spark.createDataFrame([("s", 0, "ACGTACGT", "IIIII#II"), ("s", 1, "ACGNACGT", "IIIIIIII"), ("s", 2, "AC", "II"), ("s", 3, "ACGTACGT", "++++++++")], "sample_id string, read_no long, seq string, qual string")
    p = FilterParams(trunc_q=2, min_len=4, max_n=0)
    assert [x["seq"] for x in reads.filtered(r, p).orderBy("read_no").collect()] == ["ACGTA", "ACGTACGT"]
    assert reads.filtered(r, FilterParams(trunc_q=0, min_len=0, max_n=None, max_ee=0.5)).count() == 2  # a Q2 base alone is 0.63 errors
    assert reads.filtered_pairs(r, r, p).count() == 2
    assert reads.filtered(r, FilterParams(trunc_q=0, min_len=0, trunc_len=3)).where("length(seq) <> 3").count() == 0


def test_complexity_and_contaminants(spark):
    r = spark.createDataFrame([("s", 0, "A" * 40, "I" * 40), ("s", 1, "ACGTTGCAACTGGATCCATGCGTACCTGAAGTCGCATTAG", "I" * 40)], "sample_id string, read_no long, seq string, qual string")
    assert r.select(F.round(sq.effective_kmers(F.col("seq")), 6).alias("c")).collect()[0]["c"] == 1.0
    genome = "ACGTTGCAACTGGATCCATGCGTACCTGAAGTCGCATTAG"
    assert [x["read_no"] for x in reads.without_phix(r, genome).collect()] == [0]


def test_primer_outcomes(spark):
    r = spark.createDataFrame([("s", 0, "ACGTACGGGTTT", "I" * 12), ("s", 1, "G" * 12, "I" * 12), ("s", 2, "ACGTACGG", "I" * 8)], "sample_id string, read_no long, seq string, qual string")
    out = reads.primers_removed(r, PrimerParams(forward="ACGTAC", max_mismatch=0, filter=FilterParams(min_len=5)))
    assert rows(reads.outcome_counts(out).select("outcome", "n"), "outcome") == [("filter_fail", 1), ("no_primer", 1), ("passed", 1)]


def test_ranks_break_ties_by_sequence(spark):
    r = spark.createDataFrame([("s", q) for q in ["CC", "CC", "AA", "AA", "GG", "GG", "GG"]], "sample_id string, seq string")
    assert rows(derep.rank_uniques(derep.counts(r)).select("uniq_idx", "seq", "count"), "uniq_idx") == [(0, "GG", 3), (1, "AA", 2), (2, "CC", 2)]


def test_denoising_modes(spark, uniques):
    err = errors.default_model(41)
    result = dn.denoise(uniques, err)
    assert result.agg(F.sum("count")).collect()[0][0] == 1002
    found = {(r["sample_id"], r["abundance"]) for r in dn.variants(result).collect()}
    assert found == {("x", 500), ("x", 300), ("y", 202)}
    pseudo = dn.variants(dn.denoise_pseudo(uniques, err, min_prevalence=1))
    assert {(r["sample_id"], r["abundance"]) for r in pseudo.collect()} == {("x", 500), ("x", 300), ("y", 200), ("y", 2)}
    pooled = dn.denoise_pooled(uniques, err)
    assert pooled.agg(F.sum("abundance")).collect()[0][0] == 1002 and pooled.count() == 4


def test_learning_converges(spark, uniques):
    err, rounds = errors.learn_errors(uniques)
    assert rounds[-1]["converged"] and err.shape == (16, 39)


def test_bimeras_are_found_and_kept_apart(spark):
    a, b = "ACGTTGCAACTGGATCCATG", "TTGACCATGGCATTCAAGCT"
    t = spark.createDataFrame([(s, q, n) for s in ("x", "y") for q, n in ((a, 100), (b, 80), (a[:10] + b[10:], 5))], "sample_id string, seq string, count long")
    for method in ("consensus", "pooled", "per-sample"):
        left = {r["seq"] for r in tables.without_bimeras(t, BimeraParams(method=method)).collect()}
        assert left == {a, b}, method
    with pytest.raises(ValueError):
        tables.without_bimeras(t, BimeraParams(method="other"))
    d = tables.chimera_diagnostics(t).collect()
    assert [r["query"] for r in d] == [a[:10] + b[10:]] and d[0]["gap"] == 0


def test_taxonomy_and_species(spark):
    import random

    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT", k=120)) for _ in range(4)]
    refs = spark.createDataFrame([(f"K;P{i % 2};G{i};", s) for i, s in enumerate(seqs)], "header string, seq string")
    queries = spark.createDataFrame([(s[:100],) for s in seqs] + [("ACGT",)], "seq string")
    got = {r["seq"]: r for r in taxonomy.assign_taxonomy(queries, refs, TaxonomyParams(levels=("K", "P", "G"))).collect()}
    assert [got[s[:100]]["taxonomy"] for s in seqs] == [["K", f"P{i % 2}", f"G{i}"] for i in range(4)]
    assert got["ACGT"]["taxonomy"] == [None] * 3
    kinds = spark.createDataFrame([("r1 Ga one", seqs[0]), ("r2 Ga two", seqs[0]), ("r3 Gb one", seqs[1]), ("r4 Gc x", seqs[1])], "header string, seq string")
    out = {r["seq"]: (r["genus"], r["species"]) for r in taxonomy.assign_species(refs, taxonomy.species_references(kinds), allow_multiple=0).collect()}
    assert out[seqs[0]] == ("Ga", "one/two") and out[seqs[1]] == (None, None) and out[seqs[2]] == (None, None)


def test_fastq_round_trip(spark, tmp_path):
    r = spark.createDataFrame([(f"r{i}", "d" if i % 2 else "", "ACGT" * (i + 1), "IIII" * (i + 1)) for i in range(50)], "name string, descr string, seq string, qual string")
    assert files.write_fastq(r.coalesce(1), str(tmp_path / "a"))
    back = files.read_fastq(spark, str(tmp_path / "a"))
    assert rows(back.select("name", "descr", "seq", "qual"), "name") == rows(r, "name")
    assert [x["read_no"] for x in back.orderBy("read_no").collect()] == list(range(50))
    assert not files.write_fastq(r.where("false"), str(tmp_path / "b"))


def test_fasta_and_stage_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one a\nACG\nT\n>two\nGG\n")
    assert rows(files.read_fasta(spark, str(tmp_path / "x.fa")), "header") == [("one a", "ACGT"), ("two", "GG")]
    df = spark.createDataFrame([("ACG", 2)], "seq string, n int")
    files.write_stage(df, str(tmp_path / "s"), "derep")
    assert rows(files.read_stage(spark, str(tmp_path / "s"), "seq string, n int", ["derep"]), "seq") == [("ACG", 2)]
    with pytest.raises(Exception, match="made by step"):
        files.read_stage(spark, str(tmp_path / "s"), "seq string, n int", ["other"]).collect()


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from ampliframe.streaming import ingest

    r = spark.createDataFrame([("s", f"r{i}", "ACGT" if i % 3 else "GG", "IIII") for i in range(30)], "sample_id string, read_id string, seq string, qual string").withColumn("arrived", F.current_timestamp())
    r.write.parquet(str(tmp_path / "in"))
    q = ingest.running_counts(ingest.read_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("streamed"), "seq") == rows(derep.counts(r), "seq")


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_learn_errors_query_takes_the_default_rounds(spark, monkeypatch):
    from ampliframe.params import LearnParams
    from ampliframe.plans import registry

    seen, learn = [], registry.errors.learn_errors
    monkeypatch.setattr(registry.errors, "learn_errors", lambda uniques, params: seen.append(params) or learn(uniques, params))
    assert registry.learn_errors(spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [LearnParams()]


def test_command_line(spark, tmp_path):
    from ampliframe import cli
    from ampliframe.plans import fixtures
    from ampliframe.sources import files

    at = lambda name: str(tmp_path / name)
    rows = fixtures.reads(spark, "/root/testdata/sf0.001").where("sample_id = 's0'").select(F.col("read_id").alias("name"), F.lit("").alias("descr"), "seq", "qual")
    files.write_fastq(rows.coalesce(1), at("raw"))
    cli.main(["filter", at("raw"), "--out", at("filtered"), "--trunc-q", "0", "--min-len", "20"], spark)
    cli.main(["derep", at("filtered"), "--out", at("uniques")], spark)
    cli.main(["learn-errors", at("uniques"), "--out", at("rates"), "--model", "noqual"], spark)
    cli.main(["denoise", at("uniques"), "--rates", at("rates"), "--out", at("variants")], spark)
    cli.main(["table", at("variants"), "--out", at("table")], spark)
    cli.main(["remove-bimera", at("table"), "--out", at("clean")], spark)
    files.write_fasta(fixtures.templates(spark).select("header", "seq"), at("refs.fasta"), "header")
    cli.main(["assign-taxonomy", at("clean"), "--references", at("refs.fasta"), "--out", at("taxonomy")], spark)
    cli.main(["summary", at("raw"), "--out", at("summary")], spark)
    table = files.read_counts(spark, at("table"))
    assert table.agg(F.sum("count")).collect()[0][0] <= rows.count() and table.count() >= 7
    assert spark.read.option("sep", "\t").option("header", True).csv(at("taxonomy")).count() == files.read_queries(spark, at("clean")).count()
    with pytest.raises(ValueError, match="no input paths"):
        cli.main(["summary", "", "--out", at("none")], spark)
    with pytest.raises(ValueError, match="not an error model"):
        files.checked_rates(spark.createDataFrame([("A", "A", 0, 1.0)], "ref_nt string, query_nt string, q int, rate double"))


def test_streamed_tables_hold_the_last_counts(spark, tmp_path):
    from ampliframe.streaming import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("s", f"r{i}", "ACGT"[i % 3 :], "I" * 4, None) for i in range(12)]
    for part in range(4):
        spark.createDataFrame(rows[3 * part : 3 * part + 3], ingest.READS).coalesce(1).write.mode("append").parquet(src)
    q = ingest.to_table(ingest.running_counts(ingest.read_stream(spark, src, 1)), out, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r["count"] for r in ingest.latest(spark, out).collect()) == [4, 4, 4]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("version_")]) == 2


def test_bimeras_over_small_tables_equal_the_plain_rule(spark):
    """Every pair aligned by the plain recurrence, coverage counted column by column."""
    import random

    from ampliframe.functions import align as al
    from ampliframe.operators import tables
    from ampliframe.params import BimeraParams

    rng = random.Random(3)
    base = ["".join(rng.choices("ACGT", k=50)) for _ in range(4)]
    rows = [("s", b, 100 - i) for i, b in enumerate(base)]
    rows += [("s", base[0][:25] + base[1][25:], 5), ("s", base[2][:20] + base[3][20:], 4), ("s", base[1][:-1] + "A", 3), ("s", base[0][3:] + "ACG", 2), ("s", base[0][:24] + "T" + base[1][25:], 2)]
    rows = list({r[1]: r for r in rows}.values())
    for one_off in (False, True):
        params = BimeraParams(allow_one_off=one_off)

        def covered(query, parent, params=params):
            q, p = (list(x) for x in al.align(query, parent, al.Scoring(band=params.max_shift)))
            out = []
            for a, b in ((q, p), (q[::-1], p[::-1])):
                while a and a[0] == "-":
                    a, b = a[1:], b[1:]
                k = 0
                while k < len(a) and b[k] == "-" and k < params.max_shift:
                    k += 1
                while k < len(a) and a[k] == b[k]:
                    k += 1
                more = k
                if params.allow_one_off and k + 1 < len(a):
                    more = k + (a[k + 1] != "-")
                    j = k + 1
                    while j < len(a) and a[j] == b[j]:
                        j, more = j + 1, more + 1
                out.append((k, more))
            return out[0][0], out[1][0], out[0][1], out[1][1]

        for _, query, n in rows:
            for _, parent, m in rows:
                if m > n:
                    got = tables.coverage(*(al.encoded(x) for x in al.align(query, parent, al.Scoring(band=16))), params)
                    assert got == covered(query, parent)
    table = spark.createDataFrame(rows, "sample_id string, seq string, count long")
    flagged = {r["query"] for r in tables.bimera_flags(table, BimeraParams()).where("flagged").collect()}
    assert {base[0][:25] + base[1][25:], base[2][:20] + base[3][20:]} <= flagged and not flagged & set(base)


def test_births_descent_and_failed_reads(spark):
    from ampliframe.params import DenoiseParams, LearnParams
    from ampliframe.plans import fixtures

    uniques = derep.dereplicate(fixtures.reads(spark, "/root/testdata/sf0.001")).persist()
    model = errors.default_model(41)
    found = dn.variants(dn.denoise(uniques, model, LearnParams().denoise)).persist()
    rows = {(r["sample_id"], r["asv_idx"]): r for r in found.collect()}
    subs = {(r["sample_id"], r["asv_idx"]): r["n"] for r in dn.birth_substitutions(found).groupBy("sample_id", "asv_idx").agg(F.count("*").alias("n")).collect()}
    for key, r in rows.items():
        if key[1]:
            assert subs.get(key, 0) == r["birth_hamming"]
    depth = {}
    for s, i in sorted(rows):
        depth[s, i] = depth[s, rows[s, i]["birth_from"]] + 1 if i else 0
    tree = dn.generations(found.select("sample_id", F.col("asv_idx").alias("idx"), F.col("birth_from").alias("parent"))).collect()
    assert sum(r["n"] for r in tree) == len(rows)
    assert all(r["n"] == sum(d == r["depth"] for (s, _), d in depth.items() if s == r["sample_id"]) for r in tree)
    post = {(r["sample_id"], r["asv_idx"]): r["post_pval"] for r in dn.posthoc_pvalues(found).collect()}
    assert all((p is None) == (i == 0) and (p is None or 0 <= p <= 1) for (_, i), p in post.items())
    strict = dn.denoise(uniques, model, DenoiseParams(omega_c=0.01)).persist()
    failed = dn.failed_uniques(strict).agg(F.sum("reads")).collect()[0][0] or 0
    assert failed + dn.variants(strict).agg(F.sum("kept_abundance")).collect()[0][0] == uniques.agg(F.sum("count")).collect()[0][0]
