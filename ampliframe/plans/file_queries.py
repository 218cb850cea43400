"""Queries that go through files, filter steps and small functions, with their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliframe.functions import sequences as sq
from ampliframe.operators import derep, reads, tables, taxonomy
from ampliframe.params import FilterParams, PrimerParams
from ampliframe.plans import fixtures
from ampliframe.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"with recursive {fixtures.READS_SQL.strip()}, {fixtures.TEMPLATES_SQL.strip()} {sql}"
        return function

    return add


def _folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share; a temporary one only in local runs without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="files-")
    return f"{configured.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.reads(spark, sf_dir)


def _uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derep.rank_uniques(derep.counts(_reads(spark, sf_dir)))


# --- files -----------------------------------------------------------------------


@query("select concat(sample_id, ':', read_id) as name, template descr, seq, qual from reads")
def fastq_round_trip(spark, sf_dir):
    path = _folder(spark, "fastq")
    files.write_fastq(_reads(spark, sf_dir).select(F.concat_ws(":", "sample_id", "read_id").alias("name"), F.col("template").alias("descr"), "seq", "qual"), path)
    return files.read_fastq(spark, path).select("name", "descr", "seq", "qual")


@query("select distinct md5(seq) header, seq from uniq")
def fasta_round_trip(spark, sf_dir):
    path = _folder(spark, "fasta")
    files.write_fasta(_uniques(spark, sf_dir).select(sq.sequence_id(F.col("seq")).alias("sequence_id"), "seq").distinct(), path)
    return files.read_fasta(spark, path)


@query("select sample_id, idx uniq_idx, seq, n as count from ranked")
def uniques_round_trip(spark, sf_dir):
    path = _folder(spark, "uniques")
    files.write_stage(derep.dereplicate(_reads(spark, sf_dir)), path, "derep")
    return files.read_uniques(spark, path).select("sample_id", "uniq_idx", "seq", "count")


@query("select sample_id, seq, n as count from uniq")
def counts_by_step(spark, sf_dir):
    path = _folder(spark, "table")
    files.write_by_sample(tables.sequence_table(_uniques(spark, sf_dir)), path, "table")
    return files.read_counts(spark, path)


@query("select distinct seq from uniq")
def query_sequences(spark, sf_dir):
    path = _folder(spark, "table")
    files.write_stage(tables.sequence_table(_uniques(spark, sf_dir)), path, "table")
    return files.read_queries(spark, path)


@query("select distinct seq, substr(seq, 1, 4) first, 'NA' other from uniq")
def taxonomy_file(spark, sf_dir):
    rows = _uniques(spark, sf_dir).select("seq").distinct().withColumn("taxonomy", F.array(F.substring("seq", 1, 4), F.lit(None).cast("string")))
    path = _folder(spark, "taxonomy")
    files.write_tsv(files.taxonomy_table(rows, ["first", "other"]), path)
    return spark.read.option("sep", "\t").option("header", True).schema("seq string, first string, other string").csv(path)


# --- filter steps ----------------------------------------------------------------


def _step(sql: str, name: str, **given):
    def run(spark, sf_dir):
        none = FilterParams(trunc_q=0, min_len=0, max_n=None)
        params = FilterParams(**({f: getattr(none, f) for f in ("trunc_q", "min_len", "max_n")} | given))
        return reads.filtered(_with_ns(spark, sf_dir), params).select("sample_id", "read_id", "seq", "qual")

    run.__name__ = name
    return query(f"{_NS_SQL} {sql}")(run)


#: Reads of which an eighth is cut to 40 bases, and an eighth has an N.
_NS_SQL = """, ns as (select sample_id, read_id, case when substr(read_id, 3, 1) in ('0', '1') then substr(seq, 1, 40) when substr(read_id, 3, 1) in ('2', '3') then concat(substr(seq, 1, 9), 'N', substr(seq, 11)) else seq end seq,
  case when substr(read_id, 3, 1) in ('0', '1') then substr(qual, 1, 40) else qual end qual from reads)"""


def _with_ns(spark, sf_dir):
    third = F.substring("read_id", 3, 1)
    seq = F.when(third.isin("0", "1"), F.substring("seq", 1, 40)).when(third.isin("2", "3"), F.concat(F.substring("seq", 1, 9), F.lit("N"), F.substring("seq", 11, 64))).otherwise(F.col("seq"))
    return _reads(spark, sf_dir).withColumns({"seq": seq, "qual": F.when(third.isin("0", "1"), F.substring("qual", 1, 40)).otherwise(F.col("qual"))})


_step("select * from ns where length(seq) <= 50", "filter_max_len", max_len=50)
_step("select sample_id, read_id, substr(seq, 6, length(seq) - 8) seq, substr(qual, 6, length(qual) - 8) qual from ns", "filter_trim", trim_left=5, trim_right=3)
_step("select sample_id, read_id, substr(seq, 1, 50) seq, substr(qual, 1, 50) qual from ns where length(seq) >= 50", "filter_trunc_len", trunc_len=50)
_step("select * from ns where length(seq) >= 41", "filter_min_len", min_len=41)
_step("select * from ns where seq not like '%N%'", "filter_max_n", max_n=0)
_step("select * from ns where not regexp_matches(qual, '[!-F]')", "filter_min_q", min_q=38)


@query(f"{_NS_SQL} select sample_id, count(*) reads_in, count_if(length(seq) >= 50) reads_out, cast(sum(length(seq)) as bigint) bases_in, cast(coalesce(sum(length(seq)) filter (length(seq) >= 50), 0) as bigint) bases_out from ns group by 1")
def filter_statistics(spark, sf_dir):
    raw = _with_ns(spark, sf_dir)
    return reads.filter_statistics(raw, raw.where(F.length("seq") >= 50))


_COMPLEX_SQL = """, k2 as (select seq, substr(seq, cast(i as int), 2) kmer, count(*) n from (select distinct seq, unnest(range(1, 64)) i from uniq) group by all),
  complexity as (select seq, exp(-sum(n / 63.0 * ln(n / 63.0))) c from k2 group by seq)"""


@query(f"{_COMPLEX_SQL} select seq, round(c, 6) c from complexity")
def sequence_complexity(spark, sf_dir):
    return _uniques(spark, sf_dir).select("seq").distinct().select("seq", F.round(sq.effective_kmers(F.col("seq")), 6).alias("c"))


@query(f"{_COMPLEX_SQL} select sample_id, cast(least(floor(c / 16 * 100), 99) as int) bin, count(*) n from reads join complexity using (seq) group by 1, 2")
def complexity_histogram(spark, sf_dir):
    return reads.complexity_histogram(_reads(spark, sf_dir))


@query(f"{_COMPLEX_SQL} select sample_id, read_id from reads join complexity using (seq) where c >= 12.5")
def filter_complexity(spark, sf_dir):
    return reads.filtered(_reads(spark, sf_dir), FilterParams(trunc_q=0, low_complexity=12.5)).select("sample_id", "read_id")


@query("select sample_id, read_id from reads where template <> '3'")
def without_contaminant(spark, sf_dir):
    genome = fixtures.templates(spark).where("t = '3'").first()["seq"]
    return reads.without_phix(_reads(spark, sf_dir), genome).select("sample_id", "read_id")


# --- primers ---------------------------------------------------------------------

_PRIMER = "GTGYCAGCMGCCGCGGTAA"
_SITE = "concat('GTG', substr('CT', 1 + ascii(substr(read_id, 5, 1)) % 2, 1), 'CAGC', substr('AC', 1 + ascii(substr(read_id, 6, 1)) % 2, 1), 'GCCGCGGTAA')"


def _primed(spark, sf_dir):
    """Reads with one of the primer's four forms in front; an eighth without, a quarter from the other strand."""
    odd = lambda i: F.ascii(F.substring("read_id", i, 1)) % 2
    site = F.concat(F.lit("GTG"), F.when(odd(5) == 0, "C").otherwise("T"), F.lit("CAGC"), F.when(odd(6) == 0, "A").otherwise("C"), F.lit("GCCGCGGTAA"))
    without = F.substring("read_id", 4, 1).isin("0", "1")
    seq = F.when(without, F.col("seq")).otherwise(F.concat(site, "seq"))
    qual = F.when(without, F.col("qual")).otherwise(F.concat(F.lit("I" * 19), "qual"))
    back = F.substring("read_id", 7, 1).isin("0", "1", "2", "3")
    rows = _reads(spark, sf_dir).select("sample_id", F.col("read_id").alias("read_no"), "read_id", seq.alias("s"), qual.alias("q"))
    return rows.select("sample_id", "read_no", F.when(back, sq.reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("seq"), F.when(back, F.reverse("q")).otherwise(F.col("q")).alias("qual"))


@query("select sample_id, read_id read_no, seq, qual from reads where substr(read_id, 4, 1) not in ('0', '1')")
def primers_trimmed(spark, sf_dir):
    found = reads.primers_removed(_primed(spark, sf_dir), PrimerParams(forward=_PRIMER))
    return found.where("outcome = 'passed'").select("sample_id", "read_no", "seq", "qual")


@query("select sample_id, case when substr(read_id, 4, 1) in ('0', '1') then 'no_primer' else 'passed' end outcome, count(*) n from reads group by 1, 2")
def primer_outcomes(spark, sf_dir):
    return reads.outcome_counts(reads.primers_removed(_primed(spark, sf_dir), PrimerParams(forward=_PRIMER)))


@query("select distinct seq, regexp_matches(seq, 'A[CT][AG]C.G') hit, reverse(translate(upper(substr(seq, 1, 12)), 'ACGT', 'TGCA')) rc, true acgt from uniq")
def ambiguity_codes(spark, sf_dir):
    rows = _uniques(spark, sf_dir).select("seq").distinct()
    return rows.select("seq", F.col("seq").rlike(sq.primer_pattern("AYRCNG")).alias("hit"), sq.iupac_reverse_complement(F.substring("seq", 1, 12)).alias("rc"), sq.is_acgt(F.col("seq")).alias("acgt"))


# --- uniques, tables, taxonomy ---------------------------------------------------


@query("select r.sample_id, r.read_id read_no, u.idx uniq_idx from reads r join ranked u on r.sample_id = u.sample_id and r.seq = u.seq")
def read_map(spark, sf_dir):
    return derep.read_map(_reads(spark, sf_dir).withColumnRenamed("read_id", "read_no"), _uniques(spark, sf_dir))


_K5_SQL = """, pairs as (select distinct u.seq a, t.seq b from uniq u cross join tpls t), seqs as (select seq from uniq union select seq from tpls),
  kc as (select seq, substr(seq, cast(i as int), 5) kmer, cast(count(*) as int) n from (select seq, unnest(range(1, 61)) i from seqs) group by all),
  shared as (select a, b, cast(sum(least(x.n, y.n, 255)) as bigint) matches from pairs join kc x on x.seq = a join kc y on y.seq = b and y.kmer = x.kmer group by a, b)"""


def _pairs(spark, sf_dir):
    uniques = _uniques(spark, sf_dir).select(F.col("seq").alias("a")).distinct()
    return uniques.crossJoin(F.broadcast(fixtures.templates(spark).select(F.col("seq").alias("b"))))


@query(f"{_K5_SQL} select p.a, p.b, coalesce(matches, 0) matches, round(1 - coalesce(matches, 0) / 60.0, 6) dist from pairs p left join shared s on p.a = s.a and p.b = s.b")
def kmer_matches(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    every = pairs.select(F.col("a").alias("seq")).union(pairs.select("b")).distinct()
    return tables.kmer_matches(every, pairs, 5).withColumn("dist", F.round("dist", 6))


@query(", pairs as (select distinct u.seq a, t.seq b from uniq u cross join tpls t) select a, b, cast(len(list_filter(range(1, 61), lambda i: substr(a, cast(i as int), 5) = substr(b, cast(i as int), 5))) as int) matches from pairs")
def ordered_kmer_matches(spark, sf_dir):
    return tables.ordered_kmer_matches(_pairs(spark, sf_dir), 5)


@query(
    """, x as (select seq, n from uniq where sample_id = 's0'), y as (select seq, n from uniq where sample_id = 's1'), j as (select x.n a, y.n b from x full join y on x.seq = y.seq)
    select round(count_if(a is not null and b is not null) / count(b), 9) recall, round(count_if(a is not null and b is not null) / count(a), 9) as precision, round(count_if(a is not null and b is not null) / count(*), 9) jaccard, round(corr(log10(a), log10(b)), 6) log_correlation from j"""
)
def table_concordance(spark, sf_dir):
    t = _uniques(spark, sf_dir)
    one = lambda s: t.where(F.col("sample_id") == s).withColumn("sample_id", F.lit("same"))
    found = tables.concordance(one("s0"), one("s1"))
    return found.select(*[F.round(c, 9).alias(c) for c in ("recall", "precision", "jaccard")], F.round("log_correlation", 6).alias("log_correlation"))


@query("select sample_id, cast(count(*) as bigint) forward, count_if(substr(read_id, 3, 1) in ('0', '1')) as reverse, 'other numbers of reads' problem from reads where sample_id <> 's3' group by 1 union all select 's3', 0, count_if(substr(read_id, 3, 1) in ('0', '1')), 'no forward reads' from reads where sample_id = 's3'")
def pairing_problems(spark, sf_dir):
    r = _reads(spark, sf_dir)
    return tables.pairing_problems(r.where("sample_id <> 's3'"), r.where(F.substring("read_id", 3, 1).isin("0", "1")))


@query("select concat('K|P', cast(cast(t as int) % 2 as varchar), '|C', cast(cast(t as int) % 4 as varchar), '|G', t, '|?unspecified') lineage, seq from tpls")
def reference_lineages(spark, sf_dir):
    rows = taxonomy.lineages(fixtures.templates(spark).select("header", "seq"), 5)
    return rows.select(F.array_join("lineage", "|").alias("lineage"), "seq")


@query("select distinct u.seq, case when t.t is not null then concat('G', t.t) end genus, case when t.t is not null and cast(t.t as int) % 2 = 0 then concat('sp', t.t) end species from uniq u left join tpls t on t.seq = u.seq")
def species_of_genus(spark, sf_dir):
    """Species kept where a classifier names the same genus: here it does so for even templates, in each accepted form."""
    refs = fixtures.templates(spark).select("seq", F.concat(F.lit("r"), "t", F.lit(" G"), "t", F.lit(" sp"), "t").alias("header"), "t")
    found = taxonomy.assign_species(_uniques(spark, sf_dir), taxonomy.species_references(refs))
    forms = F.when(F.col("t") == "0", "G0").when(F.col("t") == "2", "G2 group").when(F.col("t") == "4", "G4/H4").when(F.col("t") == "6", "H6/G6").otherwise("Other")
    classified = refs.select("seq", F.array(*[F.lit("x")] * 5, forms).alias("taxonomy"))
    return taxonomy.species_of_genus(found, classified).select("seq", "genus", "species")


@query("select sample_id, seq, n as count from uniq where sample_id <= (select min(s) from (select sample_id s, sum(sum(n * 64)) over (order by sample_id) upto from uniq group by 1) where upto >= (select sum(n * 64) / 2.0 from uniq))")
def learning_samples(spark, sf_dir):
    uniques = _uniques(spark, sf_dir)
    half = uniques.agg(F.sum(F.col("count") * F.length("seq"))).collect()[0][0] / 2
    return derep.within_bases(uniques, half).select("sample_id", "seq", "count")
