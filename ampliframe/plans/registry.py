"""Queries of the sequence engine by name, and the DuckDB SQL of each that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliframe.functions import sequences as sq
from ampliframe.operators import denoise as dn
from ampliframe.operators import derep, errors, reads, tables, taxonomy
from ampliframe.params import BimeraParams, DenoiseParams, FilterParams, LearnParams, MergeParams, PrimerParams
from ampliframe.plans import file_queries, fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The feature of ``nearest_parent``: the first uniques of a sample.
TOP_PARENTS = 20
FILTER = FilterParams(trunc_q=20, min_len=20, max_n=0, max_ee=0.01)
SAMPLES = ["s0", "s1", "s2", "s3"]
_Q = "list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)"
_RC = "reverse(regexp_replace(translate({0}, 'ACGTacgtUu', 'TGCATGCAAA'), '[^ACGT]', 'N', 'g'))"


def query(sql: str | None = None):
    """Register a query under its own name; ``sql`` may use the reads' and templates' table expressions."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = f"with recursive {fixtures.READS_SQL.strip()}, {fixtures.TEMPLATES_SQL.strip()} {sql}"
        return function

    return add


def _uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derep.rank_uniques(derep.counts(fixtures.reads(spark, sf_dir)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unique with every template."""
    uniques = _uniques(spark, sf_dir).select(F.col("seq").alias("a")).distinct()
    return uniques.crossJoin(F.broadcast(fixtures.templates(spark).select(F.col("seq").alias("b"))))


_PAIRS_SQL = ", pairs as (select distinct u.seq a, t.seq b from uniq u cross join tpls t)"


# --- reads -----------------------------------------------------------------------

_CUT_SQL = r"length(regexp_extract(qual, '^[^!-5]*'))"
_PASSED_SQL = f"""
, cut as (select sample_id, read_id, substr(seq, 1, {_CUT_SQL}) seq, substr(qual, 1, {_CUT_SQL}) qual from reads),
passed as (select * from cut where length(seq) >= 20 and length(seq) = length(translate(seq, 'Nn', ''))
           and list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0))) <= 0.01)
"""


@query(f"{_PASSED_SQL} select sample_id, read_id, seq, qual from passed")
def read_filter(spark, sf_dir):
    return reads.filtered(fixtures.reads(spark, sf_dir), FILTER).select("sample_id", "read_id", "seq", "qual")


@query(f"select sample_id, read_id, cast({_CUT_SQL} as int) cut from reads")
def trunc_q(spark, sf_dir):
    return fixtures.reads(spark, sf_dir).select("sample_id", "read_id", sq.quality_cut(F.col("qual"), 20).cast("int").alias("cut"))


@query("select sample_id, read_id, round(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0))), 6) ee from reads")
def max_ee(spark, sf_dir):
    return fixtures.reads(spark, sf_dir).select("sample_id", "read_id", F.round(sq.expected_errors(F.col("qual")), 6).alias("ee"))


@query("select sample_id, read_id, translate(qual, 'GH', 'II') qual from reads")
def requantise(spark, sf_dir):
    return fixtures.reads(spark, sf_dir).select("sample_id", "read_id", sq.requantised(F.col("qual"), [2, 20, 30, 40]).alias("qual"))


@query("select sample_id, read_id, seq from reads where substr(md5(read_id), 1, 1) in ('0', '1', '2', '3')")
def hash_subsample(spark, sf_dir):
    return derep.hash_subsample(fixtures.reads(spark, sf_dir), "read_id", 64).select("sample_id", "read_id", "seq")


@query("select sample_id, cast(sum(length(seq)) as bigint) bases from reads group by sample_id having (select coalesce(sum(length(r.seq)), 0) from reads r where r.sample_id < reads.sample_id) < 1500000")
def bases_cutoff(spark, sf_dir):
    sums = fixtures.reads(spark, sf_dir).groupBy("sample_id").agg(F.sum(F.length("seq")).alias("bases"))
    return derep.bases_cutoff(sums.withColumn("ord", F.col("sample_id")), 1_500_000).select("sample_id", "bases")


# --- dereplication ---------------------------------------------------------------


@query("select sample_id, seq, n as count from uniq")
def derep_counts(spark, sf_dir):
    return derep.counts(fixtures.reads(spark, sf_dir))


QUERIES["derep"], ORACLES["derep"] = QUERIES.pop("derep_counts"), ORACLES.pop("derep_counts")


@query("select sample_id, seq, n as count, idx uniq_idx from ranked")
def derep_rank(spark, sf_dir):
    return _uniques(spark, sf_dir)


_SPREAD_SQL = f", spread as (select sample_id, seq, read_id, cast(unnest(range(length(qual))) as int) pos, unnest({_Q}) q from reads)"
_SUMS_SQL = f"{_SPREAD_SQL}, sums as (select sample_id, seq, pos, cast(sum(q) as bigint) qsum from spread group by all)"


@query(f"{_SUMS_SQL} select * from sums")
def derep_qual_sum(spark, sf_dir):
    return derep.quality_sums(fixtures.reads(spark, sf_dir))


@query(f"{_SUMS_SQL} select s.sample_id, s.seq, s.pos, cast(floor(qsum / n + 0.5) as int) q from sums s join uniq u on s.sample_id = u.sample_id and s.seq = u.seq")
def mean_quality(spark, sf_dir):
    uniques = derep.dereplicate(fixtures.reads(spark, sf_dir))
    spread = uniques.select("sample_id", "seq", "count", F.posexplode("qual_sum").alias("pos", "s"))
    return spread.select("sample_id", "seq", "pos", F.floor(F.col("s") / F.col("count") + 0.5).cast("int").alias("q"))


# --- summaries -------------------------------------------------------------------


@query(f"{_SPREAD_SQL} select sample_id, pos, round(avg(q), 6) mean_q, count(*) coverage from spread group by all")
def cycle_quality(spark, sf_dir):
    return reads.cycle_quality(fixtures.reads(spark, sf_dir)).withColumn("mean_q", F.round("mean_q", 6))


@query(f"{_SPREAD_SQL} select sample_id, pos, cast(q as int) q, count(*) n from spread group by all")
def cycle_histogram(spark, sf_dir):
    return reads.cycle_histogram(fixtures.reads(spark, sf_dir))


@query(
    f"""{_SPREAD_SQL}, ee as (select sample_id, pos, sum(pow(10.0, -q / 10.0)) over (partition by read_id, sample_id, seq, copy order by pos) ee
         from (select *, row_number() over (partition by sample_id, read_id, seq, pos order by q) copy from spread))
    , cells as (select sample_id, pos, greatest(0, least(199, floor((log10(greatest(ee, 1e-300)) + 4) / 7 * 200))) bin, count(*) n from ee group by all),
    upto as (select *, sum(n) over (partition by sample_id, pos order by bin) upto, sum(n) over (partition by sample_id, pos) total, pow(10.0, (bin + 0.5) / 200 * 7 - 4) centre from cells),
    quarters as (select sample_id, pos, round(min(centre) filter (upto >= 0.25 * total), 6) q25, round(min(centre) filter (upto >= 0.5 * total), 6) median, round(min(centre) filter (upto >= 0.75 * total), 6) q75 from upto group by all),
    plain as (select sample_id, pos, round(avg(ee), 6) mean, round(min(ee), 6) min, round(max(ee), 6) max from ee group by all)
    select * from plain join quarters using (sample_id, pos)"""
)
def cumulative_ee(spark, sf_dir):
    out = reads.cumulative_error_summary(fixtures.reads(spark, sf_dir))
    return out.select("sample_id", "pos", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "q25", "median", "q75")])


@query(f"{_SPREAD_SQL} select sample_id, cast(q as int) q, count(*) n from spread group by all")
def quality_values(spark, sf_dir):
    return reads.quality_values(fixtures.reads(spark, sf_dir))


@query(f"{_SPREAD_SQL} select sample_id, count(distinct q) n_values, count(distinct q) between 2 and 8 binned from spread group by sample_id")
def binned_verdict(spark, sf_dir):
    return reads.binned_verdict(reads.quality_values(fixtures.reads(spark, sf_dir)))


@query(f"{_SPREAD_SQL} select cast(q as int) q, count(*) n, q in (20, 39, 40) expected from spread group by q")
def summary_merge(spark, sf_dir):
    return reads.merged_summary(reads.quality_values(fixtures.reads(spark, sf_dir)), [20, 39, 40])


# --- k-mers and strands ----------------------------------------------------------

_KMER_SQL = ", seqs as (select distinct seq from uniq), km as (select seq, substr(seq, cast(i as int), {k}) kmer from (select seq, unnest(range(1, length(seq) - {k} + 2)) i from seqs)), kc as (select seq, kmer, cast(count(*) as int) n from km group by all)"


@query(_KMER_SQL.format(k=3) + " select seq, kmer, n from kc")
def kmer_counts(spark, sf_dir):
    return tables.kmer_counts(_uniques(spark, sf_dir).select("seq").distinct(), 3)


_DIST_SQL = _PAIRS_SQL + _KMER_SQL.format(k=5).replace("from uniq)", "from uniq union select seq from tpls)") + ", shared as (select a, b, sum(least(x.n, y.n)) s from pairs join kc x on x.seq = a join kc y on y.seq = b and y.kmer = x.kmer group by a, b)"


@query(_DIST_SQL + " select p.a, p.b, round(1 - coalesce(s, 0) / (least(length(p.a), length(p.b)) - 4.0), 6) dist from pairs p left join shared h on p.a = h.a and p.b = h.b")
def kmer_dist(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    both = pairs.select(F.col("a").alias("seq")).union(pairs.select("b")).distinct()
    return tables.kmer_distances(both, pairs, 5).select("a", "b", F.round("dist", 6).alias("dist"))


@query(_PAIRS_SQL + " select a, b, round(1 - len(list_filter(range(1, length(a) - 3), lambda i: substr(a, cast(i as int), 5) = substr(b, cast(i as int), 5))) / (length(a) - 4.0), 6) dist from pairs")
def kord_dist(spark, sf_dir):
    return tables.ordered_kmer_distances(_pairs(spark, sf_dir), 5).select("a", "b", F.round("dist", 6).alias("dist"))


@query(
    _KMER_SQL.format(k=5)
    + f""", cand as (select x.sample_id, x.seq a, y.seq b, y.idx from ranked x join ranked y on x.sample_id = y.sample_id and y.n > x.n where x.idx < {TOP_PARENTS} and y.idx < {TOP_PARENTS}),
    shared as (select sample_id, a, b, idx, sum(least(x.n, y.n)) s from cand join kc x on x.seq = a join kc y on y.seq = b and y.kmer = x.kmer group by all),
    d as (select c.sample_id, c.a, c.b, c.idx, 1 - coalesce(s, 0) / 60.0::double dist from cand c left join shared s on c.sample_id = s.sample_id and c.a = s.a and c.b = s.b)
    select sample_id, a seq, arg_min(b, struct_pack(d := dist, i := idx)) parent, round(min(dist), 6) dist from d group by sample_id, a"""
)
def nearest_parent(spark, sf_dir):
    return tables.nearest_parents(_uniques(spark, sf_dir), 5, TOP_PARENTS).withColumn("dist", F.round("dist", 6))


@query(f"select distinct seq, {_RC.format('seq')} rc from uniq")
def revcomp(spark, sf_dir):
    return _uniques(spark, sf_dir).select("seq", sq.reverse_complement(F.col("seq")).alias("rc")).distinct()


@query("select distinct seq, md5(seq) md5_id, sha1(seq) sha1_id from uniq")
def seq_hash(spark, sf_dir):
    return _uniques(spark, sf_dir).select("seq").distinct().select("seq", sq.sequence_id(F.col("seq")).alias("md5_id"), sq.sequence_id(F.col("seq"), "sha1").alias("sha1_id"))


# --- sequence tables -------------------------------------------------------------


@query(f"{_PASSED_SQL} select sample_id, md5(seq) sequence_id, seq, cast(count(*) as bigint) as count from passed group by sample_id, seq")
def sequence_table(spark, sf_dir):
    passed = reads.filtered(fixtures.reads(spark, sf_dir), FILTER)
    return tables.sequence_table(derep.counts(passed))


@query("select md5(seq) sequence_id, " + ", ".join(f"cast(coalesce(sum(case when sample_id = '{s}' then n end), 0) as bigint) {s}" for s in SAMPLES) + " from uniq group by seq")
def table_pivot(spark, sf_dir):
    return tables.pivoted(tables.sequence_table(_uniques(spark, sf_dir)), SAMPLES)


@query("select seq, cast(sum(n) as bigint) total, count(*) n_samples, cast(row_number() over (order by sum(n) desc, seq) as int) place from uniq group by seq")
def table_order(spark, sf_dir):
    return tables.ordered_sequences(_uniques(spark, sf_dir))


@query("select sample_id, seq, n as count from uniq where seq in (select seq from uniq group by seq having count(*) >= 3 or sum(n) >= 10)")
def prevalence_filter(spark, sf_dir):
    return tables.frequent(_uniques(spark, sf_dir), 3, 10).select("sample_id", "seq", "count")


@query(f"{_PASSED_SQL} select sample_id, seq, cast(count(*) as bigint) as count from passed where length(seq) between 24 and 40 group by sample_id, seq")
def length_filter(spark, sf_dir):
    return tables.of_length(derep.counts(reads.filtered(fixtures.reads(spark, sf_dir), FILTER)), 24, 40)


@query("select sample_id, seq, n as count, seq in (select seq from tpls) prior from uniq")
def prior_semi_join(spark, sf_dir):
    return dn.mark_priors(derep.counts(fixtures.reads(spark, sf_dir)), fixtures.templates(spark)).select("sample_id", "seq", "count", "prior")


@query("select seq, cast(sum(n) as bigint) as count, cast(row_number() over (order by sum(n) desc, seq) - 1 as int) uniq_idx from uniq group by seq")
def pooled_uniques(spark, sf_dir):
    pooled = dn.pooled_uniques(derep.dereplicate(fixtures.reads(spark, sf_dir)))
    return pooled.select("seq", "count", "uniq_idx")


@query()
def failed_uniques(spark, sf_dir):
    uniques = derep.dereplicate(fixtures.reads(spark, sf_dir))
    return dn.failed_uniques(dn.denoise(uniques, _model(spark, sf_dir), DenoiseParams(omega_c=0.01)))


def _mates(spark, sf_dir):
    r = fixtures.reads(spark, sf_dir).withColumnRenamed("read_id", "read_no").dropDuplicates(["sample_id", "read_no"])
    forward = r.select("sample_id", "read_no", F.substring("seq", 1, 44).alias("seq"))
    reverse = r.select("sample_id", "read_no", sq.reverse_complement(F.substring("seq", 21, 44)).alias("seq"))
    return forward, reverse


_MATES_SQL = f", mates as (select sample_id, read_id, substr(any_value(seq), 1, 44) seq_f, {_RC.format('substr(any_value(seq), 21, 44)')} seq_r from reads group by sample_id, read_id)"


@query(f"{_MATES_SQL} select sample_id, seq_f, seq_r, cast(count(*) as bigint) as count from mates group by all")
def pair_counts(spark, sf_dir):
    return tables.pair_counts(*_mates(spark, sf_dir))


@query(f"{_MATES_SQL} select distinct seq_f, seq_r, concat(seq_f, repeat('N', 10), {_RC.format('seq_r')}) seq from mates")
def merge_concat(spark, sf_dir):
    pairs = tables.pair_counts(*_mates(spark, sf_dir)).select("seq_f", "seq_r").distinct()
    return tables.concatenated(pairs)


# --- error models ----------------------------------------------------------------


def _learned(spark, sf_dir):
    """Uniques, and the error model that the learning finds in the reads of all samples.

    The fixture's qualities say nothing of its errors, of which there are some fifteen times as many as they state. Under
    :func:`_model` a substitution is a variant of its own as soon as there are reads enough to tell (about 50 a sequence);
    under rates without qualities, fitted to the reads, it stays an error of its template, which is what the SQL says.
    """
    uniques = derep.dereplicate(fixtures.reads(spark, sf_dir)).persist()
    return uniques, errors.learn_errors(uniques, replace(LearnParams(), bases=math.inf, model="noqual"))[0]


def _transitions(spark, sf_dir):
    """Transitions of every sample's partition, all uniques kept, as the learning of error rates counts them."""
    return dn.transition_counts(*_learned(spark, sf_dir), LearnParams().denoise)


# every unique joins the cluster of the template that it was drawn from
_TRANS_SQL = f"""{_SUMS_SQL}, origin as (select distinct sample_id, seq, template from reads),
trans as (select sample_id, ref_nt, query_nt, q, cast(sum(n) as bigint) n from (
  select s.sample_id, substr(tpls.seq, pos + 1, 1) ref_nt, substr(s.seq, pos + 1, 1) query_nt, cast(floor(qsum / u.n + 0.5) as int) q, u.n
  from sums s join uniq u on s.sample_id = u.sample_id and s.seq = u.seq join origin o on s.sample_id = o.sample_id and s.seq = o.seq join tpls on template = t) group by all)"""


@query(f"{_TRANS_SQL} select * from trans")
def transition_counts(spark, sf_dir):
    return _transitions(spark, sf_dir)


@query(f"{_TRANS_SQL} select ref_nt, query_nt, q, cast(sum(n) as bigint) n from trans group by all")
def accumulate_trans(spark, sf_dir):
    return errors.accumulated(_transitions(spark, sf_dir))


_NOQUAL_SQL = f"""{_TRANS_SQL}, nts as (select unnest(['A', 'C', 'G', 'T']) nt),
full_counts as (select x.nt ref_nt, y.nt query_nt, coalesce(sum(n), 0) + 1.0 n from nts x join nts y on true left join trans on ref_nt = x.nt and query_nt = y.nt group by all),
rates as (select ref_nt, query_nt, n / sum(n) over (partition by ref_nt) rate from full_counts)"""


@query(f"{_NOQUAL_SQL} select ref_nt, query_nt, round(rate, 9) rate from rates")
def noqual_rates(spark, sf_dir):
    return errors.noqual_rates(_transitions(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query(f"{_NOQUAL_SQL} select ref_nt, query_nt, round(3 * rate / (1 + 2 * rate), 9) rate from rates")
def inflate_err(spark, sf_dir):
    return errors.inflated(errors.noqual_rates(_transitions(spark, sf_dir)), 3).withColumn("rate", F.round("rate", 9))


# --- chimeras --------------------------------------------------------------------


def _bimera_table(spark, sf_dir):
    return _uniques(spark, sf_dir).select("sample_id", "seq", "count")


_PARENTS_SQL = """, cand as (select x.sample_id, x.seq query, y.seq parent, x.n n, y.n m from ranked x join ranked y on x.sample_id = y.sample_id and y.n > 1.5 * x.n and y.n >= 2 and x.seq <> y.seq)"""


@query(f"{_PARENTS_SQL} select sample_id, query, count(*) parents from cand group by all")
def parent_candidates(spark, sf_dir):
    return tables.parent_pairs(_bimera_table(spark, sf_dir)).groupBy("sample_id", "query").agg(F.count("*").alias("parents"))


# without shifts an alignment is position by position, which SQL can say; remove_bimera and chimera_diagnostics have the default shifts
_UNSHIFTED = BimeraParams(max_shift=0)
_PREFIX_SQL = "coalesce(list_position(list_transform(range(1, 65), lambda i: substr({0}, cast(i as int), 1) <> substr({1}, cast(i as int), 1)), true) - 1, 64)"
_COVER_SQL = f"""{_PARENTS_SQL}, apart as (select query, parent, {_PREFIX_SQL.format('query', 'parent')} l, {_PREFIX_SQL.format('reverse(query)', 'reverse(parent)')} r from (select distinct query, parent from cand)),
cover as (select cand.*, l, r from cand join apart using (query, parent)),
flags as (select sample_id, query, count(*) parents, max(l) + max(r) >= 64 flagged from cover where l + r < 64 group by all)"""


@query(f"{_COVER_SQL} select * from flags")
def bimera_flags(spark, sf_dir):
    return tables.bimera_flags(_bimera_table(spark, sf_dir), _UNSHIFTED)


_VOTE_SQL = f"""{_COVER_SQL}, every as (select r.seq query, coalesce(flagged, false) flagged from ranked r left join flags f on r.sample_id = f.sample_id and r.seq = f.query),
votes as (select query, count_if(flagged) n_flagged, count(*) n_samples, count_if(flagged) >= count(*) or (count_if(flagged) > 0 and count_if(flagged) >= (count(*) - 1) * 0.9) bimera from every group by query)"""


@query(f"{_VOTE_SQL} select * from votes")
def bimera_vote(spark, sf_dir):
    table = _bimera_table(spark, sf_dir)
    every = table.select("sample_id", F.col("seq").alias("query")).join(tables.bimera_flags(table, _UNSHIFTED), ["sample_id", "query"], "left")
    return tables.consensus_vote(every.withColumn("flagged", F.coalesce("flagged", F.lit(False))))


@query(f"{_VOTE_SQL} select sample_id, seq, n as count from uniq where seq not in (select query from votes where bimera)")
def remove_bimera_unshifted(spark, sf_dir):
    return tables.without_bimeras(_bimera_table(spark, sf_dir), _UNSHIFTED).select("sample_id", "seq", "count")


@query(f"{_COVER_SQL} select u.sample_id, u.seq, u.n as count from uniq u left join flags f on u.sample_id = f.sample_id and u.seq = f.query where not coalesce(parents >= 2 and flagged, false)")
def remove_bimera_per_sample(spark, sf_dir):
    return tables.without_bimeras(_bimera_table(spark, sf_dir), BimeraParams(max_shift=0, method="per-sample")).select("sample_id", "seq", "count")


@query()
def remove_bimera(spark, sf_dir):
    return tables.without_bimeras(_bimera_table(spark, sf_dir), BimeraParams()).select("sample_id", "seq", "count")


# --- taxonomy, truth sets, tracking ----------------------------------------------


@query(
    """, refs as (select cast(cast(t as int) % 4 as varchar) genus, t, seq from tpls),
    k as (select distinct genus, t, substr(seq, cast(i as int), 4) kmer from (select *, unnest(range(1, 62)) i from refs)),
    g as (select genus, kmer, count(*) n_refs from k group by all), p as (select kmer, (sum(n_refs) + 0.5) / 9.0 prior from g group by kmer)
    select genus, kmer, n_refs, round(ln((n_refs + prior) / ((select count(*) from refs r where r.genus = g.genus) + 1)), 6) log_p from g join p using (kmer)"""
)
def genus_kmer_model(spark, sf_dir):
    refs = fixtures.templates(spark).select((F.col("t").cast("int") % 4).cast("string").alias("genus"), "seq")
    return taxonomy.genus_model(refs, 4).select("genus", "kmer", "n_refs", F.round("log_p", 6).alias("log_p"))


@query("select distinct u.seq, case when t.t is not null then concat('G', t.t) end genus, case when t.t is not null then concat('sp', t.t) end species from uniq u left join tpls t on t.seq = u.seq")
def species_lookup(spark, sf_dir):
    refs = fixtures.templates(spark).select("seq", F.concat(F.lit("r"), "t", F.lit(" G"), "t", F.lit(" sp"), "t").alias("header"))
    return taxonomy.assign_species(_uniques(spark, sf_dir), taxonomy.species_references(refs))


@query(
    """, m as (select *, md5(seq) h from ranked),
    b as (select sample_id, idx, ascii(substr(h, 1, 1)) >= 52 b1, ascii(substr(h, 2, 1)) >= 52 b2, ascii(substr(h, 3, 1)) >= 52 b3, ascii(substr(h, 4, 1)) >= 52 b4 from m)
    select sample_id, idx, concat(case when b1 then 'k' else '-' end, case when b1 and b2 then 'p' else '-' end, case when b1 and b2 and b3 then 'c' else '-' end,
           case when b1 and b2 and b3 and b4 then 'g' else '-' end) levels from b"""
)
def tax_truncate(spark, sf_dir):
    boot = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.ascii(F.substring(F.col("h"), i, F.lit(1))))
    rows = _uniques(spark, sf_dir).withColumn("h", F.md5("seq"))
    cut = taxonomy.truncated(F.array(*[F.lit(x) for x in "kpcg"]), boot, 52)
    return rows.select("sample_id", F.col("uniq_idx").alias("idx"), F.array_join(cut, "", "-").alias("levels"))


_EDITS_SQL = ", d as (select distinct u.seq, t.t, len(list_filter(range(1, 65), lambda i: substr(u.seq, cast(i as int), 1) <> substr(t.seq, cast(i as int), 1))) edits from (select distinct seq from uniq) u join tpls t on true)"


def _truth(spark):
    return fixtures.templates(spark).select(F.col("t").alias("ref"), F.col("seq").alias("ref_seq"))


_CLASS_SQL = f"{_EDITS_SQL}, best as (select seq, min(edits) e from d group by seq), classes as (select seq, cast(e as int) edits, case when e = 0 then 'TP' when e <= 3 then 'Near' else 'FP' end class from best)"


@query(f"{_CLASS_SQL} select * from classes")
def reference_evaluation(spark, sf_dir):
    return tables.reference_evaluation(_uniques(spark, sf_dir), _truth(spark)).select("seq", "edits", "class")


@query(f"{_CLASS_SQL} select class, count(*) n from classes group by 1")
def confusion(spark, sf_dir):
    return tables.reference_report(_uniques(spark, sf_dir), _truth(spark))["counts"]


@query(f"{_EDITS_SQL} select cast(unnest([0, 1, 2, 4]) as int) band, 1.0 :: double fraction from (select 1)")
def band_fit(spark, sf_dir):
    return tables.band_fit(tables.align_pairs(_own_pairs(spark, sf_dir)), [0, 1, 2, 4]).withColumn("fraction", F.round("fraction", 6))


def _own_pairs(spark, sf_dir):
    """Every unique with the template that it was drawn from."""
    drawn = fixtures.reads(spark, sf_dir).select(F.col("template").alias("t"), F.col("seq").alias("a")).distinct()
    return drawn.join(fixtures.templates(spark).select("t", F.col("seq").alias("b")), "t").select("a", "b")


@query("select distinct r.seq a, tpls.seq b, r.seq aligned_a, tpls.seq aligned_b, cast(64 - hamming(r.seq, tpls.seq) as int) n_match, cast(hamming(r.seq, tpls.seq) as int) n_mismatch, 0 n_indel, 0 band_needed from reads r join tpls on template = t")
def align_own(spark, sf_dir):
    return tables.align_pairs(_own_pairs(spark, sf_dir))


@query(
    f"""{_PASSED_SQL} select sample_id, a.n as input, coalesce(b.n, 0) filtered, coalesce(c.n, 0) kept
    from (select sample_id, count(*) n from reads group by 1) a left join (select sample_id, count(*) n from passed group by 1) b using (sample_id)
    left join (select sample_id, cast(sum(n) as bigint) n from (select sample_id, seq, count(*) n from passed group by 1, 2) where n >= 3 group by 1) c using (sample_id)"""
)
def step_tracking(spark, sf_dir):
    raw = fixtures.reads(spark, sf_dir)
    count = lambda df: df.groupBy("sample_id").agg(F.count("*").alias("n"))
    # a row a sample; the filter runs once for both of its steps
    sums = derep.counts(reads.filtered(raw, FILTER)).groupBy("sample_id").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("count") >= 3, F.col("count"))).alias("kept")).persist()
    kept = sums.where("kept is not null").select("sample_id", F.col("kept").alias("n"))
    return reads.step_tracking(input=count(raw), filtered=sums.select("sample_id", "n"), kept=kept)


@query(
    """, a as (select seq, cast(sum(n) as bigint) n from uniq where sample_id in ('s0', 's1') group by seq), b as (select seq, cast(sum(n) as bigint) n from uniq where sample_id in ('s2', 's3') group by seq)
    select coalesce(a.seq, b.seq) seq, coalesce(a.n, 0) a_total, coalesce(b.n, 0) b_total, case when b.n is null then 'a' when a.n is null then 'b' else 'both' end side from a full join b on a.seq = b.seq"""
)
def asv_set_diff(spark, sf_dir):
    t = _uniques(spark, sf_dir).select("sample_id", "seq", "count")
    return tables.table_difference(t.where(F.col("sample_id").isin("s0", "s1")), t.where(F.col("sample_id").isin("s2", "s3")))


@query(
    """, kids as (select sample_id, idx, cast(floor((idx - 1) / 2.0) as int) parent from ranked where idx >= 1),
    tree as (select distinct sample_id, 0 idx, 0 depth from ranked where idx = 0 union all select k.sample_id, k.idx, t.depth + 1 from kids k join tree t on k.sample_id = t.sample_id and k.parent = t.idx)
    select sample_id, depth, count(*) n from tree group by all"""
)
def genealogy_recursive(spark, sf_dir):
    """Descent in a tree of all uniques by rank; ``denoise_genealogy`` has the clusters' own."""
    born = _uniques(spark, sf_dir).select("sample_id", F.col("uniq_idx").alias("idx"))
    return dn.generations(born.withColumn("parent", F.floor((F.col("idx") - 1) / 2).cast("int")))


# --- kernels: no SQL, tested against plain versions ------------------------------


def _model(spark, sf_dir):
    return errors.default_model(41)


_ORIGIN_SQL = ", found as (select sample_id, tpls.seq, cast(count(*) as bigint) abundance, cast(count(distinct r.seq) as bigint) n_uniques from reads r join tpls on template = t group by 1, 2)"


def _denoised(spark, sf_dir):
    return dn.denoise(derep.dereplicate(fixtures.reads(spark, sf_dir)), _model(spark, sf_dir), LearnParams().denoise)


def _denoised_as_learned(spark, sf_dir):
    return dn.denoise(*_learned(spark, sf_dir), LearnParams().denoise)


@query(f"{_ORIGIN_SQL} select * from found")
def denoise_variants(spark, sf_dir):
    return dn.variants(_denoised_as_learned(spark, sf_dir)).select("sample_id", "seq", "abundance", "n_uniques")


@query(", m as (select distinct sample_id, seq, template from reads) select m.sample_id, m.seq, tpls.seq center, cast(hamming(m.seq, tpls.seq) as int) hamming from m join tpls on template = t")
def denoise_map(spark, sf_dir):
    rows = _denoised_as_learned(spark, sf_dir)
    centers = rows.where("is_center").select("sample_id", "cluster", F.col("seq").alias("center"))
    return rows.join(centers, ["sample_id", "cluster"]).select("sample_id", "seq", "center", "hamming")


@query(f"{_SUMS_SQL}, o as (select distinct sample_id, seq, template from reads) select sample_id, tpls.seq center, pos, round(sum(qsum) / sum(n), 6) quality from sums join uniq using (sample_id, seq) join o using (sample_id, seq) join tpls on template = t group by 1, 2, 3")
def cluster_quality(spark, sf_dir):
    uniques, err = _learned(spark, sf_dir)
    rows = dn.denoise(uniques, err, LearnParams().denoise)
    centers = rows.where("is_center").select("sample_id", "cluster", F.col("seq").alias("center"))
    return dn.cluster_quality(rows, uniques).join(centers, ["sample_id", "cluster"]).select("sample_id", "center", "pos", F.round("quality", 6).alias("quality"))


@query(f"{_ORIGIN_SQL} select sample_id, seq, abundance from found")
def denoise_pooled_variants(spark, sf_dir):
    pooled = dn.denoise_pooled(*_learned(spark, sf_dir), LearnParams().denoise)
    return pooled.select("sample_id", "seq", "abundance")


@query(f"{_ORIGIN_SQL} select sample_id, seq, abundance from found")
def denoise_pseudo_variants(spark, sf_dir):
    found = dn.denoise_pseudo(*_learned(spark, sf_dir), LearnParams().denoise)
    return dn.variants(found).select("sample_id", "seq", "abundance")


@query()
def denoise_genealogy(spark, sf_dir):
    born = dn.variants(_denoised(spark, sf_dir)).select("sample_id", F.col("asv_idx").alias("idx"), F.col("birth_from").alias("parent"))
    return dn.generations(born)


@query()
def birth_substitutions(spark, sf_dir):
    return dn.birth_substitutions(dn.variants(_denoised(spark, sf_dir)))


@query()
def posthoc_pvalues(spark, sf_dir):
    return dn.posthoc_pvalues(dn.variants(_denoised(spark, sf_dir))).select("sample_id", "asv_idx", "post_pval")


@query()
def denoise_sample(spark, sf_dir):
    return dn.variants(dn.denoise(derep.dereplicate(fixtures.reads(spark, sf_dir)), _model(spark, sf_dir)))


@query()
def denoise_pooled(spark, sf_dir):
    return dn.denoise_pooled(derep.dereplicate(fixtures.reads(spark, sf_dir)), _model(spark, sf_dir))


@query()
def denoise_pseudo(spark, sf_dir):
    return dn.variants(dn.denoise_pseudo(derep.dereplicate(fixtures.reads(spark, sf_dir)), _model(spark, sf_dir)))


@query()
def learn_errors(spark, sf_dir):
    err, _ = errors.learn_errors(derep.dereplicate(fixtures.reads(spark, sf_dir)), LearnParams())
    return errors.to_table(spark, err)


@query()
def loess_rates(spark, sf_dir):
    counts = errors.to_matrix(_transitions(spark, sf_dir), 41)
    return errors.to_table(spark, errors.loess_rates(counts))


# mates come from one read, so they agree in all 24 bases that they share
@query(f"{_MATES_SQL}, whole as (select sample_id, read_id, any_value(seq) seq from reads group by all) select sample_id, seq_f, seq_r, seq, 24 n_match, 0 n_mismatch, 0 n_indel, true accept, cast(count(*) as bigint) as count from mates join whole using (sample_id, read_id) group by 1, 2, 3, 4")
def merge_pairs(spark, sf_dir):
    merged = tables.merge_pairs(tables.pair_counts(*_mates(spark, sf_dir)), MergeParams())
    return merged.select("sample_id", "seq_f", "seq_r", "seq", "n_match", "n_mismatch", "n_indel", "accept", "count")


@query()
def chimera_diagnostics(spark, sf_dir):
    return tables.chimera_diagnostics(_bimera_table(spark, sf_dir), BimeraParams())


@query()
def assign_taxonomy(spark, sf_dir):
    return taxonomy.assign_taxonomy(_uniques(spark, sf_dir), fixtures.templates(spark))


@query()
def remove_primers(spark, sf_dir):
    r = fixtures.reads(spark, sf_dir).select("sample_id", F.col("read_id").alias("read_no"), F.concat(F.lit("GTGCCAGCAGCCGCGGTAA"), "seq").alias("seq"), F.concat(F.lit("I" * 19), "qual").alias("qual"))
    return reads.outcome_counts(reads.primers_removed(r, PrimerParams(forward="GTGYCAGCMGCCGCGGTAA")))


@query()
def align_pairs(spark, sf_dir):
    return tables.align_pairs(_pairs(spark, sf_dir))


QUERIES |= file_queries.QUERIES
ORACLES |= file_queries.ORACLES
