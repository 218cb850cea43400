"""Corpus queries by name, and DuckDB SQL for those that SQL can express.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ampliframe.llm import decontaminate, html_extract, lm_score, mixing, quality, secret_scan, simhash, substring_dedup, url_filter, warc
from ampliframe.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


_MIX_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
s as (
  select source, cast(sum(size) as bigint) source_size, row_number() over (order by source asc nulls last) - 1 place from d group by source),
w as (
  select *, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end weight, 2.0::double * source_size lim,
         case place % 3 when 0 then 0.5::double when 1 then 1.0::double else 2.0::double end drift from s),
f as (
  select *, 1.5::double * sum(source_size) over () - coalesce(sum(lim) over before, 0) budget_left,
         sum(weight) over () - coalesce(sum(weight) over before, 0) weight_left
  from w window before as (order by lim / weight, place rows between unbounded preceding and 1 preceding)),
l as (select *, budget_left / weight_left lvl, lim <= weight * (budget_left / weight_left) is_full from f),
t as (
  select source, source_size, place, drift,
         case when is_full then lim else weight * (select arg_min(lvl, struct_pack(a := lim / weight, b := place)) from l where not is_full) end target
  from l),
c as (
  select d.*, t.source_size, t.target, t.place, t.drift,
         coalesce(sum(size) over (partition by d.source order by md5(concat(coalesce(cast(doc_id as varchar), ''), ':', cast(size as varchar))), doc_id nulls first, size
                                  rows between unbounded preceding and 1 preceding), 0) before
  from d join t on d.source is not distinct from t.source),
m as (
  select *, greatest(0, least(size, cast(floor(target - whole * source_size) as bigint) - before)) part
  from (select *, case when source_size = 0 then 0 else cast(floor(target / source_size) as bigint) end whole from c)),
n as (
  select *, cast(whole * size + part as bigint) taken, before / target * (1 + drift) / 2 d1, (before + source_size) / target * (1 + drift) / 2 d2,
         size > 0 and whole + case when part > 0 then 1 else 0 end > 1 again
  from m)
select doc_id, source, size, source_size, target, taken,
       case when taken > 0 then case when drift = 1 then d1 else (sqrt(1 + 2 * (drift - 1) * d1) - 1) / (drift - 1) end end first_position,
       case when again then case when drift = 1 then d2 else (sqrt(1 + 2 * (drift - 1) * d2) - 1) / (drift - 1) end end second_position
from n
"""

_QUALITY_SQL = r"""
with w as (
  select row_number() over () rid, doc_id, coalesce(text, '') txt, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (
  select rid, p, array_to_string(ws[p + 1 : p + 5], ' ') gram from (select rid, ws, unnest(range(len(ws) - 4)) p from w)),
r as (
  select rid, count(distinct p + k) n_repeat_words
  from (select rid, p, count(*) over (partition by rid, gram) n from g) g, unnest([0, 1, 2, 3, 4]) as u(k)
  where n >= 2 group by rid),
m as (
  select doc_id, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars,
         cast(len(regexp_extract_all(txt, '[#*$%&|<>]')) as bigint) n_symbols,
         cast(len(list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) n_repeat_words, len(string_split(txt, chr(10))) n_lines,
         list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) n_letter_words,
         len(regexp_extract_all(txt, '[^\x20\x09-\x0D]')) n_signs, len(regexp_extract_all(txt, '[0-9]')) n_digits, len(regexp_extract_all(txt, '[A-Z]')) n_upper
  from w left join r using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 10 * n_words
            or word_chars < 2 * n_words or word_chars > 25 * n_words or 100 * n_dup_lines > 60 * n_lines
            or 100 * n_letter_words < 50 * n_words or 100 * n_digits > 30 * n_signs or 100 * n_upper > 60 * n_signs
            or (len(ls) >= 3 and (100 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > 40 * len(ls)
                                  or 100 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) > 90 * len(ls)))) kept
from m
"""


@query("op5_source_mixing", _MIX_SQL)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.by_position(mixing.mix_plan(read_table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", "first_position", "second_position")


@query("op7_quality_rules", _QUALITY_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"))


_WARC_SQL = r"""
with p as (
  select page_id, coalesce(html, '') body, sha1(coalesce(html, '')) digest, row_number() over () rn from pages),
v as (
  select *, min(struct_pack(a := page_id is null, b := page_id, c := rn)) over (partition by body) least, count(*) over (partition by body) n from p),
b as (
  select v.*, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j: cast(strpos('0123456789abcdef', substr(digest, cast(1 + 5 * i + j as int), 1)) - 1 as bigint)), lambda x, y: x * 16 + y)) quads
  from v)
select page_id, cast(strlen(body) as bigint) payload_bytes,
       array_to_string(list_transform(quads, lambda q: concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (q >> 15) % 32 as int), 1),
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (q >> 10) % 32 as int), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (q >> 5) % 32 as int), 1),
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + q % 32 as int), 1))), '') payload_digest,
       case when least.c = rn then 'response' else 'revisit' end record_type,
       case when least.c = rn then null else least.b end refers_to
from b
"""


@query("op8_warc", _WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(read_table(spark, sf_dir, "documents"), good)


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
