"""Deterministic sequencing reads derived from a relational table, in Spark and as a SQL common table expression.

Eight templates of 64 bases in four samples; an eighth of the reads is drawn
for a substitution; qualities come from hashes. Both forms give equal rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
BASES = "ACGTACGTACGTACGT"
QUALITIES = "IIIIIIIIIIIIHHG5"
TEMPLATES = 8

READS_SQL = f"""
base as (
  select cast(l_partkey % 8 as varchar) t, cast(l_suppkey % 4 as varchar) sm, l_orderkey k,
         md5(concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar), '-', cast(l_partkey as varchar), '-', cast(l_suppkey as varchar))) h
  from lineitem),
drawn as (
  select concat('s', sm) sample_id, t, h, cast(1 + k % 64 as int) p,
         translate(concat(md5(concat('t', t)), md5(concat('u', t))), '{HEX}', '{BASES}') tpl
  from base),
reads as (
  select sample_id, h read_id, t template,
         case when substr(h, 1, 1) in ('0', '1')
              then concat(substr(tpl, 1, p - 1), translate(substr(h, 2, 1), '{HEX}', '{BASES}'), substr(tpl, p + 1)) else tpl end seq,
         translate(concat(h, md5(h)), '{HEX}', '{QUALITIES}') qual
  from drawn),
uniq as (select sample_id, seq, cast(count(*) as bigint) n from reads group by sample_id, seq),
ranked as (select *, cast(row_number() over (partition by sample_id order by n desc, seq) - 1 as int) idx from uniq)
"""


def _template(t: Column) -> Column:
    return F.translate(F.concat(F.md5(F.concat(F.lit("t"), t)), F.md5(F.concat(F.lit("u"), t))), HEX, BASES)


def _sequence(t: int) -> str:
    """:func:`_template` of one number."""
    return "".join(hashlib.md5(f"{c}{t}".encode()).hexdigest() for c in "tu").translate(str.maketrans(HEX, BASES))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, read_id, template, seq, qual``; four columns of the table are read."""
    text = lambda c: F.col(c).cast("string")
    t = (F.col("l_partkey") % TEMPLATES).cast("string")
    known = F.array(*[F.lit(_sequence(i)) for i in range(TEMPLATES)])
    base = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("sample_id"),
        t.alias("template"),
        F.md5(F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"))).alias("read_id"),
        (1 + F.col("l_orderkey") % 64).cast("int").alias("p"),
        # the templates' sequences are constants of the plan; the formula is for numbers beyond them
        F.when(F.col("l_partkey") % TEMPLATES >= 0, F.get(known, (F.col("l_partkey") % TEMPLATES).cast("int"))).otherwise(_template(t)).alias("tpl"),
    )
    swapped = F.concat(F.substring("tpl", F.lit(1), F.col("p") - 1), F.translate(F.substring("read_id", 2, 1), HEX, BASES), F.substring("tpl", F.col("p") + 1, F.lit(64)))
    seq = F.when(F.substring("read_id", 1, 1).isin("0", "1"), swapped).otherwise(F.col("tpl"))
    return base.select("sample_id", "read_id", "template", seq.alias("seq"), F.translate(F.concat("read_id", F.md5("read_id")), HEX, QUALITIES).alias("qual"))


def templates(spark: SparkSession) -> DataFrame:
    """``t, header, seq``: the templates as a taxonomy reference set."""
    t = F.col("id").cast("string")
    seq = _template(t)
    header = F.concat(F.lit("K;P"), (F.col("id") % 2).cast("string"), F.lit(";C"), (F.col("id") % 4).cast("string"), F.lit(";G"), t)
    return spark.range(TEMPLATES).select(t.alias("t"), header.alias("header"), seq.alias("seq"))


TEMPLATES_SQL = f"""
tpls as (select cast(i as varchar) t, translate(concat(md5(concat('t', cast(i as varchar))), md5(concat('u', cast(i as varchar)))), '{HEX}', '{BASES}') seq
         from range(8) r(i))
"""
