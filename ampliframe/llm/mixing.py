"""Mixing sources to target weights along a time-varying curriculum (native).

Each source has a weight and a linear schedule of that weight over training
time 0..1. Targets are the shares of a word budget, limited to a number of
passes over the source (water filling). A document's words occupy an interval
of its source's cumulative demand; the integral of the schedule is inverted to
give the interval's place in training time, and documents are range-sorted by
it.

Cumulative sums of a source are taken in two levels, buckets of a hash of the
document and then rows of a bucket, so that a source with a third of all rows
is spread over many tasks.

Defined cases: null or empty texts have size 0 and are never taken; a null
source is a source of its own, after all others; rows with equal ids, also null
ones, are separate documents (their order is by size, and equal rows are
interchangeable); an empty table gives an empty result; further columns of the
input are ignored by :func:`mix_plan`, kept by :func:`mix_documents`; a text of
any length counts whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliframe.llm.common import durable, words

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_PASSES = 2
#: Weight at the end of training over the weight at its start, by the source's place in the weight cycle.
DRIFT = (0.5, 1.0, 2.0)
BUCKET_DIGITS = 3  # hexadecimal digits of the order key: 4096 buckets a source


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = BUDGET_SHARE, passes: int = MAX_PASSES
) -> DataFrame:
    """One row per source: ``source, source_size, weight, place, target``.

    ``sizes`` has ``source, size``. Water filling in closed form: a source is
    at its limit if limit / weight is at most the level that the rest reaches.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int"))
    s = by_source.withColumn("place", place).withColumn("weight", weight).withColumn("limit", F.lit(float(passes)) * F.col("source_size"))
    filling = Window.orderBy((F.col("limit") / F.col("weight")), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget_left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("budget_left") / F.col("weight_left"))
        .withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
    )
    # sources fill up in this order, so those at their limit are a prefix; the first one that isn't sets the level
    first_open = F.min(F.when(~F.col("full"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "place", "level"))).over(everything)
    target = F.when(first_open.isNull() | F.col("full"), F.col("limit")).otherwise(F.col("weight") * first_open["level"])
    return s.withColumn("target", target).select("source", "source_size", "weight", "place", "target")


def _position(demand: Column, target: Column, drift: Column) -> Column:
    """Training time at which a source's cumulative demand reaches ``demand``.

    The weight goes linearly from 1 to ``drift``; its integral up to t, over
    the integral up to 1, is (t + (drift - 1) t² / 2) / ((1 + drift) / 2).
    """
    part = demand / target * (1 + drift) / 2
    slope = drift - 1
    return F.when(slope == 0, part).otherwise((F.sqrt(1 + 2 * slope * part) - 1) / slope)


def mix_plan(docs: DataFrame, drift: Sequence[float] = DRIFT, weights: Sequence[float] = WEIGHTS, share: float = BUDGET_SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, first_position, second_position`` for every row of ``docs``.

    Whole passes over a source come first; what is left of its target is taken
    from its documents in hash order, the last of them in part.
    """
    rows = durable(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    return plan_of_sizes(rows, drift, weights, share, passes)


def plan_of_sizes(rows: DataFrame, drift: Sequence[float] = DRIFT, weights: Sequence[float] = WEIGHTS, share: float = BUDGET_SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """As :func:`mix_plan`, of rows ``doc_id, source, size`` and any further columns, which are kept."""
    rows = (
        rows.withColumn("_key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))))
        .withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
        .withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    )
    sums = durable(rows.groupBy("source", "_source", "_bucket").agg(F.sum("size").alias("_sum")))
    sources = source_targets(sums.select("source", F.col("_sum").alias("size")), weights, share, passes)
    per_source = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(per_source), F.lit(0))).select("_source", "_bucket", "_offset")
    n = len(drift)
    drifts = F.element_at(F.array(*[F.lit(float(d)) for d in drift]), (F.col("place") % n + 1).cast("int"))
    sources = sources.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"), "source_size", "target", drifts.alias("_drift"))
    in_bucket = Window.partitionBy("_source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    joined = rows.join(offsets.join(sources, "_source"), ["_source", "_bucket"], "left")
    before = F.col("_offset") + F.col("_before")
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    joined = joined.withColumn("_whole", whole.cast("long"))
    left = F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - before))
    taken = F.col("_whole") * F.col("size") + part
    at = lambda k: _position(before + F.lit(k) * F.col("source_size"), F.col("target"), F.col("_drift"))
    joined = joined.withColumn("_part", part).withColumn("taken", taken)
    passes_taken = F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0)
    return (
        joined.withColumn("first_position", F.when(F.col("taken") > 0, at(0)))
        .withColumn("second_position", F.when((F.col("size") > 0) & (passes_taken > 1), at(1)))
        .drop("_key", "_bucket", "_source", "_before", "_offset", "_drift", "_whole", "_part")
    )


def by_position(plan: DataFrame) -> DataFrame:
    """Range-sorted by training position; rows that are never taken come last."""
    return plan.orderBy(F.col("first_position").asc_nulls_last(), F.col("doc_id"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in training order: a row for each pass over a row of ``docs``, range-sorted by position.

    All columns of ``docs`` are kept; ``mix_position`` is the pass' place in training, ``mix_pass`` its number and
    ``mix_words`` how many of the text's first words it takes. A column of ``docs`` with one of these names is replaced.
    """
    mine = ("mix_position", "mix_pass", "mix_words")
    own = [c for c in docs.columns if c.lower() not in mine]
    # the plan's own names are free of those of docs: these travel as one struct
    held = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    plan = plan_of_sizes(held, **options).where(F.col("taken") > 0)
    first = F.least("size", "taken")
    passes = F.array(
        F.struct(F.col("first_position").alias("at"), F.lit(1).alias("pass"), first.alias("words")),
        F.struct(F.col("second_position").alias("at"), F.lit(2).alias("pass"), (F.col("taken") - first).alias("words")),
    )
    rows = plan.select("row", F.explode(F.filter(passes, lambda p: p["words"] > 0)).alias("p"))
    out = rows.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("p.at").alias(mine[0]), F.col("p.pass").alias(mine[1]), F.col("p.words").alias(mine[2]))
    return out.orderBy(mine[0], "doc_id", mine[1])
