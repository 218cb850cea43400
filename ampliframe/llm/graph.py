"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliframe.llm.common import durable


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).collect()[0]
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node that a row ``a, b`` of ``links`` joins to another; ``root`` is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014), whose
    rounds grow with the logarithm of the largest component. Every round is
    checkpointed; minima are pre-aggregated and joined back, so that a node
    with many links is no single task's work. Links of a node with itself and
    repeated links are allowed.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = durable(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(lower.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
