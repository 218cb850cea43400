"""Pieces that several corpus operators share: tables, words, durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row.

    A column reference inside a higher-order function can be inlined by the
    optimiser and then evaluated for every element; a lambda variable cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a scan appends one by one; longer arrays are put together from such pieces.
SCAN_PIECE = 256


def scanned(items: Column, start: Column, kind: str, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    """``out(carry, item)`` of every item in order, where ``step(carry, item)`` is what an item leaves to the next.

    Appending to an array copies it, so pieces of ``SCAN_PIECE`` items are built one by one and then put together:
    the cost grows with the power 1.5 of the number of items, with a small factor, not with its square.
    ``kind`` is the type of what ``out`` gives.
    """
    none = F.array().cast(f"array<{kind}>")

    def piece(carry: Column, part: Column) -> Column:
        first = F.struct(carry.alias("carry"), none.alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(step(acc["carry"], x).alias("carry"), F.concat(acc["out"], F.array(out(acc["carry"], x)).cast(f"array<{kind}>")).alias("out")))

    def whole(x: Column) -> Column:
        first = F.struct(start.alias("carry"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        pieces = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SCAN_PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))
        join = lambda acc, i: bind(
            piece(acc["carry"], F.slice(x, i * SCAN_PIECE + 1, F.lit(SCAN_PIECE))),
            lambda r: F.struct(r["carry"].alias("carry"), F.concat(acc["out"], F.array(r["out"])).alias("out")),
        )
        return F.flatten(F.aggregate(pieces, first, join, lambda acc: acc["out"]))

    return bind(items, whole)


def words(text: Column) -> Column:
    """Words of a text, ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (local runs)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder: it survives lost executors, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables as :func:`stored` gave them; nothing that is still to be computed may read them."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files as they end; else these stay until the driver collects its garbage.

    A query whose plan runs a second time shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out
