"""Reads that arrive as files in a folder, dereplicated as they come (beyond the batch engine's own scope)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

READS = "sample_id string, read_id string, seq string, qual string, arrived timestamp"


def read_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def running_counts(reads: DataFrame) -> DataFrame:
    """``sample_id, seq, count`` of all reads so far; state is a count per distinct sequence."""
    return reads.groupBy("sample_id", "seq").agg(F.count("*").alias("count"))


def windowed_reads(reads: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Reads and bases by sample and window of arrival; windows close once the watermark has passed."""
    grouped = reads.withWatermark("arrived", late).groupBy("sample_id", F.window("arrived", window))
    return grouped.agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


def _versions(spark: SparkSession, path: str):
    """File system of a table and its versions by number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(folder) if fs.exists(folder) else ():
        name = status.getPath().getName()
        if name.startswith("version_") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(name.removeprefix("version_"))] = status.getPath()
    return fs, found


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest counts as Parquet, replaced as a whole after each batch; :func:`latest` reads them.

    A version is complete before the one before the last goes, so a reader that has begun isn't cut off.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version_{number}")
        fs, found = _versions(batch.sparkSession, path)
        for old in sorted(found)[:-2]:
            fs.delete(found[old], True)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a table that :func:`to_table` writes."""
    _, found = _versions(spark, path)
    return spark.read.parquet(found[max(found)].toString())
