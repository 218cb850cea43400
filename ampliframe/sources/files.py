"""FASTQ, FASTA, tagged JSON, TSV: readers and writers over Spark's own file sources (SC1 to SC14, SK1 to SK15).

Everything goes through Spark's text and JSON sources, so paths may be on any
file system that Spark reads, plain or compressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ampliframe.operators.derep import rank_uniques

SUFFIXES = r"\.(fastq|fq|fasta|fa|json|txt)(\.(gz|bz2|zst))?$"
TAG, VERSION = "ampliframe_stage", 1


def sample_name(path):
    """Last part of a path without its known suffixes."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), SUFFIXES, "")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``sample_id, read_no, name, descr, seq, qual``; the sample is the file's name (SC1).

    A gzip file is one split and its records are put together as they are read. Lines of
    other files are numbered in two levels, splits of a file and then lines of
    a split, so a large plain file is read by many tasks.
    """
    found = spark.read.text(path).inputFiles()
    whole = [f for f in found if f.endswith(".gz")]
    # another list of the same files only where both ways are needed
    rest = path if not whole else [unquote(f) for f in found if not f.endswith(".gz")]
    parts = [_whole_files(spark, path if len(whole) == len(found) else [unquote(f) for f in whole])] if whole else []
    parts += [_split_files(spark, rest)] if rest else []
    records = reduce(DataFrame.unionByName, parts).where(F.coalesce("head", F.lit("")) != "")
    ok = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record in "), "file", F.lit(": "), F.col("head"))))
    return records.select(
        sample_name(F.col("file")).alias("sample_id"),
        "read_no",
        F.regexp_extract("head", r"^@(\S*)", 1).alias("name"),
        F.regexp_extract("head", r"^@\S*\s+(.*)$", 1).alias("descr"),
        checked.alias("seq"),
        "qual",
    )


RECORDS = "file string, read_no long, head string, seq string, plus string, qual string"


def _four_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the lines of whole files, one file after the other; lines that are left over wait for the next batch."""
    schema = pa.schema([("file", pa.string()), ("read_no", pa.int64()), *((c, pa.string()) for c in ("head", "seq", "plus", "qual"))])
    file, number, held = None, 0, pa.array([], pa.string())

    def records(lines: pa.Array, n: int) -> pa.RecordBatch:
        at = np.arange(n) * 4
        fields = [lines.take(pa.array(np.where(at + k < len(lines), at + k, 0), mask=at + k >= len(lines))) for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([file], pa.string()).take(pa.array(np.zeros(n, np.int64))), pa.array(number + np.arange(n)), *fields], schema=schema)

    for batch in batches:
        of = batch.column(1).dictionary_encode()
        codes = of.indices.to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1]) if len(codes) else []
        for lo, hi in zip(starts, [*starts[1:], len(codes)], strict=True):
            name = of.dictionary[int(codes[lo])].as_py()
            if name != file:
                if len(held):
                    yield records(held, 1)
                file, number, held = name, 0, held.slice(0, 0)
            lines = pa.concat_arrays([held, batch.column(0).slice(lo, hi - lo).cast(pa.string())])
            n = len(lines) // 4
            if n:
                yield records(lines, n)
            number, held = number + n, lines.slice(4 * n)
    if len(held):
        yield records(held, 1)


def _whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("value"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(_four_lines, RECORDS)


def _split_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    own = Window.partitionBy("file", "block").orderBy("id")
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = lines.withColumn("line", F.row_number().over(own) - 1).join(offsets, ["file", "block"]).withColumn("line", F.col("line") + F.col("offset"))
    field = lambda k: F.max(F.when(F.col("line") % 4 == k, F.rtrim(F.col("value"), F.lit("\r"))))
    return numbered.groupBy("file", F.floor(F.col("line") / 4).alias("read_no")).agg(field(0).alias("head"), field(1).alias("seq"), field(2).alias("plus"), field(3).alias("qual"))


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip") -> bool:
    """Four lines a read; nothing is written, and False returned, if there are no reads (SK1)."""
    if reads.limit(1).count() == 0:
        return False
    head = F.concat(F.lit("@"), "name", F.when(F.coalesce("descr", F.lit("")) != "", F.concat(F.lit(" "), "descr")).otherwise(F.lit("")))
    reads.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value")).write.option("compression", compression).text(path)
    return True


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``header, seq``: lines of a sequence joined, headers trimmed (SC3)."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    value = F.regexp_replace(F.regexp_replace("value", r"^\s*>?", ""), "\r", "")
    cut = F.instr(value, "\n")
    seq = F.regexp_replace(F.when(cut > 0, F.expr("substring(v, instr(v, '\n'))")).otherwise(F.lit("")), r"\s+", "")
    return rows.withColumn("v", value).select(F.trim(F.substring_index("v", "\n", 1)).alias("header"), seq.alias("seq")).where("header <> '' or seq <> ''")


def write_fasta(sequences: DataFrame, path: str, name: str = "sequence_id") -> None:
    """A record per row (SK6, SK11)."""
    sequences.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), "seq").alias("value")).write.text(path)


def first_sequence(spark: SparkSession, path: str) -> str:
    """Sequence of the first record, as for a contaminant's genome (SC4)."""
    return read_fasta(spark, path).select("seq").first()["seq"]


def write_stage(df: DataFrame, path: str, stage: str, compression: str = "gzip") -> None:
    """JSON lines that say which step made them (SK2 to SK4, SK9, SK10, SK12)."""
    tagged = df.select(F.lit(stage).alias(TAG), F.lit(VERSION).alias("version"), *df.columns)
    tagged.write.option("compression", compression).json(path)


def read_stage(spark: SparkSession, path: str, schema: StructType | str, stages: list[str]) -> DataFrame:
    """Rows of a step's output; rows that another step made are an error (SC5 to SC8, SC10)."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType.fromDDL(f"{TAG} string, version int")
    for f in wanted:
        full = full.add(f)
    rows = spark.read.schema(full).json(path)
    stage = F.coalesce(F.col(TAG), F.lit("none"))
    checked = F.when(stage.isin(stages), F.col(wanted[0].name)).otherwise(F.raise_error(F.concat(F.lit("made by step "), stage)))
    return rows.select(checked.alias(wanted[0].name), *wanted.names[1:])


def write_tsv(df: DataFrame, path: str, missing: str = "NA") -> None:
    """Tab-separated with a header (SK5, SK7, SK8, SK13 to SK15)."""
    df.coalesce(1).write.option("sep", "\t").option("header", True).option("nullValue", missing).option("emptyValue", "").csv(path)


def taxonomy_table(taxonomy: DataFrame, levels: list[str], missing: str = "NA") -> DataFrame:
    """A column per level (SK7)."""
    return taxonomy.select("seq", *[F.coalesce(F.get("taxonomy", F.lit(i)), F.lit(missing)).alias(level) for i, level in enumerate(levels)])


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """An error model as a table ``ref_nt, query_nt, q, rate`` (SC15)."""
    return spark.read.schema("ref_nt string, query_nt string, q int, rate double").option("header", True).csv(path)


def checked_paths(paths: str | list[str]) -> list[str]:
    """Paths as a list; an empty one or none at all is an error that says so (SC14)."""
    found = [paths] if isinstance(paths, str) else list(paths)
    if not found or not all(p.strip() for p in found):
        raise ValueError("no input paths; did a pattern match nothing?")
    return found


def is_fasta(path: str) -> bool:
    return re.search(r"\.(fasta|fa|fna)(\.(gz|bz2|zst))?$", path.lower()) is not None


UNIQUES = "sample_id string, uniq_idx int, seq string, count long, qual_sum array<long>"


def read_uniques(spark: SparkSession, path: str) -> DataFrame:
    """Uniques of a stage file, ranked anew: most reads first, then sequence (SC6)."""
    return rank_uniques(read_stage(spark, path, UNIQUES, ["derep"]).drop("uniq_idx"))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads by what the suffix says: a FASTA file's sequences (best quality) or FASTQ (SC7)."""
    if not is_fasta(path):
        return read_fastq(spark, path)
    rows = read_fasta(spark, path).withColumn("sample_id", F.lit(None).cast("string"))
    return rows.select("sample_id", F.monotonically_increasing_id().alias("read_no"), F.col("header").alias("name"), F.lit("").alias("descr"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))


#: Steps whose output counts sequences by sample, and the columns that name sequence and count.
COUNTED = {"derep": ("seq", "count"), "denoise": ("seq", "abundance"), "merge": ("seq", "count"), "table": ("seq", "count")}


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, seq, count`` of any step's file, by the step that its rows name (SC8)."""
    columns = sorted({c for pair in COUNTED.values() for c in pair} - {"seq"})
    fields = ", ".join(f"{c} long" for c in columns)
    rows = spark.read.schema(f"{TAG} string, sample_id string, seq string, {fields}").json(path)
    count = F.coalesce(*[F.when(F.col(TAG) == step, F.col(c)) for step, (_, c) in COUNTED.items()])
    known = F.coalesce(F.col(TAG), F.lit("none")).isin(list(COUNTED))
    seq = F.when(known, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("no counts in the output of step "), F.coalesce(F.col(TAG), F.lit("none")))))
    return rows.select("sample_id", seq.alias("seq"), count.alias("count")).where("count is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``seq``: distinct sequences of a FASTA file or of any step's counts (SC9)."""
    rows = read_fasta(spark, path) if is_fasta(path) else read_counts(spark, path)
    return rows.select(F.upper("seq").alias("seq")).distinct()


def checked_rates(rates: DataFrame) -> DataFrame:
    """An error model with all 16 transitions for every quality and no rate beyond 0 to 1, or an error (SC10)."""
    bad = rates.groupBy("q").agg(F.count_distinct("ref_nt", "query_nt").alias("n"), F.count_if(~F.col("rate").between(0, 1) | F.col("rate").isNull()).alias("out"))
    first = bad.where("n <> 16 or out > 0").orderBy("q").first()
    if first is not None:
        raise ValueError(f"not an error model: quality {first['q']} has {first['n']} of 16 transitions, {first['out']} of them out of range")
    return rates


def write_by_sample(df: DataFrame, path: str, stage: str, compression: str = "gzip") -> None:
    """As :func:`write_stage`, a folder for each sample (SK4)."""
    tagged = df.select(F.lit(stage).alias(TAG), F.lit(VERSION).alias("version"), *df.columns).withColumn("sample", F.col("sample_id"))
    tagged.write.option("compression", compression).partitionBy("sample").json(path)
