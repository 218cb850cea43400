"""Dereplication: exact sequences with counts, quality sums and ranks (K1 to K4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(reads: DataFrame) -> DataFrame:
    """``sample_id, seq, count``; one shuffle, counted map-side first."""
    return reads.groupBy("sample_id", "seq").agg(F.count("*").alias("count"))


def rank_uniques(uniques: DataFrame) -> DataFrame:
    """``uniq_idx`` within each sample: most reads first, then sequence."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("count"), "seq")
    return uniques.withColumn("uniq_idx", (F.row_number().over(order) - 1).cast("int"))


_UNIQUE = "sample_id string, seq string, count long, qual_sum array<long>"


def _added(sample: pa.Array, seq: pa.Array, count: np.ndarray, values: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct ``sample, seq``, counts and qualities added up. ``values`` has the rows' qualities one after the other."""
    key = pa.compute.binary_join_element_wise(sample, seq, "\x1f").dictionary_encode().indices.to_numpy()
    order = np.lexsort((key, length))
    first = np.cumsum(length) - length
    rows, sums, counts, lengths = [], [], [], []
    for size in np.unique(length).tolist():
        mine = order[length[order] == size]
        cut = np.flatnonzero(np.concatenate([[True], key[mine][1:] != key[mine][:-1]]))
        table = values[first[mine][:, None] + np.arange(size)]
        rows.append(mine[cut])
        sums.append(np.add.reduceat(table, cut, axis=0).ravel() if size else np.zeros(0, np.int64))
        counts.append(np.add.reduceat(count[mine], cut))
        lengths.append(np.full(len(cut), size))
    at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sums])))
    return pa.RecordBatch.from_arrays([sample.take(at), seq.take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), lists], ["sample_id", "seq", "count", "qual_sum"])


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each sample and sequence of several batches of partial rows."""
    table = pa.Table.from_batches(parts).combine_chunks()
    lists = table.column("qual_sum").chunk(0)
    return _added(table.column("sample_id").chunk(0), table.column("seq").chunk(0), table.column("count").to_numpy(), lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy().astype(np.int64))


def _bytes(strings: pa.Array) -> np.ndarray:
    """The bytes of all strings, one after the other; none of them is null."""
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    ends = np.frombuffer(strings.buffers()[1], kind)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)


#: Partial rows that a task holds before it adds them up or passes them on.
HELD_ROWS = 32_768


def _from_reads(offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                qual = batch.column(2).fill_null("")
                length = pa.compute.binary_length(qual).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append(_added(batch.column(0), batch.column(1), np.ones(batch.num_rows, np.int64), _bytes(qual).astype(np.int64) - offset, length))
                if sum(x.num_rows for x in held) >= HELD_ROWS:
                    held = [_whole(held)]
                    if held[0].num_rows >= HELD_ROWS // 2:
                        yield held.pop()
        if held:
            yield _whole(held)

    return run


def _from_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of partial rows sorted by ``sample_id, seq``: the whole ones; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []

    for batch in batches:
        if not batch.num_rows:
            continue
        last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
        same = pa.compute.and_(pa.compute.equal(batch.column(0), last[0]), pa.compute.equal(batch.column(1), last[1]))
        cut = batch.num_rows - int(pa.compute.sum(same).as_py())
        if cut:
            yield _whole([*held, batch.slice(0, cut)])
            held = []
        elif held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != last:
            yield _whole(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _whole(held)


def merged_uniques(parts: DataFrame) -> DataFrame:
    """Rows ``sample_id, seq, count, qual_sum`` with equal sample and sequence added up (K3): one row a unique and task is shuffled."""
    own = parts.select("sample_id", "seq", F.col("count").cast("long").alias("count"), F.col("qual_sum").cast("array<long>").alias("qual_sum"))
    return own.repartition("sample_id", "seq").sortWithinPartitions("sample_id", "seq").mapInArrow(_from_parts, _UNIQUE)


def dereplicated(reads: DataFrame, offset: int = 33) -> DataFrame:
    """``sample_id, seq, count, qual_sum``: each task adds up its own reads before the shuffle."""
    rows = reads.select("sample_id", "seq", "qual")
    return merged_uniques(rows.mapInArrow(_from_reads(offset), _UNIQUE))


def quality_sums(reads: DataFrame, offset: int = 33) -> DataFrame:
    """``sample_id, seq, pos, qsum``: quality sums of every unique at every position."""
    return dereplicated(reads, offset).select("sample_id", "seq", F.posexplode("qual_sum").alias("pos", "qsum"))


def dereplicate(reads: DataFrame, offset: int = 33) -> DataFrame:
    """``sample_id, uniq_idx, seq, count, qual_sum`` (D3)."""
    return rank_uniques(dereplicated(reads, offset))


def read_map(reads: DataFrame, uniques: DataFrame) -> DataFrame:
    """``sample_id, read_no, uniq_idx``: the unique of every read."""
    return reads.select("sample_id", "read_no", "seq").join(uniques.select("sample_id", "seq", "uniq_idx"), ["sample_id", "seq"]).drop("seq")


def bases_cutoff(samples: DataFrame, bases: float) -> DataFrame:
    """Samples in order until ``bases`` are reached; the one that reaches it counts (K4, W3, T35). ``samples``: ``sample_id, ord, bases``."""
    before = Window.orderBy("ord", "sample_id").rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("before", F.coalesce(F.sum("bases").over(before), F.lit(0))).where(F.col("before") < bases).drop("before")


def shuffled_samples(samples: DataFrame, seed: int) -> DataFrame:
    """``samples`` with ``ord``, a place by a hash of seed and name: a shuffle that is the same on every run."""
    return samples.withColumn("ord", F.xxhash64(F.lit(seed), "sample_id"))


def within_bases(uniques: DataFrame, bases: float, seed: int | None = None) -> DataFrame:
    """Uniques of the samples that :func:`bases_cutoff` takes, in the order of names or, with a seed, shuffled."""
    sizes = uniques.groupBy("sample_id").agg(F.sum(F.col("count") * F.length("seq")).alias("bases"))
    sizes = sizes.withColumn("ord", F.col("sample_id")) if seed is None else shuffled_samples(sizes, seed)
    return uniques.join(bases_cutoff(sizes, bases).select("sample_id"), "sample_id", "left_semi")


def hash_subsample(reads: DataFrame, name: str, keep: int) -> DataFrame:
    """Reads whose name hashes under ``keep`` of 256; nested for growing ``keep``, mates stay together."""
    return reads.where(F.conv(F.substring(F.md5(F.col(name)), 1, 2), 16, 10).cast("int") < keep)
