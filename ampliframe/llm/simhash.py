"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of all fingerprints are grouped into partitions of correlated bits. A
pair within distance tau is within its threshold in at least one partition if
the thresholds add up to tau - m + 1 over m partitions (a threshold of -1 skips
one); dynamic programming gives out thresholds by estimated candidate counts,
which come from bucket sizes over all fingerprints. Each fingerprint is probed
under its partition values (threshold 0) or all their one-bit deletions (1).


A bucket is the value of a signature and of a third of the bits that it leaves
open, so a task that holds a bucket sees few strangers. Verification never
forms all pairs of a large bucket: two fingerprints at distance 2 or less both
lie within one bit of a common value, so members are sorted by the values
within one bit of them and those that share one are linked; a bucket gives one
link a member at most.

Defined cases: null and empty texts have fingerprint zero and are linked like
others; repeated rows share a fingerprint and a component; null ids belong to
components but never name one (a component of null ids alone is null); empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliframe.llm.common import durable
from ampliframe.llm.graph import components
from ampliframe.llm.tokens import mixed

SHINGLE = 3
MAX_DISTANCE = 2
BITS = 64
SEED = 42
#: Numbers of partitions to choose from.
PARTITIONS = (2, 3, 4)
_BLOCK = 1 << 15
_CENTRES = 1 << 19
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


# --- fingerprints ---------------------------------------------------------


def text_fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """64-bit SimHash of the k-word shingles (XXH64) of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= k:
        return int.from_bytes(digest(joined, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    total, ones = len(starts), np.zeros(BITS, np.int64)
    for lo in range(0, total, _BLOCK):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[lo : lo + _BLOCK], ends[lo : lo + _BLOCK], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` has the fingerprint's bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((text_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


# --- partitions and thresholds ---------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Bit positions (0: lowest) of each partition, and its threshold: -1, 0 or 1."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _bits(fp: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values, lowest first."""
    return np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together, over all fingerprints, and their number.

    Each task sums its own 64 by 64 table; Spark adds the tables up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for lo in range(0, len(x), _BLOCK):
                part = x[lo : lo + _BLOCK].astype(np.float32)
                table += part.T @ part
            n += len(x)
        if n:
            cells = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.append(table.astype(np.int64), n))], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def grouped_bits(together: np.ndarray, n: int, m: int) -> tuple[tuple[int, ...], ...]:
    """The bits in ``m`` partitions of nearly equal width; each grows by the bit most correlated with it."""
    p = together.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(len(p))), []
    for k in range(m):
        width = len(p) * (k + 1) // m - len(p) * k // m
        seed = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        part = [seed]
        left.remove(seed)
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(tuple(sorted(part)))
    return tuple(out)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Least sum of costs with thresholds that add up to ``total``; ``costs[i][t]`` is partition i's at threshold t."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for by_threshold in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (cost, chosen) in best.items():
            for t, more in by_threshold.items():
                new = (cost + more, (*chosen, t))
                if have + t not in step or new < step[have + t]:
                    step[have + t] = new
        best = step
    return best[total]


def _values(bits: np.ndarray, partition: tuple[int, ...]) -> np.ndarray:
    weights = np.uint64(1) << np.arange(len(partition), dtype=np.uint64)
    return (bits[:, list(partition)].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


def signatures(fp: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """Partition number and 64-bit signature of each fingerprint, one pair of arrays per probe.

    A signature packs the partition's number, the deleted bit (one more than its place; 0: none) and the value.
    """
    bits = _bits(fp)
    for i, (partition, t) in enumerate(zip(plan.partitions, plan.thresholds, strict=True)):
        if t < 0:
            continue
        value = _values(bits, partition)
        head = np.uint64(i) << np.uint64(56)
        if t == 0:
            yield i, value | head
        for j in range(len(partition)) if t == 1 else ():
            yield i, (value & ~(np.uint64(1) << np.uint64(j))) | head | (np.uint64(j + 1) << np.uint64(48))


def choose_plan(fps: DataFrame, max_distance: int = MAX_DISTANCE, sizes: tuple[int, ...] = PARTITIONS) -> Plan:
    """Partitions and thresholds with the least estimated work over all fingerprints.

    Pairs that share a partition's value are counted exactly from bucket sizes;
    those one bit apart are estimated from them and the bits' own frequencies.
    A probe costs as much as a candidate.
    """
    together, n = bit_counts(fps)
    p = together.diagonal() / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    tried = {m: grouped_bits(together, n, m) for m in sizes}
    every = Plan(tuple(x for m in sizes for x in tried[m]), (0,) * sum(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, sig in signatures(fp, every):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), i, np.int32)), pa.array(sig.view(np.int64))], ["part", "sig"])

    buckets = fps.select("fp").mapInArrow(run, "part int, sig long").groupBy("part", "sig").count()
    pairs = {r["part"]: float(r["pairs"]) for r in buckets.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best, k = None, 0
    for m in sizes:
        costs = []
        for partition in tried[m]:
            same = pairs.get(k, 0.0)
            k += 1
            near = 1 + sum((1 - agree[b]) / max(agree[b], 1e-9) for b in partition)
            costs.append({-1: 0.0, 0: same + n, 1: same * near + n * len(partition)})
        try:
            cost, thresholds = allocate(costs, max_distance - m + 1)
        except KeyError:
            continue
        if best is None or cost < best[0]:
            best = (cost, Plan(tried[m], thresholds))
    return best[1]


# --- links ------------------------------------------------------------------


def _bit_count(x: np.ndarray) -> np.ndarray:
    return _POPCOUNT[np.ascontiguousarray(x).view(np.uint16).reshape(len(x), 4)].sum(axis=1, dtype=np.int64)


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels of classes, each the smallest place of its class, after the places ``u`` and ``v`` have been linked."""
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter


def _star_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the first of those that it is connected to by steps of distance 2 or less, one a member at most.

    Two members within distance 2 both lie within one bit of a common value; all that lie within one bit of a value
    are within distance 2 of each other, so each is linked to the first of them. Values are taken in parts of
    ``_CENTRES`` or so, so that memory grows with the members alone.
    """
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)])
    label = np.arange(len(fp))
    parts = 1 + len(fp) * len(flips) // _CENTRES
    for part in range(parts):
        centre, member = [], []
        for flip in flips:
            c = fp ^ flip
            mine = np.flatnonzero(mixed(c) % np.uint64(parts) == part) if parts > 1 else np.arange(len(fp))
            centre.append(c[mine])
            member.append(mine)
        centre, member = np.concatenate(centre), np.concatenate(member)
        order = np.argsort(centre, kind="stable")
        centre, member = centre[order], member[order]
        same = np.flatnonzero(centre[1:] == centre[:-1])
        label = _joined(label, member[same], member[same + 1])
    other = np.flatnonzero(label != np.arange(len(fp)))
    return fp[other], fp[label[other]]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of fingerprints sorted by bucket: links within distance 2 in each bucket."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        bucket, fp = (table.column(c).to_numpy() for c in ("bucket", "fp"))
        fp = fp.view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(cut, append=len(bucket))
        two = cut[size == 2]
        near = _bit_count(fp[two] ^ fp[two + 1]) <= MAX_DISTANCE
        a, b = [fp[two][near]], [fp[two + 1][near]]
        for s, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = _star_links(fp[s : s + n])
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        bucket = table.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
        if cut:
            yield judge(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield judge(rest)


def near_links(fps: DataFrame, plan: Plan) -> DataFrame:
    """``a, b``: links that join every pair of distinct fingerprints ``fp`` within distance 2, directly or over other such links."""
    # the bits that a signature leaves open are partitioned once more: of three parts of them at least one is equal too
    rest = [tuple(b for b in range(BITS) if b not in partition) for partition in plan.partitions]
    thirds = [[r[k * len(r) // 3 : (k + 1) * len(r) // 3] for k in range(3)] for r in rest]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = _bits(fp.view(np.uint64))
            for i, sig in signatures(fp.view(np.uint64), plan):
                for k, third in enumerate(thirds[i]):
                    bucket = mixed(mixed(sig + np.uint64(k)) ^ (_values(bits, third) | np.uint64(k + 1) << np.uint64(60)))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(fp)], ["bucket", "fp"])

    probes = fps.select("fp").mapInArrow(probe, "bucket long, fp long")
    return probes.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_bucket_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row, components by links of distance 2 or less."""
    rows = durable(fingerprints(docs, k))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    plan = choose_plan(distinct)
    roots = durable(components(near_links(distinct, plan)))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = named.join(names, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
