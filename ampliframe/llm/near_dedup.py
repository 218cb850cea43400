"""One document of each group of near copies, by SimHash and the generalised pigeonhole principle.

Near copies have a Jaccard similarity of ``SIMILARITY`` or more between their
sets of ``SHINGLE``-word shingles, directly or over other near copies. Texts
with equal shingle sets are one text from the start.

First pass. Fingerprints are SimHashes of the distinct words, ``LANES`` times
64 bits: a copy with few edits keeps nearly all of its words but loses five
shingles an edit, so word fingerprints stay close where shingle fingerprints
don't. The bits are grouped and probed as in :mod:`simhash`, with thresholds
that add up to TAU - m + 1. A bucket gives a forest, not its pairs: its most
central member leads, members that may have the similarity to it are linked to
it, and so on with those left, for ``LEADERS`` rounds; the links are then
verified by their shingles. Tasks do so with their own rows before the shuffle,
so that a large group of copies travels as a few leaders.

Second pass, exact. What fingerprints or leaders have missed is found by the
prefixes of the sets: two sets of the similarity share one of their first m -
ceil(``SIMILARITY`` m) + 1 shingles in any common order (rare ones first).
Members of different groups that share one are compared in place, by size,
place and a parity sketch of their sets; these filters never reject a pair of
the similarity. What passes them is compared by its shingles. So every pair of
the similarity is linked directly or over others, whatever the first pass has
found. Buckets of more than ``BLOCK`` members are dealt out as pairs of
blocks. The second pass compares, but doesn't write, all pairs of members of
*different* groups in a bucket: a family of n texts just below the similarity
costs n * n sketch comparisons.

Defined cases: texts without words are copies of each other; of equal rows one
stays; among the rows of a group the one with the smallest id stays, null ids
last; empty tables give empty results; further columns pass through, whatever
their names; texts of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliframe.llm import simhash
from ampliframe.llm.common import discard, free_names, freed_shuffles, stored
from ampliframe.llm.graph import components
from ampliframe.llm.tokens import chunks, lowered, mixed, window_hashes, word_hashes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
LANES, PARTITIONS_A_LANE = 6, 2
TAU = LANES * PARTITIONS_A_LANE - 1
#: 64-bit words of a set's parity sketch: bit i is the parity of the number of its shingles that hash to i.
PARITY_WORDS = 8
#: Rounds in which a bucket's members are linked to one leader more; from so many members of a bucket on, a task links its own first.
LEADERS, LOCAL_GROUP = 8, 16
#: Members of a bucket that are compared at a time in the first and in the second pass.
PIECE, BLOCK = 1 << 14, 1 << 12
#: Part of the texts in which frequent shingles are looked for, and how many of them are told apart; both affect the work only.
FREQUENT_PART, FREQUENT = 32, 1 << 17
_HELD_PAIRS = 1 << 18
_ROWS = 1 << 12
_LANE_KEYS = mixed(np.arange(1, LANES + 1, dtype=np.uint64))


def _sets(h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Of word hashes and first words of consecutive texts: each text's distinct shingles, sorted."""
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = h[s:e]
        yield np.unique(window_hashes(own, min(SHINGLE, len(own)))) if len(own) else own


def _set_hash(shingles: np.ndarray) -> int:
    return int(mixed(mixed(shingles).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(shingles)))[0]) if len(shingles) else 0


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """A parity sketch of each set, ``PARITY_WORDS`` words a row."""
    bits = 64 * PARITY_WORDS
    out = np.zeros((len(sets), PARITY_WORDS), np.uint64)
    for lo in range(0, len(sets), _ROWS):
        part = sets[lo : lo + _ROWS]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        place = (np.concatenate(part) % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(row * bits + place, minlength=len(part) * bits) & 1).astype(np.uint8)
        out[lo : lo + _ROWS] = np.packbits(odd.reshape(-1, bits), axis=1, bitorder="little").view("<u8")
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``doc_id, key, text``: hash and size of the shingle set, its parity sketch and the fingerprint's lanes."""
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int32)
        sets = np.zeros(batch.num_rows, np.uint64)
        parity = np.zeros((batch.num_rows, PARITY_WORDS), np.uint64)
        lanes = np.zeros((batch.num_rows, LANES), np.uint64)
        for lo, hi, data, offsets in chunks(batch.column(2)):
            data = lowered(data)
            starts, ends, first = word_spans(data, offsets)
            h = word_hashes(data, starts, ends)
            text = np.repeat(np.arange(hi - lo), np.diff(first))
            own = list(_sets(h, first))
            n[lo:hi] = [len(x) for x in own]
            sets[lo:hi] = [_set_hash(x) for x in own]
            parity[lo:hi] = _parities(own)
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text = h[new], text[new]
            if not len(h):
                continue
            cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            size = np.diff(cut, append=len(h))
            for k in range(LANES):
                bits = np.unpackbits(mixed(h ^ _LANE_KEYS[k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
                lanes[lo + text[cut], k] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sets.view(np.int64)), pa.array(n), _binary(parity), *(pa.array(np.ascontiguousarray(lanes[:, k]).view(np.int64)) for k in range(LANES))],
            ["doc_id", "key", "set", "n", "parity", *_lane_names()],
        )


def _binary(parity: np.ndarray) -> pa.Array:
    width = 8 * PARITY_WORDS
    return pa.Array.from_buffers(pa.binary(), len(parity), [None, pa.py_buffer(np.arange(len(parity) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(parity))])


def _parity_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of :func:`_binary`."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(column):
        return np.zeros((0, PARITY_WORDS), np.uint64)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + 8 * PARITY_WORDS * len(column)].view("<u8").reshape(-1, PARITY_WORDS)


def _lane_names() -> list[str]:
    return [f"lane{k}" for k in range(LANES)]


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, key, set, n, parity, lane0...`` of every row; ``key`` is a hash of the text, ``set`` of its shingle set (0: no words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in _lane_names())
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_sketches, f"doc_id {kind}, key long, set long, n int, parity binary, {fields}")


def choose_plans(texts: DataFrame) -> list[simhash.Plan]:
    """For each lane its partitions and thresholds; bit groups from all fingerprints, thresholds by dynamic programming over all lanes."""
    groups, agree = [], []
    n = 0
    for name in _lane_names():
        together, n = simhash.bit_counts(texts.select(F.col(name).alias("fp")))
        groups.append(simhash.grouped_bits(together, n, PARTITIONS_A_LANE))
        p = together.diagonal() / max(n, 1)
        agree.append(p**2 + (1 - p) ** 2)
    flat = [simhash.Plan(g, (0,) * PARTITIONS_A_LANE) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sig in _signatures(batch, 0, flat):
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64))], ["sig"])

    buckets = texts.select(*_lane_names()).mapInArrow(run, "sig long").groupBy("sig").count()
    part = F.shiftrightunsigned("sig", 56)
    # a bucket compares its members with their leaders, not all its pairs
    compared = F.least(F.col("count") * (F.col("count") - 1) / 2, F.col("count") * LEADERS)
    same = {r["part"]: float(r["compared"]) for r in buckets.groupBy(part.alias("part")).agg(F.sum(compared).alias("compared")).collect()}
    costs = []
    for i in range(LANES * PARTITIONS_A_LANE):
        bits = groups[i // PARTITIONS_A_LANE][i % PARTITIONS_A_LANE]
        near = 1 + sum((1 - agree[i // PARTITIONS_A_LANE][b]) / max(agree[i // PARTITIONS_A_LANE][b], 1e-9) for b in bits)
        s = same.get(i, 0.0)
        costs.append({-1: 0.0, 0: s + n, 1: min(s * near, LEADERS * n * len(bits)) + n * len(bits)})
    _, thresholds = simhash.allocate(costs, TAU - len(costs) + 1)
    k = PARTITIONS_A_LANE
    return [simhash.Plan(g, thresholds[i * k : (i + 1) * k]) for i, g in enumerate(groups)]


def _signatures(batch: pa.RecordBatch, first: int, plans: list[simhash.Plan]) -> Iterator[np.ndarray]:
    """All signatures of every row, one array a probe; lanes begin at column ``first``; the highest byte is the partition's number."""
    for k, plan in enumerate(plans):
        fp = batch.column(first + k).to_numpy(zero_copy_only=False).view(np.uint64)
        for _, sig in simhash.signatures(fp, plan):
            yield sig + (np.uint64(k * PARTITIONS_A_LANE) << np.uint64(56))


def _may_be_near(n: np.ndarray, parity: np.ndarray, other_n: np.ndarray, other_parity: np.ndarray) -> np.ndarray:
    """Whether sets may have the similarity: by their sizes, and as sets differ in as many shingles as their parities in bits, or more."""
    fit = np.minimum(n, other_n) >= SIMILARITY * np.maximum(n, other_n) - 1e-9
    differ = np.bitwise_count(parity ^ other_parity).sum(axis=-1, dtype=np.int64)
    return fit & (differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * (n + other_n).astype(np.float64) + 1e-9)


def _forest(n: np.ndarray, parity: np.ndarray, rounds: int = LEADERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: places of members and of the leader each may be near, at most one leader a member; and places of leaders and of those left."""
    left = np.arange(len(n))
    members, leaders, heads = [], [], []
    for _ in range(rounds):
        if len(left) < 2:
            break
        bits = np.unpackbits(np.ascontiguousarray(parity[left]).view(np.uint8), axis=1, bitorder="little")
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left), bitorder="little").view("<u8")
        leader = left[np.bitwise_count(parity[left] ^ middle).sum(axis=1, dtype=np.int64).argmin()]
        near = _may_be_near(n[left], parity[left], n[leader], parity[leader])
        own = left[near & (left != leader)]
        members.append(own)
        leaders.append(np.full(len(own), leader))
        heads.append(leader)
        left = left[~near & (left != leader)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *leaders]), np.concatenate([np.array(heads, np.int64), left])


def _groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each run of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return cut, np.diff(cut, append=len(sig))


_MEMBER = "sig long, key long, leader long, n int, parity binary"


def _members(plans: list[simhash.Plan]):
    """Of ``key, n, parity, lane0...``: members by signature, and links (a leader, no sketch) inside groups that are large already in one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, parity = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _parity_of(batch.column(2))
            for sig in _signatures(batch, 3, plans):
                order = np.argsort(sig, kind="stable")
                s = sig[order]
                cut, size = _groups(s)
                travels, a, b = np.ones(len(s), bool), [], []
                for lo, g in zip(cut[size >= LOCAL_GROUP].tolist(), size[size >= LOCAL_GROUP].tolist(), strict=True):
                    own = order[lo : lo + g]
                    x, y, rest = _forest(n[own], parity[own])
                    a.append(own[x])
                    b.append(own[y])
                    travels[lo : lo + g] = False
                    travels[lo + rest] = True
                    # what no leader of a large group is near is dealt out further; the second pass sees it whole
                    apart = max(1, len(rest) // LOCAL_GROUP)
                    if apart > 1:
                        s[lo + rest] = mixed(s[lo + rest] ^ mixed(key[own[rest]].view(np.uint64)) % np.uint64(apart))
                at = order[travels]
                yield pa.RecordBatch.from_arrays([pa.array(s[travels].view(np.int64)), pa.array(key[at]), pa.nulls(len(at), pa.int64()), pa.array(n[at]), _binary(parity[at])], ["sig", "key", "leader", "n", "parity"])
                if a:
                    a, b = np.concatenate(a), np.concatenate(b)
                    spread = mixed(key[a].view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(key[a]), pa.array(key[b]), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], ["sig", "key", "leader", "n", "parity"])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["a", "b"])


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``sig``, cut between signatures; parts that belong to an unfinished one are put together once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch.column("sig").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(sig, sig[-1]))
        if held and held[-1].column("sig")[-1].as_py() != int(sig[0]) or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``sig``, cut between signatures; a signature of more than ``PIECE`` rows in overlapping pieces."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        sig = table.column("sig").to_numpy()
        cut = int(np.searchsorted(sig, sig[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        if rest.num_rows > PIECE:
            yield rest
            rest = rest.slice(rest.num_rows - 1)
    if rest is not None and rest.num_rows:
        yield rest


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members sorted by signature: links that may have the similarity, one a member and bucket at most, ``a`` < ``b``."""
    for table in _pieces(batches):
        done = table.filter(table.column("leader").is_valid())
        if done.num_rows:
            yield _pairs(done.column("key").to_numpy(), done.column("leader").to_numpy())
            table = table.filter(table.column("leader").is_null())
        sig, key, n = (table.column(c).to_numpy() for c in ("sig", "key", "n"))
        parity = _parity_of(table.column("parity"))
        cut, size = _groups(sig)
        two = cut[size == 2]
        two = two[_may_be_near(n[two], parity[two], n[two + 1], parity[two + 1])]
        a, b = [two], [two + 1]
        for lo, g in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y, _ = _forest(n[lo : lo + g], parity[lo : lo + g])
            a.append(lo + x)
            b.append(lo + y)
        a, b = key[np.concatenate(a)], key[np.concatenate(b)]
        yield _pairs(a[a != b], b[a != b])


def candidate_links(texts: DataFrame, plans: list[simhash.Plan]) -> DataFrame:
    """``a, b``: keys of texts that may be near each other, a forest of each bucket."""
    members = texts.select("key", "n", "parity", *_lane_names()).mapInArrow(_members(plans), _MEMBER)
    return members.repartition(F.col("sig")).sortWithinPartitions("sig").mapInArrow(_bucket_links, "a long, b long").distinct()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``key, ...``: the first row of each key in this task."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k not in seen:
                seen.add(k)
                new.append(i)
        yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            data = lowered(data)
            starts, ends, first = word_spans(data, offsets)
            sets = list(_sets(word_hashes(data, starts, ends), first))
            cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sets).view(np.int64)))], ["key", "shingles"])


def verified_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have the similarity, stored; the sets themselves, the largest table here, are deleted."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.mapInArrow(_once, keyed.schema)  # many copies of a text are a row a task
    sets = stored(keyed.join(wanted, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(_shingle_sets, "key long, shingles array<long>"), "shingle-sets")
    both = pairs.join(sets.withColumnsRenamed({"key": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"key": "b", "shingles": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("s"))
    links = stored(counted.where(F.col("c") >= SIMILARITY * (F.col("s") - F.col("c")) - 1e-9).select("a", "b"), "links")
    discard(sets)
    return links


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of ``FREQUENT`` shingles at most that most texts of a part of ``docs`` hold, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                data = lowered(data)
                starts, ends, first = word_spans(data, offsets)
                x = np.concatenate(list(_sets(word_hashes(data, starts, ends), first)))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["h"])

    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(FREQUENT_PART)) == 0)
    counts = stored(part.mapInArrow(run, "h long").groupBy("h").count().where("count > 1"), "frequent-shingles")
    # a cut-off by bins of counts, so that no more rows than wanted reach the driver
    step = F.floor(F.log2("count") * 8).cast("int")
    wanted, least = 0, None
    for r in counts.groupBy(step.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():
        wanted += r["n"]
        if wanted > FREQUENT:
            break
        least = r["bin"]
    rows = counts.where(step >= least if least is not None else F.lit(False)).toArrow()
    discard(counts)
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """``sig, set, m, pos``: of every text the shingles one of which any text of the similarity shares, its set's size, and their places."""
    known, counts = frequent_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                data = lowered(data)
                starts, ends, first = word_spans(data, offsets)
                sig, own, size, place = [], [], [], []
                for x in _sets(word_hashes(data, starts, ends), first):
                    name = _set_hash(x)
                    if name in done or not len(x):
                        continue
                    done.add(name)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        x = x[np.argsort(np.where(known[at] == x, counts[at], 0), kind="stable")]
                    k = len(x) - int(np.ceil(SIMILARITY * len(x) - 1e-9)) + 1
                    sig.append(x[:k])
                    own.append(name)
                    size.append(len(x))
                    place.append(np.arange(k, dtype=np.int32))
                if sig:
                    k = [len(x) for x in sig]
                    columns = [np.concatenate(sig).view(np.int64), np.repeat(np.array(own, np.uint64).view(np.int64), k), np.repeat(np.array(size, np.int32), k), np.concatenate(place)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "set", "m", "pos"])

    return docs.select("text").mapInArrow(run, "sig long, set long, m int, pos int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``sig, set``: one of each, where two sets or more have the signature."""
    before: tuple[int, int] | None = None  # signature and set of the last row seen
    held: pa.RecordBatch | None = None  # a last row that still waits for a second set
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        new[0] = before != (int(sig[0]), int(own[0]))
        at = np.flatnonzero(new)
        if not len(at):
            continue
        s = sig[at]
        again = s[1:] == s[:-1]
        met = np.concatenate([[before is not None and before[0] == int(s[0])], again])
        shared = met | np.concatenate([again, [False]])
        if held is not None:
            if met[0]:
                yield held
            held = None
        before = (int(sig[-1]), int(own[-1]))
        if not shared[-1]:
            held = batch.slice(int(at[-1]), 1)
        if shared.any():
            yield batch.take(pa.array(at[shared]))


def _near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members sorted by ``sig``: pairs of different groups that may have the similarity, ``a`` < ``b``."""
    for table in _whole_buckets(batches):
        sig, m = table.column("sig").to_numpy(), table.column("m").to_numpy()
        order = np.lexsort((m, sig))
        sig, m = sig[order], m[order]
        key, root, pos = (table.column(c).to_numpy()[order] for c in ("key", "root", "pos"))
        parity = _parity_of(table.column("parity"))[order]
        cut, size = _groups(sig)
        several = np.minimum.reduceat(root, cut) != np.maximum.reduceat(root, cut)
        end = np.repeat(cut + size, size)
        i, d, a, b, held = np.flatnonzero(np.repeat(several, size)), 1, [], [], 0
        while len(i := i[i + d < end[i]]):
            i = i[m[i] >= SIMILARITY * m[i + d] - 1e-9]  # sizes grow with the place
            j = i + d
            # nothing before the first shingle that a pair shares is shared, and from there no more than what is left of either
            needed = np.ceil(SIMILARITY / (1 + SIMILARITY) * (m[i] + m[j]) - 1e-9)
            fit = (root[i] != root[j]) & (np.minimum(m[i] - pos[i], m[j] - pos[j]) >= needed)
            x, y = i[fit], j[fit]
            near = _may_be_near(m[x], parity[x], m[y], parity[y])
            a.append(key[x[near]])
            b.append(key[y[near]])
            held += len(a[-1])
            d += 1
            if held > _HELD_PAIRS:
                yield _pairs(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
        if held:
            yield _pairs(np.concatenate(a), np.concatenate(b))


def _in_cells(members: DataFrame) -> DataFrame:
    """Members of buckets ``n`` large, dealt out as pairs of blocks where they have more than ``BLOCK``."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = F.col("n") > BLOCK
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64(F.col("sig"), F.least(own, other), F.greatest(own, other)))
    return members.withColumn("sig", F.explode(F.when(large, cells).otherwise(F.array("sig")))).drop("n")


def remaining_pairs(docs: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b``: keys of all pairs of ``texts`` that may have the similarity and aren't joined by ``roots``, stored."""
    rows = prefixes(docs).repartition(F.col("sig")).sortWithinPartitions("sig", "set")
    shared = stored(rows.mapInArrow(_shared, "sig long, set long, m int, pos int"), "shared-shingles")
    named = texts.select("set", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("set", "key", F.coalesce("root", "key").alias("root"))
    named = stored(shared.join(named, "set").select("sig", "key", "root", "m", "pos"), "shared-members")
    discard(shared)
    apart = named.groupBy("sig").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least < most").select("sig", "n")
    members = stored(_in_cells(named.join(apart, "sig")), "open-members")
    discard(named)
    dealt = members.join(texts.select("key", "parity"), "key").repartition(F.col("sig")).sortWithinPartitions("sig")
    pairs = stored(dealt.mapInArrow(_near_members, "a long, b long").distinct(), "remaining-pairs")
    discard(members)
    return pairs


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, set`` of every row, and ``set, root`` of every distinct shingle set: equal roots are one group."""
    rows = stored(sketches(docs), "sketches")
    texts = stored(rows.drop("doc_id").dropDuplicates(["set"]), "texts")
    pairs = stored(candidate_links(texts, choose_plans(texts)), "candidate-links")
    links = verified_links(docs, pairs)
    first = stored(components(links), "roots")
    remaining = remaining_pairs(docs, texts, first)
    discard(pairs, first)
    rest = verified_links(docs, remaining)
    roots = stored(components(links.unionByName(rest)), "roots")
    discard(remaining, links, rest)
    one = texts.select("set", F.col("key").alias("node")).join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "key", "set"), one


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies."""
    with freed_shuffles(docs.sparkSession):
        rows, one = groups(docs)
        # rows that are equal in id and text can't be told apart by a join
        repeated = rows.groupBy("doc_id", "key").count().where("count > 1").limit(1).count() > 0
    named = rows.join(one, "set")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("f"))
    own, wanted, wanted_id = free_names(docs.columns, "own_key", "key", "id")
    kept = first.select(F.col("f.doc_id").alias(wanted_id), F.col("f.key").alias(wanted))
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = keyed.join(kept, (F.col(own) == F.col(wanted)) & F.col("doc_id").eqNullSafe(F.col(wanted_id)), "left_semi")
    if repeated:
        out = out.dropDuplicates(["doc_id", own])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
