"""Benchmark decontamination by latent semantic retrieval.

1. Every passage (``PASSAGE`` words, one every ``STRIDE``) of every document is
   a TF-IDF vector over hashed words; document frequencies are counted over the
   passages of all documents.
2. A randomised SVD of all documents, cut into consecutive passages so that
   each word takes part once, together with all benchmark items gives ``RANK``
   latent axes: a sketch of the rows' span, then the rows' energy inside it.
   Every passage, also the overlapping ones, is projected and searched.
3. Passages whose latent vector has a cosine of ``MIN_COSINE`` or more with an
   item are candidates.
4. A candidate is confirmed on the words themselves: the longest common
   subsequence of item and surroundings must cover ``MIN_COMMON`` of the item,
   within a stretch not much longer than the item, and of the item's rarest
   words (its answer) ``MIN_ANSWER`` must occur there.

The benchmark goes to tasks in blocks of ``ITEM_BLOCK`` items, one search of
the documents per block, so what is broadcast has a fixed bound.

Defined cases: null and empty texts have no passages and match nothing, on
either side; an item of fewer than ``MIN_ITEM_WORDS`` words is too short for
its direction to tell it, so all texts are searched for its exact words
(``cosine`` is null then); equal rows of the benchmark count once, equal texts
with other ids and repeated documents each match; null ids are returned as
null, ids may have any type; of passages with equal cosines the first one that
confirms decides; empty tables give empty results; texts of any length are
searched whole; further columns are ignored by :func:`matches` and kept,
whatever their names, by :func:`uncontaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ampliframe.llm.common import free_names, stored
from ampliframe.llm.tokens import chunks, lowered, mixed, window_hashes, word_hashes, word_spans

FEATURES = 1 << 16
STRIDE, PASSAGE = 16, 48
RANK, OVERSAMPLE = 64, 48
#: Axes that owe less of their length to the items than this part of what axes usually do are what all texts of a language share; they are left out.
ITEM_SHARE = 0.9
#: Length of an item's row, where a passage's is 1; all passages together weigh as so many at most, so that items are told apart in a corpus of any size.
ITEM_WEIGHT, CORPUS_WEIGHT = 5.0, 4096
#: Columns of the sketch that a row is added to, and parts that sketches travel in.
SIGNS, PARTS = 8, 64
MIN_COSINE = 0.6
MIN_COMMON, MIN_ANSWER, ANSWER_WORDS = 0.65, 0.5, 6
MAX_STRETCH = 1.5
MIN_ITEM_WORDS = 5
ITEM_BLOCK = 2000
#: Stride blocks of the corpus to a task that sketches, where that is more tasks than cores keep busy.
_SKETCHED_BLOCKS = 1 << 22
_ROWS = 1 << 10


def _passage_words(first: np.ndarray, words: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Of texts whose words begin at ``first``: the first word of every block of ``words``, and each block's text."""
    size = np.diff(first)
    blocks = -(-size // words)
    text = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return first[:-1][text] + nth * words, text


def _windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) block of every passage: each block of a text begins one, unless an earlier one reaches the text's end."""
    reach = PASSAGE // STRIDE
    n = len(text)
    begin = np.arange(n)
    last_of_text = np.searchsorted(text, text, "right")
    end = np.minimum(begin + reach, last_of_text)
    first_of_text = np.searchsorted(text, text, "left")
    whole = (begin + reach <= last_of_text) | (begin == first_of_text)
    return begin[whole], end[whole]


def passage_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many stride blocks of all documents each hashed word occurs, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                data = lowered(data)
                starts, ends, first = word_spans(data, offsets)
                if not len(starts):
                    continue
                heads, _ = _passage_words(first)
                feature = (word_hashes(data, starts, ends) & np.uint64(FEATURES - 1)).astype(np.int64)
                block = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(starts)))
                both = np.sort(block << 16 | feature)
                both = both[np.concatenate([[True], both[1:] != both[:-1]])]
                total += np.bincount(both & (FEATURES - 1), minlength=FEATURES)
                n += len(heads)
        if n:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, FEATURES)), pa.array(np.append(total[used], n))], ["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 1, np.int64)
    counts[rows["feature"]] = rows["n"]
    return counts[:-1], int(counts[-1])


def _block_sums(table: np.ndarray, feature: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``table`` (the last one zero) over the words of consecutive blocks, a word of each block at a time."""
    size = np.diff(heads, append=len(feature))
    out = np.zeros((len(heads), table.shape[1]), np.float32)
    rows = np.empty((_ROWS, table.shape[1]), np.float32)
    for lo in range(0, len(heads), _ROWS):
        at, n, own = heads[lo : lo + _ROWS], size[lo : lo + _ROWS], out[lo : lo + _ROWS]
        for k in range(int(n.max())):
            long = n > k
            if 2 * np.count_nonzero(long) < len(n):
                some = np.flatnonzero(long)
                own[some] += table[feature[at[some] + k]]
            else:
                row = np.where(long, feature[np.minimum(at + k, len(feature) - 1)], len(table) - 1)
                own += np.take(table, row, axis=0, out=rows[: len(n)], mode="clip")
    return out


def _with_zero(table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(table) + 1, table.shape[1]), np.float32)
    out[:-1] = table
    return out


def _rows_of(texts: pa.Array, idf: np.ndarray, words: int) -> Iterator[tuple]:
    """Consecutive passages of ``words`` words as TF-IDF rows: each one's text and first word, features of the words; rows, features and weights without repeats; and each row's factor.

    A whole passage has length 1; what is left at a text's end weighs as its part of one.
    """
    for lo, _, data, offsets in chunks(texts):
        data = lowered(data)
        starts, ends, first = word_spans(data, offsets)
        if not len(starts):
            continue
        feature = (word_hashes(data, starts, ends) & np.uint64(FEATURES - 1)).astype(np.int64)
        heads, text = _passage_words(first, words)
        size = np.diff(heads, append=len(feature))
        both = np.sort(np.repeat(np.arange(len(heads)), size) << 16 | feature)
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        row, own = both[at] >> 16, both[at] & (FEATURES - 1)
        weight = np.diff(at, append=len(both)) * idf[own]
        square = np.minimum(size / PASSAGE, 1.0) if words == PASSAGE else np.ones(len(size))
        factor = np.sqrt(square / np.maximum(np.bincount(row, weight**2, len(heads)), 1e-18))
        yield lo + text, heads, feature, row, own, weight * factor[row], factor


def _sketched(batches: Iterator[pa.RecordBatch], idf: np.ndarray, words: int, length: float) -> Iterator[pa.RecordBatch]:
    """Of ``seed, text``: this task's share of A' times a sparse random matrix of signs, by parts of the features; a whole passage has ``length``."""
    width = RANK + OVERSAMPLE
    out, some = np.zeros((FEATURES, width), np.float32), False
    cells = out.reshape(-1)
    for batch in batches:
        seeds = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for text, heads, _, row, own, weight, _ in _rows_of(batch.column(1), idf, words):
            some = True
            nth = heads - heads[np.searchsorted(text, text)]
            seed = mixed(seeds[text] ^ mixed(nth.astype(np.uint64)))
            for k in range(SIGNS):
                # of each of SIGNS groups of columns a row is in one, so none of its signs meet
                h = mixed(seed + np.uint64(k))
                lo, hi = k * width // SIGNS, (k + 1) * width // SIGNS
                column, sign = lo + ((h >> np.uint64(1)) % np.uint64(hi - lo)).astype(np.int64), length * (1.0 - 2.0 * (h & np.uint64(1)))
                np.add.at(cells, own * width + column[row], (sign[row] * weight).astype(np.float32))
    if some:
        yield from _parts(list(out.reshape(PARTS, -1)))


def _energy(batches: Iterator[pa.RecordBatch], idf: np.ndarray, words: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of ``seed, text``: this task's share of (A Q)' A Q, by its rows, where ``table`` has Q's rows times their idf."""
    total = np.zeros((table.shape[1], table.shape[1]))
    for batch in batches:
        for _, heads, feature, _, _, _, factor in _rows_of(batch.column(1), idf, words):
            y = _block_sums(table, feature, heads) * factor[:, None].astype(np.float32)
            total += y.T @ y
    if total.any():
        yield from _parts(list(total))


def _parts(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i, x in enumerate(arrays):
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tobytes()], pa.binary())], ["part", "v"])


def _added_up(rows: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """The sum of each part's arrays; parts are added up by tasks, each sum reaches the driver once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), kind).astype(np.float64)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([x.astype(kind).tobytes()], pa.binary())], ["part", "v"])

    found = rows.repartition(F.col("part")).mapInArrow(run, "part long, v binary").toArrow()
    return {part: np.frombuffer(v.as_buffer(), kind) for part, v in zip(found.column("part").to_pylist(), found.column("v"), strict=True)}


def _basis(sketch: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the sketch's span, by way of its products: in single precision nothing as large as the sketch is held twice."""
    products = np.zeros((sketch.shape[1], sketch.shape[1]))
    for lo in range(0, len(sketch), _ROWS):
        part = sketch[lo : lo + _ROWS].astype(np.float64)
        products += part.T @ part
    values, vectors = np.linalg.eigh(products)
    kept = values > 1e-10 * max(values.max(), 1e-30)
    return sketch @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)


def latent_axes(docs: DataFrame, blocks: int, items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """``FEATURES`` by ``RANK``: orthonormal axes of a randomised SVD of all documents and items, without those that are common to all texts.

    A has a row for each passage and each item. One pass adds up A' times a
    random matrix of signs; its orthonormal basis Q goes back, and a second pass
    adds up (A Q)' A Q, whose eigenvectors are the axes. What tasks send has the
    size of a sketch, whatever number of rows they have; ``blocks`` of the
    corpus (its stride blocks) tell how much its passages weigh and how many
    tasks share the first pass.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.xxhash64("doc_id", "text").alias("seed"), "text")
    items = items.select(F.xxhash64("text").alias("seed"), "text").distinct()
    passages = max(1.0, blocks * STRIDE / PASSAGE)
    own = [(texts, PASSAGE, min(1.0, CORPUS_WEIGHT / passages)), (items, 1 << 40, ITEM_WEIGHT**2)]
    axes = np.zeros((FEATURES, RANK), np.float32)
    # a task sends a whole sketch, however few rows it has
    tasks = max(2 * sc.defaultParallelism, blocks // _SKETCHED_BLOCKS), sc.defaultParallelism
    shares = [rows.coalesce(n).mapInArrow(lambda it, words=words, w=w: _sketched(it, idf, words, w**0.5), "part long, v binary") for (rows, words, w), n in zip(own, tasks, strict=True)]
    parts = _added_up(shares[0].unionByName(shares[1]), np.float32)
    if not parts:
        return axes
    basis = _basis(np.concatenate([parts.pop(i) for i in range(PARTS)]).reshape(FEATURES, -1))
    width = basis.shape[1]
    table = sc.broadcast(_with_zero(basis * idf[:, None].astype(np.float32)))
    energy = []
    for rows, words, w in own:
        parts = _added_up(rows.mapInArrow(lambda it, words=words: _energy(it, idf, words, table.value), "part long, v binary"), np.float64)
        energy.append(w * np.stack([parts[i] for i in range(width)]) if parts else np.zeros((width, width)))
    table.destroy()
    values, vectors = np.linalg.eigh(sum(energy))
    order = np.argsort(-values)
    order = order[values[order] > 1e-6 * values.max(initial=0.0)]
    if not len(order):
        return axes
    of_items = np.einsum("ik,ij,jk->k", vectors[:, order], energy[1], vectors[:, order]) / values[order]
    order = order[of_items >= ITEM_SHARE * np.median(of_items[:RANK])][:RANK]
    axes[:, : len(order)] = basis @ vectors[:, order].astype(np.float32)
    return axes


@dataclass
class _Items:
    ids: list
    words: list[list[int]]
    masks: list[dict[int, int]]
    answers: list[set[int]]
    latent: np.ndarray
    short: dict[int, dict[int, list]]  # by number of words and their hash, the ids of items that are searched as they are


def _prepared(rows: list, idf: np.ndarray, axes: np.ndarray) -> _Items:
    out = _Items([], [], [], [], np.zeros((0, axes.shape[1]), np.float32), {})
    latent = []
    for r in rows:
        texts = pa.array([r["text"] or ""])
        _, _, data, offsets = next(chunks(texts))
        data = lowered(data)
        starts, ends, _ = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        if len(h) < MIN_ITEM_WORDS:
            if len(h):
                out.short.setdefault(len(h), {}).setdefault(int(window_hashes(h, len(h))[0]), []).append(r["item_id"])
            continue
        feature = (h & np.uint64(FEATURES - 1)).astype(np.int64)
        words = h.tolist()
        masks: dict[int, int] = {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        rare = sorted(set(words), key=lambda w: (-idf[w & (FEATURES - 1)], w))[:ANSWER_WORDS]
        v = (axes[feature] * idf[feature][:, None]).sum(axis=0)
        out.ids.append(r["item_id"])
        out.words.append(words)
        out.masks.append(masks)
        out.answers.append(set(rare))
        latent.append(v / max(np.linalg.norm(v), 1e-9))
    if latent:
        out.latent = np.array(latent, np.float32)
    return out


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, as bit masks by word, and ``words`` (bit-parallel)."""
    full = (1 << size) - 1
    state = full
    for w in words:
        hit = state & masks.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def _confirmed(masks: dict[int, int], item: list[int], answer: set[int], words: list[int]) -> float:
    """Share of the item that a stretch of ``words`` of about its length has in order, or 0."""
    at = [i for i, w in enumerate(words) if w in masks]
    if len(at) < MIN_COMMON * len(item) or len(answer.intersection(words)) < MIN_ANSWER * len(answer):
        return 0.0
    reach, best = int(MAX_STRETCH * len(item)) + 1, 0.0
    step = max(1, len(item) // 4)
    for lo in range(at[0], max(at[0] + 1, at[-1] - len(item) + 2), step):
        part = words[lo : lo + reach]
        if len(answer.intersection(part)) >= MIN_ANSWER * len(answer):
            best = max(best, common_subsequence(masks, len(item), part) / len(item))
    return best if best >= MIN_COMMON else 0.0


def _search(items: _Items, projection: np.ndarray):
    """Matches of consecutive texts: row, item, cosine, share in common."""
    lengths = np.array([len(w) for w in items.words])

    def run(texts: pa.Array) -> Iterator[tuple[int, int, float, float]]:
        for lo, _, data, offsets in chunks(texts):
            data = lowered(data)
            starts, ends, first = word_spans(data, offsets)
            if not len(starts):
                continue
            h = word_hashes(data, starts, ends)
            heads, text = _passage_words(first)
            blocks = _block_sums(projection, (h & np.uint64(FEATURES - 1)).astype(np.int64), heads)
            begin, end = _windows(text)
            z = blocks[begin].copy()
            for k in range(1, PASSAGE // STRIDE):
                more = begin + k < end
                z[more] += blocks[begin[more] + k]
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            for w0 in range(0, len(z), 8192):
                cosine = z[w0 : w0 + 8192] @ items.latent.T
                near, item = np.nonzero(cosine >= MIN_COSINE)
                best: dict[tuple[int, int], list[tuple[float, int]]] = {}
                for w, i in zip(near.tolist(), item.tolist(), strict=True):
                    best.setdefault((int(text[begin[w0 + w]]), i), []).append((float(cosine[w, i]), w0 + w))
                for (t, i), found in best.items():
                    found.sort(reverse=True)
                    share, top = 0.0, found[0][0]
                    for _, w in found:
                        at, n = int(heads[begin[w]]), int(lengths[i])
                        near_words = h[max(int(first[t]), at - n) : min(int(first[t + 1]), at + PASSAGE + n)].tolist()
                        share = max(share, _confirmed(items.masks[i], items.words[i], items.answers[i], near_words))
                        if share > 0:
                            break
                    if share > 0:
                        yield lo + t, i, top, share

    return run


def _short_matches(items: _Items, texts: pa.Array) -> Iterator[tuple[int, object]]:
    """Rows of texts and ids of the short items whose words they have in a row."""
    known = {n: np.array(sorted(by_hash), np.uint64) for n, by_hash in items.short.items()}
    for lo, _, data, offsets in chunks(texts) if known else ():
        data = lowered(data)
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, wanted in known.items():
            runs = window_hashes(h, n)
            if not len(runs):
                continue
            at = np.minimum(np.searchsorted(wanted, runs), len(wanted) - 1)
            hit = np.flatnonzero((wanted[at] == runs) & (row[: len(runs)] == row[n - 1 :]))
            for t, k in sorted(set(zip(row[hit].tolist(), at[hit].tolist(), strict=True))):
                for item in items.short[n][int(wanted[k])]:
                    yield lo + t, item


def matches(docs: DataFrame, benchmark: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """``doc_id, item_id, cosine, common`` for every document and benchmark item that it contains or paraphrases."""
    spark = docs.sparkSession
    counts, blocks = passage_frequencies(docs)
    idf = np.log((1 + blocks) / (1 + counts))
    axes = latent_axes(docs, blocks, benchmark, idf)
    projection = spark.sparkContext.broadcast(_with_zero(axes * idf[:, None].astype(np.float32)))
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    batch_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    benchmark = benchmark.select("item_id", "text").distinct()
    n_blocks = max(1, -(-benchmark.count() // block))
    result = None
    for b in range(n_blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b) if n_blocks > 1 else benchmark
        items = spark.sparkContext.broadcast(_prepared(part.collect(), idf, axes))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            search = _search(items.value, projection.value)
            seen: dict = {}
            for batch in batches:
                found = []
                for row, i, cosine, share in search(batch.column(1)):
                    key = (row, i)
                    if key not in seen or seen[key][1] < share:
                        seen[key] = (cosine, share)
                found = [(r, items.value.ids[i], c, s) for (r, i), (c, s) in sorted(seen.items())]
                found += [(r, item, None, 1.0) for r, item in _short_matches(items.value, batch.column(1))]
                seen = {}
                if found:
                    row, item, cosine, share = zip(*found, strict=True)
                    columns = [batch.column(0).take(pa.array(row)), pa.array(item, batch_type), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "common"])

        one = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, cosine double, common double")
        result = one if result is None else result.unionByName(one)
    return result


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns; a row without an id is judged on its own text too."""
    (key,) = free_names(docs.columns, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = stored(matches(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
