"""Removal of long passages that occur more than once in a corpus.

A passage is judged by windows of ``width`` consecutive words of one document:
a window whose word sequence also starts anywhere else is repeated, and every
word that a repeated window covers is removed.

Within one corpus the reference is the corpus itself, so suffix automata of it
can't be broadcast (see the README for figures); :mod:`suffix_automaton` does
that for a reference of bounded size. Here the reference is dealt out instead:
every window goes where the smallest hash of its word 8-grams (its minimiser)
sends it, so that equal windows meet. Consecutive windows with the same
minimiser travel as one row of hashes. A task compares the windows of its
minimisers, sorted, one group after the other. Copies of a whole text are
counted by a hash of the text and travel once per task. Of equal runs of
windows a task sends two to be compared; the others are repeated for sure and
are dealt out by text, so a passage that most documents share is no task's own.

Defined cases: null and empty texts have no words, nothing is removed, and the
hash is that of the empty string; a text shorter than a window keeps all;
repeated rows are copies of each other; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliframe.llm.common import durable
from ampliframe.llm.tokens import chunks, mixed, window_hashes, word_hashes, word_spans

WIDTH = 35
GRAM = 8
_LAST = np.uint64(0x9E3779B97F4A7C15)
#: Distinct runs that a task remembers, to send a run that it has sent twice already without its hashes.
_HELD_RUNS = 1 << 20
_HASH_BYTES = 6  # of each window's hash; windows are compared only under one 64-bit minimiser and place of it


def minimisers(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value of each run of ``span`` values, and its leftmost place."""
    value, place, size = grams, np.arange(len(grams)), 1
    out_v = out_p = None
    have, left, n = 0, span, len(grams) - span + 1
    while left:
        if left & 1:
            v, p = value[have : have + n], place[have : have + n]
            if out_v is None:
                out_v, out_p = v, p
            else:
                less = v < out_v
                out_v, out_p = np.where(less, v, out_v), np.where(less, p, out_p)
            have += size
        left >>= 1
        if left:
            less = value[size:] < value[:-size]
            place = np.where(less, place[size:], place[:-size])
            value = np.minimum(value[size:], value[:-size])
            size *= 2
    return out_v, out_p


def text_runs(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's word hashes: the hash of every window; and minimiser, first window and the minimiser's place, of each run of windows."""
    windows = window_hashes(h, width)
    value, place = minimisers(window_hashes(h, gram), width - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return windows, value[first], first, place[first]


def _runs(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sent: dict[int, int] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in chunks(batch.column(1)):
                starts, ends, first_word = word_spans(data, offsets)
                hashes = word_hashes(data, starts, ends)
                mv, key, start, place, blob, length = [], [], [], [], [], []
                for d in np.flatnonzero(np.diff(first_word) >= width).tolist():
                    k = int(keys[lo + d])
                    if k in seen:
                        continue
                    seen.add(k)
                    windows, value, first, at = text_runs(hashes[first_word[d] : first_word[d + 1]], width, gram)
                    mv.append(value)
                    start.append(first)
                    place.append(at)
                    key.append(np.full(len(first), k))
                    length.append(np.diff(first, append=len(windows)))
                    blob.append(windows)
                if not mv:
                    continue
                mv, key, start, size, windows = (np.concatenate(x) for x in (mv, key, start, length, blob))
                back = np.concatenate(place) - start
                cut = np.concatenate([[0], np.cumsum(size)])
                # first and last window together have all words of a run
                same = mixed(mv ^ mixed(windows[cut[:-1]]) ^ mixed(windows[cut[1:] - 1] + _LAST) ^ (size * 64 + back).astype(np.uint64))
                sure = np.zeros(len(mv), bool)
                for i, s in enumerate(same.tolist()):
                    n = sent.get(s, 0)
                    sure[i] = n > 1
                    sent[s] = n + 1
                if len(sent) > _HELD_RUNS:
                    sent.clear()
                column = pa.Array.from_buffers(
                    pa.binary(),
                    len(mv),
                    [
                        None,
                        pa.py_buffer((cut * _HASH_BYTES).astype(np.int32)),
                        pa.py_buffer(np.ascontiguousarray(windows.view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).ravel()),
                    ],
                )
                if sure.any():
                    column = pa.compute.if_else(pa.array(sure), pa.scalar(b"", pa.binary()), column)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(sure, mixed(key.view(np.uint64) + start.astype(np.uint64)), mv).view(np.int64)),
                        pa.array(key),
                        pa.array(start.astype(np.int32)),
                        pa.array(np.where(sure, -size, back).astype(np.int32)),
                        column,
                    ],
                    ["mv", "key", "start", "back", "windows"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by minimiser: runs with repeated windows, and which of their windows these are, as bits."""

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        size = table.column("back").to_numpy()
        sure = np.flatnonzero(size < 0)
        if len(sure):
            done = table.take(pa.array(sure)).combine_chunks()
            mask = (np.int64(1) << (-size[sure]).astype(np.int64)) - 1
            yield pa.RecordBatch.from_arrays([done.column("key").combine_chunks(), done.column("start").combine_chunks(), pa.array(mask)], ["key", "start", "mask"])
            table = table.take(pa.array(np.flatnonzero(size >= 0))).combine_chunks()
        mv = table.column("mv").to_numpy()
        if len(mv) < 2:
            return
        same = mv[1:] == mv[:-1]
        rows = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(rows):
            return
        table = table.take(pa.array(rows)).combine_chunks()
        mv = table.column("mv").to_numpy().view(np.uint64)
        key, start, back = (table.column(c).to_numpy() for c in ("key", "start", "back"))
        # a text that several tasks have sent counts once
        order = np.lexsort((start, key, mv))
        new = np.ones(len(order), bool)
        new[1:] = (mv[order][1:] != mv[order][:-1]) | (key[order][1:] != key[order][:-1]) | (start[order][1:] != start[order][:-1])
        rows = np.sort(order[new])
        table, mv, key, start, back = table.take(pa.array(rows)).combine_chunks(), mv[rows], key[rows], start[rows], back[rows]
        blob = table.column("windows").combine_chunks()
        blob = blob if isinstance(blob, pa.Array) else blob.chunk(0)
        _, cut, data = blob.buffers()
        cut = np.frombuffer(cut, np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[cut[0] : cut[-1]].reshape(-1, _HASH_BYTES)
        counts = np.diff(cut) // _HASH_BYTES
        owner = np.repeat(np.arange(len(rows)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        value = np.zeros((len(data), 8), np.uint8)
        value[:, :_HASH_BYTES] = data
        value[:, _HASH_BYTES] = back[owner] - nth  # place of the minimiser in the window
        value = value.view(np.uint64).ravel()
        order = np.lexsort((value, mv[owner]))
        m, v = mv[owner][order], value[order]
        equal = (m[1:] == m[:-1]) & (v[1:] == v[:-1])
        hit = order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
        if not len(hit):
            return
        mask = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(mask, owner[hit], np.int64(1) << nth[hit])
        some = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(start[some]), pa.array(mask[some])], ["key", "start", "mask"])

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        mv = table.column("mv").to_numpy()
        cut = int(np.searchsorted(mv, mv[-1])) if len(mv) else 0  # the last group may go on
        if cut:
            yield from judge(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield from judge(rest)


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``key, copies, marks`` of each distinct text with something repeated: rows that have the text, and (first window, bits) of its repeated windows.

    ``key`` is :func:`text_key`.
    """
    keyed = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    runs = keyed.mapInArrow(_runs(width, gram), "mv long, key long, start int, back int, windows binary")
    marked = runs.repartition(F.col("mv")).sortWithinPartitions("mv").mapInArrow(_repeated, "key long, start int, mask long")
    # several tasks may have judged the same text, each of its runs
    marks = marked.groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    return durable(copies.join(marks, "key", "full").select("key", F.coalesce("copies", F.lit(1)).alias("copies"), "marks"))


def text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def covered_words(n: int, marks: list[dict] | None, copies: int, width: int) -> np.ndarray:
    """Which of a text's ``n`` words a repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    if n >= width and copies > 1:
        edge[0] += 1
        edge[n] -= 1
    for m in marks or ():
        bits, at = m["mask"], m["start"]
        while bits:
            if bits & 1:
                edge[at] += 1
                edge[at + width] -= 1
            bits >>= 1
            at += 1
    return np.cumsum(edge[:-1]) > 0


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            copies, marks = batch.column(2), batch.column(3)
            for i, text in enumerate(batch.column(1)):
                found = text.as_buffer().to_pybytes().split() if text.is_valid else []
                c = copies[i].as_py() or 1
                gone = 0
                kept = found
                if len(found) >= width and (c > 1 or marks[i].is_valid):
                    out = covered_words(len(found), marks[i].as_py(), c, width)
                    gone = int(out.sum())
                    kept = [w for w, x in zip(found, out.tolist(), strict=True) if not x]
                n_words.append(len(found))
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``."""
    found = repeated_windows(docs, width)
    rows = docs.select("doc_id", "text", text_key().alias("key")).join(found, "key", "left").select("doc_id", "text", "copies", "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_kept(width), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
