"""Cross-entropy difference: documents scored by two matched n-gram models.

A target model (documents labelled as of high quality) and a background model
(all documents) share one vocabulary, one order (bigrams) and one smoothing,
so that a document's score, the mean over its words of the difference of their
losses, tells how much more like the target it is than like the corpus. With c
the word before w (or the start of the text), a model gives w the probability
(n(c, w) + K p(w)) / (n(c) + K), where p is its add-one unigram model.

Both models count all words and all bigrams of the corpus and grow with it.
Only what is frequent is sent to every task, ``FREQUENT_WORDS`` words and
``FREQUENT_PAIRS`` bigrams at most with their counts over all documents. All
other bigrams travel once, without being counted first: those that end in a
rare word to one place, those of a frequent word by the bigram. There all
occurrences meet, so the counts of the bigram, of a rare word and of a rare
context are sums in place, and what goes back is a sum of losses by text. They
travel packed, a row per task and part, hashes in 48 bits under the number of
the part; parts have ``PART_WORDS`` words of the corpus each, so their number
grows with it, not their size. ``TASKS_A_CORE`` tasks a core work through the
parts, one part after the other, and add up what each text has in all of them,
in memory up to ``SUMS_BYTES`` and beyond in a file of the task: a text has one
sum a task, however many parts the corpus has. The texts of the target are found by a join
behind a Bloom filter of fixed size, so that only they are shuffled; they pass
once more, to be counted and not scored.

Defined cases: a null or empty text has 0 words and null scores; repeated rows
count as often as they occur, and copies of a text have one score; null ids
match no label; without any labelled document the target model is uniform over
all words; empty tables give empty results; texts of any length are scored
whole; words as frequent as the last one told apart may be left to the rare
ones, which changes the work only; further columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliframe.llm.common import stored, words
from ampliframe.llm.tokens import chunks, lowered, mixed, word_hashes, word_spans

#: Weight of the unigram model in a word's context, in words.
PRIOR_WORDS = 20.0
#: Words and bigrams whose counts every task has; a word's number has 16 bits.
FREQUENT_WORDS, FREQUENT_PAIRS = 1 << 16, 1 << 18
#: Part of the texts in which frequent bigrams are looked for; they are then counted in all.
SAMPLE_PART = 8
#: Words of the corpus to a part, steps in which a task works through one, and bytes of texts that are packed at a time.
PART_WORDS, STEPS, PACKED_BYTES = 1 << 22, 16, 1 << 20
#: Tasks that work through the parts, by cores; bytes of a task's sums that are held in memory, and texts whose sums are given out at a time.
TASKS_A_CORE, SUMS_BYTES, SUMS_ROWS = 2, 1 << 25, 1 << 16
#: 64-bit words of the Bloom filter for the target's ids.
FILTER_WORDS = 1 << 18
START = np.uint64(0x5851F42D4C957F2D)
_HELD = 1 << 19


def _pair_hashes(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(c + START) ^ w)


def _word_arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a column of texts, in parts: row of each word, the word's hash, that of the word before (or START), and whether it ends its text."""
    for lo, hi, data, offsets in chunks(column):
        data = lowered(data)
        starts, ends, first = word_spans(data, offsets)
        w = word_hashes(data, starts, ends)
        if not len(w):
            continue
        row = np.repeat(np.arange(lo, hi), np.diff(first))
        c = np.empty_like(w)
        c[1:] = w[:-1]
        head = np.ones(len(w), bool)
        head[1:] = row[1:] != row[:-1]
        c[head] = START
        yield row, w, c, np.concatenate([head[1:], [True]])


class _Sums:
    """Counts of 64-bit values, in bounded memory: what it holds beyond ``_HELD`` values is given out."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.unique(values, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > _HELD:
            self.parts = [self._merged()]
            self.size = len(self.parts[0][0])
            if self.size > _HELD // 2:
                yield from self.rest()

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        values, place = np.unique(np.concatenate([v for v, _ in self.parts]), return_inverse=True)
        return values, np.bincount(place, np.concatenate([n for _, n in self.parts])).astype(np.int64)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            values, n = self._merged()
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["h", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, n``: hash and number of every distinct word of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for _, w, _, _ in _word_arrays(batch.column(0)):
                yield from sums.add(w)
        yield from sums.rest()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _most(counts: DataFrame, column: str, limit: int) -> pa.Table:
    """The rows with the largest values of ``column``, ``limit`` of them at most: cut off by bins of values, so that no more rows reach the driver."""
    step = F.floor(F.log2(column) * 16).cast("int")
    wanted, least = 0, None
    for r in counts.groupBy(step.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():
        wanted += r["n"]
        if wanted > limit:
            break
        least = r["bin"]
    return (counts.where(step >= least) if least is not None else counts.where("false")).orderBy("h").toArrow()


def _place(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value among sorted ones, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _sorted_hashes(table: pa.Table) -> np.ndarray:
    return np.sort(table.column("h").to_numpy().view(np.uint64))


def _frequent_pairs(docs: DataFrame, limit: int) -> np.ndarray:
    """Sorted hashes of the bigrams that a part of the texts has most."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for _, w, c, _ in _word_arrays(batch.column(0)):
                yield from sums.add(_pair_hashes(c, w))
        yield from sums.rest()

    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_PART)) == 0)
    return _sorted_hashes(_most(stored(part.mapInArrow(look, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "sampled-bigrams"), "n", limit))


def _counted(docs: DataFrame, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all texts: how often each of ``words`` is a word and a context, how often each of ``pairs`` occurs, and the numbers of words and of texts with words."""
    cells = 2 * len(words) + len(pairs) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, w, c, _ in _word_arrays(batch.column(0)):
                for first, known, values in ((0, words, w), (len(words), words, c), (2 * len(words), pairs, _pair_hashes(c, w))):
                    at = _place(known, values)
                    total[first : first + len(known)] += np.bincount(at[at >= 0], minlength=len(known))
                total[-2:] += len(w), int((c == START).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    out = np.zeros(cells)
    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    k = len(words)
    return out[: 2 * k].reshape(2, k).T, out[2 * k : -2], out[-2:]


class _Model:
    """What every task knows: totals, and the counts of frequent words and bigrams. Column 0 is the background, column 1 the target."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, counted: tuple, size: int):
        self.words, self.pairs = words, pairs
        self.unigrams, self.contexts = (np.stack([c[0][:, k] for c in counted], axis=1) for k in (0, 1))
        self.bigrams = np.stack([c[1] for c in counted], axis=1)
        totals, self.texts = (np.array([c[2][k] for c in counted]) for k in (0, 1))
        self.prior = PRIOR_WORDS / np.maximum(totals + size, 1.0)

    def pair_losses(self, pairs: np.ndarray, unigrams: np.ndarray) -> np.ndarray:
        return -np.log(pairs + self.prior * (unigrams + 1))

    def context_losses(self, contexts: np.ndarray) -> np.ndarray:
        return np.log(contexts + PRIOR_WORDS)


_SCORED = "part long, packed binary, key long, n long, lb double, lt double"
#: Columns of packed rows: of a frequent word its number and the bigram, of a rare word its hash and the bigram; then text and number.
_FREQUENT_ROW, _RARE_ROW = (("word", "<u2"), ("h", 6), ("text", "<u2"), ("n", "<u2")), (("g", 6), ("h", 6), ("text", "<u2"), ("n", "<u2"))
_MOST_TEXTS = 1 << 16
#: 64-bit words at the head of a packed row: whether it is scored, its texts, its rows of either kind, the number of its pack, the pack's texts.
_HEAD = 6
_SUM = np.dtype([("key", "<i8"), ("lb", "<f8"), ("lt", "<f8")])
#: Bit of a row's number that says that the word ends its text there, and so is no context.
_LAST, _MOST = 1 << 15, (1 << 15) - 1


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _packed(kind: tuple, fields: dict[str, np.ndarray]) -> bytes:
    return b"".join(_six(fields[name]) if width == 6 else fields[name].astype(width).tobytes() for name, width in kind)


def _unpacked(kind: tuple, size: int, blob: pa.Buffer, at: int) -> tuple[dict[str, np.ndarray], int]:
    out = {}
    for name, width in kind:
        if width == 6:
            x = np.zeros((size, 8), np.uint8)
            x[:, :6] = np.frombuffer(blob, np.uint8, 6 * size, at).reshape(-1, 6)
            out[name], at = x.view("<u8").ravel(), at + 6 * size
        else:
            out[name], at = np.frombuffer(blob, width, size, at).astype(np.int64), at + 2 * size
    return out, at


def _runs(text: np.ndarray, h: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each equal row, and how many there are (``_MOST`` at a time), marked if the word ends its text."""
    order = np.lexsort((last, h, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1]) | (last[order][1:] != last[order][:-1])
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(order))
    times = -(-n // _MOST)
    count = np.full(times.sum(), _MOST)
    count[np.cumsum(times) - 1] = n - (times - 1) * _MOST
    at = order[np.repeat(at, times)]
    return at, count | np.where(last[at], _LAST, 0)


def _scored_here(model: _Model, parts: int, scored: bool, pack: int, key: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Of at most ``_MOST_TEXTS`` texts: their losses by what is frequent, and what is left of them, packed by part; ``pack`` is a number that no other call of any task has."""
    n, sums = np.zeros(len(key), np.int64), np.zeros((len(key), 2))
    left: tuple[list, list] = ([], [])
    for row, w, c, last in _word_arrays(texts):
        n += np.bincount(row, minlength=len(key))
        word, h = _place(model.words, w), _pair_hashes(c, w)
        pair = np.where(word >= 0, _place(model.pairs, h), -1)
        losses = np.zeros((len(w), 2))
        start = np.flatnonzero(c == START)
        losses[start] += model.context_losses(model.texts)
        # a word's loss as the context of the next is added where the word is
        known = np.flatnonzero((word >= 0) & ~last)
        losses[known] += model.context_losses(model.contexts[word[known]])
        known = np.flatnonzero(pair >= 0)
        losses[known] += model.pair_losses(model.bigrams[pair[known]], model.unigrams[word[known]])
        for k in (0, 1):
            sums[:, k] += np.bincount(row, losses[:, k], len(key))
        some = np.flatnonzero((pair < 0) & (word >= 0))
        at, times = _runs(row[some], h[some], np.zeros(len(some), bool))
        at = some[at]
        left[0].append({"part": mixed(h[at]), "word": word[at], "h": h[at], "text": row[at], "n": times})
        some = np.flatnonzero(word < 0)
        at, times = _runs(row[some], h[some], last[some])
        at = some[at]
        left[1].append({"part": mixed(w[at]), "g": w[at], "h": h[at], "text": row[at], "n": times})
    some = np.flatnonzero(n)
    if not len(some):
        return
    if scored:
        spread = (mixed(key[some].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(some), pa.binary()), pa.array(key[some]), pa.array(n[some]), pa.array(sums[some, 0]), pa.array(sums[some, 1])], ["part", "packed", "key", "n", "lb", "lt"])
    rows = []
    for found in left:
        x = {name: np.concatenate([f[name] for f in found]) for name in found[0]}
        x["part"] = (x["part"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(x["part"], kind="stable")
        rows.append({name: v[order] for name, v in x.items()})
    present = np.unique(np.concatenate([x["part"] for x in rows]))
    cuts = [[*np.searchsorted(x["part"], present).tolist(), len(x["part"])] for x in rows]
    packed = []
    for i in range(len(present)):
        mine = [{name: v[c[i] : c[i + 1]] for name, v in x.items()} for x, c in zip(rows, cuts, strict=True)]
        used = np.unique(np.concatenate([x["text"] for x in mine]))
        blob = [np.array([scored, len(used), *(len(x["text"]) for x in mine), pack, len(key)], "<i8").tobytes(), key[used].tobytes(), used.astype("<u2").tobytes()]
        for kind, x in zip((_FREQUENT_ROW, _RARE_ROW), mine, strict=True):
            blob.append(_packed(kind, x | {"text": np.searchsorted(used, x["text"])}))
        packed.append(b"".join(blob))
    k = len(present)
    if k:
        yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(packed, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], ["part", "packed", "key", "n", "lb", "lt"])


def _part_runs(part: np.ndarray) -> tuple[list[int], list[int]]:
    """First row and size of each run of equal parts."""
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return cut.tolist(), np.diff(cut, append=len(part)).tolist()


def _sum_by(values: tuple[np.ndarray, ...], n: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Of every row, the sums over the rows with equal values: of all documents and of the target."""
    order = np.lexsort(values)
    new = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in values:
        same &= x[order][1:] == x[order][:-1]
    new[1:] = ~same
    group = np.cumsum(new) - 1
    out = np.zeros((len(order), 2))
    for k, x in enumerate((n * scored, n * ~scored)):
        out[order, k] = np.bincount(group, x[order])[group]
    return out


class _TextSums:
    """Sums of losses by text over all parts of a task: a place for each text of each pack, in memory up to ``SUMS_BYTES`` and beyond in a file."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=SUMS_BYTES)
        self.first: dict[int, int] = {}
        self.texts = 0

    def add(self, pack: int, texts: int, used: np.ndarray, key: np.ndarray, sums: np.ndarray) -> None:
        """``sums`` of the texts with the numbers ``used`` of a pack of ``texts``."""
        if known := pack in self.first:
            self.file.seek(self.first[pack] * _SUM.itemsize)
            rows = np.frombuffer(self.file.read(texts * _SUM.itemsize), _SUM).copy()
        else:
            self.first[pack], rows = self.texts, np.zeros(texts, _SUM)
            self.texts += texts
        rows["key"][used] = key
        rows["lb"][used] += sums[:, 0]
        rows["lt"][used] += sums[:, 1]
        self.file.seek(self.first[pack] * _SUM.itemsize) if known else self.file.seek(0, 2)
        self.file.write(rows.tobytes())

    def rest(self) -> Iterator[pa.RecordBatch]:
        """``key, n, lb, lt`` of every text that has a loss; what has none adds nothing."""
        self.file.seek(0)
        while data := self.file.read(SUMS_ROWS * _SUM.itemsize):
            rows = np.frombuffer(data, _SUM)
            rows = rows[(rows["lb"] != 0) | (rows["lt"] != 0)]
            columns = [rows["key"], np.zeros(len(rows), np.int64), rows["lb"], rows["lt"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "n", "lb", "lt"])
        self.file.close()


def _scored_together(model: _Model, blobs: list[pa.Buffer], out: _TextSums) -> None:
    """Of all packed rows of a part: the sum of losses of each scored text in each blob, added to ``out``. Rows are unpacked in ``STEPS`` by their hashes, equal ones together."""
    heads = [np.frombuffer(blob, "<i8", _HEAD).tolist() for blob in blobs]
    texts = np.array([h[1] for h in heads])
    scored = np.repeat([bool(h[0]) for h in heads], texts)
    first = np.cumsum(texts) - texts
    sums = np.zeros((len(scored), 2))
    for step in range(STEPS):
        found: tuple[list, list] = ([], [])
        for blob, (_, n_texts, *sizes, _, _), at in zip(blobs, heads, first.tolist(), strict=True):
            place = 8 * _HEAD + 10 * n_texts
            for kind, size, rows in zip((_FREQUENT_ROW, _RARE_ROW), sizes, found, strict=True):
                x, place = _unpacked(kind, size, blob, place)
                mine = np.flatnonzero((x["g" if "g" in x else "h"] >> np.uint64(32)) % np.uint64(STEPS) == step)
                x = {name: v[mine] for name, v in x.items()}
                x["text"] += at
                rows.append(x)
        for rare, parts in enumerate(found):
            x = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
            if not len(x["n"]):
                continue
            n, own = (x["n"] & _MOST).astype(np.float64), scored[x["text"]]
            if rare:
                inner = np.where(x["n"] & _LAST, 0.0, n)
                unigrams = _sum_by((x["g"],), n, own)
                losses = n[:, None] * model.pair_losses(_sum_by((x["h"], x["g"]), n, own), unigrams)
                losses += inner[:, None] * model.context_losses(_sum_by((x["g"],), inner, own))
            else:
                losses = n[:, None] * model.pair_losses(_sum_by((x["h"], x["word"]), n, own), model.unigrams[x["word"]])
            for k in (0, 1):
                sums[:, k] += np.bincount(x["text"][own], losses[own, k], len(scored))
    for blob, (own, n_texts, _, _, pack, all_texts), at in zip(blobs, heads, first.tolist(), strict=True):
        if own:
            key, used = np.frombuffer(blob, "<i8", n_texts, 8 * _HEAD), np.frombuffer(blob, "<u2", n_texts, 8 * _HEAD + 8 * n_texts)
            out.add(pack, all_texts, used, key, sums[at : at + n_texts])


def text_losses(rows: DataFrame, target: DataFrame, frequent_words: int = FREQUENT_WORDS, frequent_pairs: int = FREQUENT_PAIRS, part_words: int = PART_WORDS) -> DataFrame:
    """Of rows ``key, text``: ``key, n, lb, lt``, words and losses of the text; copies of a text add up. ``target`` has the texts of the target."""
    counts = stored(word_counts(rows), "words")
    words = _sorted_hashes(_most(counts, "n", min(frequent_words, 1 << 16)))
    pairs = _frequent_pairs(rows, frequent_pairs)
    model = _Model(words, pairs, (_counted(rows, words, pairs), _counted(target, words, pairs)), counts.count())
    known = rows.sparkSession.sparkContext.broadcast(model)
    parts = max(1, -(-int(counts.agg(F.sum("n")).collect()[0][0] or 0) // part_words))

    def here(scored: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = TaskContext.get().partitionId() << 32
            for batch in batches:
                size = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
                lo = 0
                while lo < batch.num_rows:
                    hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PACKED_BYTES, "right"))
                    part = batch.slice(lo, min(max(hi - lo, 1), _MOST_TEXTS))
                    lo += part.num_rows
                    pack += 1
                    # what a worker has freed, it gives back
                    pa.default_memory_pool().release_unused()
                    yield from _scored_here(known.value, parts, scored, pack, part.column(0).to_numpy(zero_copy_only=False), part.column(1))

        return run

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, sums = [], -1, _TextSums()
        for batch in batches:
            done = batch.filter(batch.column(1).is_null())
            if done.num_rows:
                yield done.select(["key", "n", "lb", "lt"])
            # the rows of a part come together
            part = batch.column(0).to_numpy()
            cut, size = _part_runs(part)
            for lo, n in zip(cut, size, strict=True):
                if part[lo] != current:
                    if held:
                        _scored_together(known.value, held, sums)
                        held = []
                        pa.default_memory_pool().release_unused()
                    current = part[lo]
                held += [packed.as_buffer() for packed in batch.column(1).slice(lo, n) if packed.is_valid]  # of the batch, not copied
        if held:
            _scored_together(known.value, held, sums)
            del held
            pa.default_memory_pool().release_unused()
        yield from sums.rest()

    dealt = rows.select("key", "text").mapInArrow(here(True), _SCORED).unionByName(target.select(F.lit(0).cast("long").alias("key"), "text").mapInArrow(here(False), _SCORED))
    # a partition for each part, by its number; a task reads its partitions one after the other, without a sort
    tasks = min(parts, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    sums = dealt.repartitionById(parts, F.col("part").cast("int")).coalesce(tasks).mapInArrow(together, "key long, n long, lb double, lt double")
    return sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "lb", "lt")])


def target_texts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``text`` of every row of ``docs`` whose ``doc_id`` is in ``target``.

    A Bloom filter of the wanted ids, ``FILTER_WORDS`` words however many they are, keeps most other texts out of the join.
    """
    wanted = target.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).where("doc_id is not null").distinct()
    h = F.xxhash64("doc_id")
    bits = wanted.select(F.pmod(h, F.lit(FILTER_WORDS)).alias("word"), F.shiftrightunsigned(h, 58).cast("int").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            hit = words[h % FILTER_WORDS] >> (h.view(np.uint64) >> np.uint64(58)) & np.uint64(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(hit.astype(bool)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select(h.alias("h"), "doc_id", "text").mapInArrow(passed, f"doc_id {kind}, text string")
    return stored(rows.join(wanted, "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text")), "target-texts")


def score(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, loss_difference`` of every row (losses are means in nats; lower difference: more like the target)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    sums = text_losses(rows, target_texts(docs, target), **options)
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    means = sums.select("key", mean("lb").alias("lb"), mean("lt").alias("lt"))
    every = docs.select("doc_id", F.xxhash64(text).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_tokens")).join(means, "key", "left")
    return every.select("doc_id", "n_tokens", F.col("lt").alias("target_loss"), F.col("lb").alias("background_loss"), (F.col("lt") - F.col("lb")).alias("loss_difference"))
