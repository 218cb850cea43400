"""Removal of passages that a bounded reference holds, by broadcast suffix automata of its shards.

For references of a known, small size (license texts, boilerplate, benchmark
passages). The reference is cut into shards of whole texts; each becomes a
suffix automaton over words. Documents are streamed through all of them: the
matching statistic of a word is the length of the longest run of words ending
there that the shard holds, and every word of a run of ``width`` or more is
removed. A reference of more than ``MAX_WORDS`` words is refused, as its
automata would have to be sent to every executor; deal it out with
:mod:`substring_dedup` instead.

Defined cases: null and empty texts have no words on either side; repeated rows
are judged one by one; an empty reference removes nothing; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliframe.llm.common import words

WIDTH = 35
SHARD_WORDS, MAX_WORDS = 100_000, 1_000_000


class Automaton:
    """Suffix automaton of several word sequences; no match runs from one into the next."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def matching_statistics(self, text: list[str]) -> Iterator[int]:
        """For each word, how many words ending there the automaton's texts hold in a row."""
        state = size = 0
        for word in text:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            yield size


def remove_reference(docs: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row; ``reference`` has a column ``text``."""
    tokens = reference.select(words(F.col("text")).alias("w"))
    size = tokens.agg(F.sum(F.size("w"))).collect()[0][0] or 0
    if size > MAX_WORDS:
        raise ValueError(f"the reference has {size} words, more than the {MAX_WORDS} that are broadcast; deal it out instead")
    shards: list[list[list[str]]] = [[]]
    held = 0
    for row in tokens.collect():
        if held and held + len(row["w"]) > SHARD_WORDS:
            shards.append([])
            held = 0
        shards[-1].append(row["w"])
        held += len(row["w"])
    automata = docs.sparkSession.sparkContext.broadcast([Automaton(s) for s in shards])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text in batch.column(1):
                found = [w.decode() for w in text.as_buffer().to_pybytes().split()] if text.is_valid else []
                gone = [False] * len(found)
                for automaton in automata.value:
                    free = 0
                    for i, size in enumerate(automaton.matching_statistics(found)):
                        if size >= width:
                            for k in range(max(free, i - size + 1), i + 1):
                                gone[k] = True
                            free = i + 1
                n_words.append(len(found))
                n_removed.append(sum(gone))
                kept.append(" ".join(w for w, g in zip(found, gone, strict=True) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
