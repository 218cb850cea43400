"""Matching statistics and removal against plain search."""

import random

import brute
import pytest

from ampliframe.llm import suffix_automaton as sa


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(5)]
    automaton = sa.Automaton(texts)
    held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    probe = [rng.choice("abcd") for _ in range(80)]
    want = [max([0, *(n for n in range(1, i + 2) if tuple(probe[i + 1 - n : i + 1]) in held)]) for i in range(len(probe))]
    assert list(automaton.matching_statistics(probe)) == want


def test_removal(spark, monkeypatch):
    rng = random.Random(2)
    refs = [" ".join(rng.choice("abcde") for _ in range(40)) for _ in range(6)] + [None, ""]
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(20)) + " " + (refs[i % 6][10:50] if i % 2 else "") + " z z") for i in range(20)] + [(20, None), (21, "")]
    monkeypatch.setattr(sa, "SHARD_WORDS", 90)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    reference = spark.createDataFrame([(r,) for r in refs], "text string")
    windows = {tuple(w[i : i + 8]) for w in map(brute.words, refs) for i in range(len(w) - 7)}
    for r in sa.remove_reference(df, reference, 8).collect():
        w = brute.words(docs[r["doc_id"]][1])
        gone = {i + k for i in range(len(w) - 7) if tuple(w[i : i + 8]) in windows for k in range(8)}
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    assert sa.remove_reference(df, reference.where("false"), 8).where("n_removed > 0").count() == 0
    monkeypatch.setattr(sa, "MAX_WORDS", 10)
    with pytest.raises(ValueError, match="deal it out"):
        sa.remove_reference(df, reference)
