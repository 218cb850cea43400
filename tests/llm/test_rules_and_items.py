"""Quality rules and benchmark search against plain versions."""

import random
import re

import brute
import numpy as np
from pyspark.sql import functions as F

from ampliframe.llm import decontaminate, quality, tokens


def plain_failures(t):
    t = t or ""
    w = brute.words(t)
    lines = [x for x in t.split("\n") if brute.words(x)]
    signs = len(re.findall(r"[^\x20\x09-\x0D]", t))
    out = set()
    if 100 * sum(any(c.isalpha() for c in x) for x in w) < 50 * len(w):
        out.add("words_without_letters")
    if 100 * len(re.findall("[0-9]", t)) > 30 * signs:
        out.add("digits")
    if 100 * len(re.findall("[A-Z]", t)) > 60 * signs:
        out.add("upper_case")
    if len(lines) >= 3 and 100 * sum(x.rstrip(" \t\r\x0b\x0c").endswith(("...", "…")) for x in lines) > 40 * len(lines):
        out.add("broken_lines")
    if len(lines) >= 3 and 100 * sum(x.lstrip(" \t\r\x0b\x0c")[0] in "-*•" for x in lines) > 90 * len(lines):
        out.add("bullets")
    return out


def test_costly_rules_equal_plain_ones(spark):
    rng = random.Random(51)
    parts = ["word", "Other", "ABC", "123", "...", "…", "\n- ", "\n* ", "\n• ", "...\n", "x…  \n", "\n", " ", "--", "é"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)] + ["- a\n* b\n• c", "x...\ny...\nz", "A" * 200_000, None, "", "1 2 3 " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = quality.costly_rules()
    got = df.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()]).collect()
    for r in got:
        assert {n for n in rules if r[n]} == plain_failures(texts[r["doc_id"]])


def test_short_and_repeated_items(spark):
    rng = random.Random(52)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(30)]
    texts[3] += " One,  Two three"
    texts[4] = "one, two three " + texts[4]
    texts[5] += " one, two 3three"
    texts[6] += " SINGLE"
    texts[7] = "one, two"
    texts[8] = "three"
    item = " ".join(word() for _ in range(25))
    texts[9] += " " + item
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").withColumn("_key", F.lit("own")).repartition(3)
    rows = [(1.5, "one, two THREE"), (2.5, "single"), (2.5, "single"), (3.5, item), (4.5, item), (None, ""), (5.5, None)]
    bench = spark.createDataFrame(rows, "item_id double, text string")
    for block in (decontaminate.ITEM_BLOCK, 2):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench, block).collect())
        assert got == [(3, 1.5), (3, 1.5), (4, 1.5), (6, 2.5), (9, 3.5), (9, 4.5)]
    left = decontaminate.uncontaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(30)) - {3, 4, 6, 9}


def test_recall_of_the_cosine_search(spark):
    """Of all pairs of an item and a document that the exact checks confirm, nearly all are candidates."""
    rng = random.Random(53)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randint(15, 60)) for _ in range(60)]
    texts, planted = [], set()
    for d in range(240):
        w = prose(rng.randint(60, 400))
        if d % 2:
            i = rng.randrange(len(items))
            own = list(items[i])
            for _ in range(rng.randrange(1 + len(own) // 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            at = rng.randrange(len(w))
            w[at:at] = own
            planted.add((d, i))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    wanted = set()
    for i, item in enumerate(items):
        masks: dict[str, int] = {}
        for k, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << k
        for d, t in enumerate(texts):
            w = t.split()
            if any(decontaminate.common_subsequence(masks, len(item), w[lo : lo + len(item) + 8]) >= 0.8 * len(item) for lo in range(0, len(w), 4)):
                wanted.add((d, i))
    assert len(wanted) >= 100 and found <= planted
    assert len(found & wanted) >= 0.9 * len(wanted)


def dense_rows(texts, idf, words):
    """TF-IDF rows of consecutive passages of texts, one after the other."""
    rows = []
    for t in texts:
        w = np.array([h & 0xFFFF for x in brute.words(t or "") for h in word_number(x)], np.int64)
        for lo in range(0, len(w), words):
            part = w[lo : lo + words]
            v = np.bincount(part, minlength=decontaminate.FEATURES) * idf
            rows.append(v / max(np.linalg.norm(v), 1e-9) * min(1.0, len(part) / decontaminate.PASSAGE if words == decontaminate.PASSAGE else 1.0) ** 0.5)
    return np.array(rows)


def word_number(word):
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return tokens.word_hashes(data, np.array([0]), np.array([len(data)])).tolist()


def test_axes_are_fitted_to_all_passages_and_items(spark):
    """Few long documents: the axes hold nearly the most that as many axes can of all passages, not of one of each document."""
    rng = random.Random(54)
    topics = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(12)] for _ in range(40)]
    texts = [" ".join(rng.choice(topics[(7 * d + p // 2) % 40]) for p in range(80) for _ in range(48)) + " the end" for d in range(4)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(rng.choice(topics[i]) for _ in range(30))) for i in range(5)], "item_id long, text string")
    counts, blocks = decontaminate.passage_frequencies(docs)[:2]
    idf = np.log((1 + blocks) / (1 + counts))
    a = dense_rows(texts, idf, decontaminate.PASSAGE)
    assert len(a) == 4 * 81
    for items in (bench.where("false"), bench):
        axes = decontaminate.latent_axes(docs, blocks, items, idf)
        used = axes[:, np.linalg.norm(axes, axis=0) > 0]
        assert np.allclose(used.T @ used, np.eye(used.shape[1]), atol=1e-4)
    axes = decontaminate.latent_axes(docs, blocks, bench.where("false"), idf)
    most = np.sort(np.linalg.eigvalsh(a @ a.T))[::-1][: decontaminate.RANK].sum()
    assert np.linalg.norm(a @ axes) ** 2 >= 0.9 * most
    assert not decontaminate.latent_axes(docs.where("false"), 0, bench.where("false"), idf).any()


def test_every_item_takes_part_in_the_axes(spark, monkeypatch):
    """Items with words of their own, more than a block of them: the axes know the words of all."""
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 4)
    rng = random.Random(55)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    docs = spark.createDataFrame([(i, " ".join(["same", "old"] * 20)) for i in range(6)], "doc_id long, text string")
    items = [" ".join(word() for _ in range(20)) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    counts, blocks = decontaminate.passage_frequencies(docs)[:2]
    idf = np.log((1 + blocks) / (1 + counts))
    axes = decontaminate.latent_axes(docs, blocks, bench, idf)
    known = np.linalg.norm(dense_rows(items, idf, 1 << 20) @ axes, axis=1)
    assert known.min() > 0.95


def test_block_sums_equal_plain_ones():
    rng = np.random.default_rng(56)
    table = decontaminate._with_zero(rng.standard_normal((50, 7)))
    heads = np.flatnonzero(np.concatenate([[True], rng.random(39_999) < 0.1]))
    feature = rng.integers(0, 50, 40_000)
    assert len(heads) > decontaminate._ROWS
    plain = np.add.reduceat(table[feature].astype(np.float64), heads, axis=0)
    assert np.allclose(decontaminate._block_sums(table, feature, heads), plain, atol=1e-4)
    assert decontaminate._block_sums(table, feature[:0], heads[:0]).shape == (0, 7)


def test_the_pipeline_finds_items_that_no_sample_holds(spark, monkeypatch, tmp_path):
    """Long documents with an item each, more items than a block: the pipeline's stage lets none of them pass."""
    import corpus_pipeline

    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 4)
    rng = random.Random(57)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    items = [" ".join(word() for _ in range(48)) for _ in range(12)]
    common = [word() for _ in range(30)]
    filler = lambda: " ".join(rng.choice(common) for _ in range(1000))
    rows = [(i, f"{filler()} {items[i]} {filler()}" if i < 12 else filler()) for i in range(20)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(12, 20))
