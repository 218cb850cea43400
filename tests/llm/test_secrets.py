"""The secret scan against plain versions, and on long tokens and many matches."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from ampliframe.llm import secret_scan

B64 = secret_scan.ENCODINGS[3][1]


def test_battery_equals_its_formulas(spark):
    rng = random.Random(41)
    rows = []
    for k, (_, alphabet) in enumerate(secret_scan.ENCODINGS):
        for n in (20, 33, 64, 200):
            rows.append(("".join(rng.choices(alphabet, k=n)) + "=" * (k == 3), alphabet))
            rows.append(((alphabet[:7] * n)[:n], alphabet))
        rows.append((alphabet[0] * 30, alphabet))
    df = spark.createDataFrame(rows, "t string, a string")
    for r in df.select("t", "a", secret_scan.battery(F.col("t"), F.col("a")).alias("p")).collect():
        assert r["p"] == pytest.approx(brute.battery(r["t"], r["a"]), abs=2e-6)


def test_long_tokens_and_many_matches_take_seconds(spark):
    rng = random.Random(42)
    texts = [
        "".join(rng.choices(B64, k=1_000_000)),
        "token=abcdef1 é\U0001f600 " * 100_000,
        " ".join("".join(rng.choices(B64, k=40)) + " token=abcdefg" for _ in range(5_000)),
        " ".join(["x"] * 200_000),
    ]
    began = time.time()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.scan(df).orderBy("doc_id").collect()
    assert time.time() - began < 120
    for r, t in zip(rows, texts, strict=True):
        base = brute.secret_spans(t)
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == [x for x in brute.listed(base).split(",") if x]
    assert rows[0]["spans"] == "random:0:1000000"
    assert rows[2]["spans"].count("random") > 4_500


def test_redaction_equals_the_plain_one(spark):
    rng = random.Random(43)
    parts = ["token=abcdef1", "é", "AKIA" + "B" * 20, "0123456789abcdef" * 2, "plain words", "\U0001f600", "secret: password=abcdef99", "".join(rng.choices(B64, k=44)), "=", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "own", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, _base string, n_chars int")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df).collect()}
    out = secret_scan.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        own = [tuple(x.split(":")) for x in spans[r["doc_id"]].split(",") if x]
        want = brute.redacted(texts[r["doc_id"]], [(int(s), k, int(e)) for k, s, e in own])
        assert r["text"] == want and r["n_chars"] == len(want) and r["_base"] == "own"
        taken = [(int(s), int(e)) for k, s, e in own if k != "random"]
        assert all(e <= s2 or e2 <= s for s, e in ((int(s), int(e)) for k, s, e in own if k == "random") for s2, e2 in taken)
