"""URL filter: rules by host and path, and a logistic regression for the rest.

The regression is over hashed character n-grams of host and path and is
trained on the driver from a small labelled table of URLs (at most
``MAX_LABELLED`` rows are read, a bound on the fit alone). Every URL is scored.

Defined cases: a null url, or one without ``://``, has an empty host and an
empty path, fits no rule and gets the model's verdict on them; repeated rows
give equal rows; an empty table gives an empty result; an URL of any length is
scored whole.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules, each with the verdict it gives.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

BUCKETS = 1 << 13
GRAMS = (3, 4, 5)
MAX_LABELLED = 20_000
RIDGE, STEPS, RATE = 1e-4, 600, 4.0

# Words of unwanted and of ordinary hosts for the labelled table.
UNWANTED = "casino-win free-bets cheap-pills adult-x ads-track spam-farm poker slots jackpot viagra loans-fast xxx porn sexcam click-ads popunder tracker warez crack-keys replica-watch".split()
ORDINARY = "news library garden school wiki science museum recipes travel weather history music forum university parks books health-info city-council open-data radio".split()
SYLLABLES = "th er in on an re ti es ed st ing tion ble ou ly wh".split()
UNWANTED_PATHS = "bonus spin win-now buy-pills track click.php free-xxx".split()
PATH_ENDS = ("", "/", ".html")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of an URL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F, F
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(says))
    return rule.otherwise(F.lit(None).cast("string")), verdict.otherwise(F.lit(None).cast("string"))


@functools.lru_cache(maxsize=1 << 14)
def gram_buckets(kind: str, text: str) -> tuple[int, ...]:
    """Distinct hash buckets of a text's character n-grams; host and path have features of their own."""
    marked = f"^{text}$"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return tuple(sorted({zlib.crc32(f"{kind}{g}".encode()) % BUCKETS for g in grams}))


def python_split(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def default_labels() -> list[tuple[str, int]]:
    """The small labelled table: 1 for unwanted hosts and paths, made from the word lists by rule.

    Article paths (language and number) occur with both labels alike, so they don't decide.
    """
    rows = [("", 0)] * 12  # without a host there is nothing to hold against an URL
    syllables = ["".join(p) for p in itertools.product(SYLLABLES, repeat=2)]
    article = lambda k: f"{('en', 'de', 'fr', 'es')[k % 4]}/{(k * 7919) % 10 ** (1 + k % 5)}{PATH_ENDS[k % 3]}"
    places = list(itertools.product(("", "www.", "m.", "blog."), ("com", "net", "org")))
    for i, (prefix, tld) in enumerate(places):
        for j, word in enumerate(UNWANTED):
            rows.append((f"http://{prefix}{word}.example.{tld}/{article(31 * i + j)}", 1))
        for j, word in enumerate(ORDINARY + syllables[i % 3 :: 3]):
            rows.append((f"https://{prefix}{word}.example.{tld}/{article(31 * i + j)}", 0))
        for j, path in enumerate(UNWANTED_PATHS):
            rows.append((f"http://{prefix}{ORDINARY[(i + j) % len(ORDINARY)]}.example.{tld}/{path}", 1))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_labels(), "url string, label int")


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias, by gradient descent from zero on all labelled rows (``max_rows`` of them at most)."""
    rows = labelled.where("label is not null").orderBy("url", "label").limit(max_rows).collect()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    y = np.array([r["label"] for r in rows], np.float32)
    for i, r in enumerate(rows):
        host, path = python_split(r["url"])
        x[i, list(gram_buckets("h", host))] = 1 / np.sqrt(len(gram_buckets("h", host)) or 1)
        x[i, list(gram_buckets("p", path))] += 1 / np.sqrt(len(gram_buckets("p", path)) or 1)
    w, b = np.zeros(BUCKETS, np.float32), 0.0
    for _ in range(STEPS if len(rows) else 0):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / max(len(rows), 1)
        w -= RATE * (x.T @ error + RIDGE * w)
        b -= RATE * float(error.sum())
    return w, b


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; ``score`` is the model's probability of an unwanted URL."""
    weights, bias = fit(labelled if labelled is not None else labelled_table(pages.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=1 << 14)
        def part(kind: str, text: str) -> float:
            buckets = gram_buckets(kind, text)
            return float(weights[list(buckets)].sum() / np.sqrt(len(buckets))) if buckets else 0.0

        for batch in batches:
            score = [1 / (1 + np.exp(-(part("h", h) + part("p", p) + bias))) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    own = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
