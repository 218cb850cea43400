"""Quality rules as a short-circuit cascade (native).

Every rule is a column that is true where a document fails. Some need no more
than counts of words and symbols, others read every line or character of the
text. Cost and selectivity of each rule are measured on a sample, and the rules
are ordered by rejections per cost; the cascade stops at the first failing rule
of a document, and a document that fails a base rule runs none of them. The
order changes the work, never the verdict.

Defined cases: a null text has no words and fails the word count; ties and
repeated rows are judged alike, row by row; an empty table gives an empty
result; other columns pass through :func:`passing` and are ignored by
:func:`judged`; texts of any length are judged whole.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliframe.llm.common import bind, stored, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 25
MAX_DUP_LINE_PERCENT = 60
MIN_LETTER_WORD_PERCENT = 50
MAX_DIGIT_PERCENT = 30
MAX_UPPER_PERCENT = 60
MAX_ELLIPSIS_PERCENT, MAX_BULLET_PERCENT = 40, 90
MIN_LINES = 3
#: Rows of the sample, about, on which cost and selectivity are measured.
SAMPLE_ROWS = 400


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in ``tokens``, first finding included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. A text without repeated windows costs
    one distinct count; otherwise one sort of (hash, position).
    """
    n = F.size(tokens)
    grams = bind(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])),
    )

    def positions(sorted_pairs: Column) -> Column:
        last = F.size(sorted_pairs) - 1
        same = lambda i, x: F.get(sorted_pairs, i)["h"] == x["h"]
        hit = F.filter(sorted_pairs, lambda x, i: ((i > 0) & same(i - 1, x)) | ((i < last) & same(i + 1, x)))
        return F.sort_array(F.transform(hit, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window))),
            F.lit(window),
            lambda total, step: total + step,
        )

    def count(g: Column) -> Column:
        pairs = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            bind(F.sort_array(pairs), lambda s: bind(positions(s), covered))
        )

    return F.when(n < window + 1, F.lit(0)).otherwise(bind(grams, count)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bind(
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
    ).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    tokens = F.col("_tokens")
    return (
        docs.withColumn("_tokens", words(F.col("text")))
        .withColumn("n_words", F.size(tokens).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(tokens, "")).cast("long"))
        .withColumn("n_symbols", symbols(F.col("text")))
        .withColumn("n_dup_lines", duplicate_lines(F.col("text")))
        .withColumn("n_repeat_words", repeated_words(tokens))
        .drop("_tokens")
    )


def base_rules() -> dict[str, Column]:
    """Over the columns of :func:`statistics`."""
    return {
        "too_few_words": F.col("n_words") < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    }


def lines_like(text: Column, pattern: str, percent: int) -> Column:
    """Whether more than ``percent`` of at least ``MIN_LINES`` lines with a word match."""
    return bind(
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda lines: (F.size(lines) >= MIN_LINES) & (100 * F.size(F.filter(lines, lambda line: line.rlike(pattern))) > percent * F.size(lines)),
    )


def costly_rules() -> dict[str, Column]:
    """Rules that read every word, line or character of ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    share = lambda pattern, percent: bind(count(r"[^\x20\x09-\x0D]"), lambda n: 100 * count(pattern) > percent * n)
    return {
        "words_without_letters": bind(words(text), lambda w: 100 * F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) < MIN_LETTER_WORD_PERCENT * F.size(w)),
        "digits": share(r"[0-9]", MAX_DIGIT_PERCENT),
        "upper_case": share(r"[A-Z]", MAX_UPPER_PERCENT),
        "broken_lines": lines_like(text, r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$", MAX_ELLIPSIS_PERCENT),
        "bullets": lines_like(text, r"^[\x20\x09-\x0D]*[-*\x{2022}]", MAX_BULLET_PERCENT),
    }


def rules_of_statistics() -> dict[str, Column]:
    """Over the columns of :func:`statistics` and the text."""
    return {
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "word_length": (F.col("word_chars") < MIN_WORD_CHARS * F.col("n_words")) | (F.col("word_chars") > MAX_WORD_CHARS * F.col("n_words")),
        "duplicate_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")),
    } | costly_rules()


def rules_of_text() -> dict[str, Column]:
    """All rules, each from the text alone, so that a cascade computes only what it needs."""
    text = F.col("text")
    n = lambda w: F.size(w)
    on_words = lambda f: bind(words(text), f)
    return {
        "too_few_words": on_words(lambda w: n(w) < MIN_WORDS),
        "repeated_words": on_words(lambda w: 100 * repeated_words(w) > MAX_REPEAT_PERCENT * n(w)),
        "symbols": 100 * symbols(text) > MAX_SYMBOL_PERCENT * F.size(words(text)),
        "word_length": on_words(
            lambda w: bind(F.length(F.array_join(w, "")), lambda c: (c < MIN_WORD_CHARS * n(w)) | (c > MAX_WORD_CHARS * n(w)))
        ),
        "duplicate_lines": 100 * duplicate_lines(text) > MAX_DUP_LINE_PERCENT * F.size(F.split(F.coalesce(text, F.lit("")), "\n")),
    } | costly_rules()


def rule_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` random rows of ``docs``, in a table of one part; no text reaches the driver."""
    total = docs.count()
    part = docs if total <= rows else docs.sample(fraction=rows / total, seed=7)
    return stored(part.coalesce(1), "rule-sample")


def rank_rules(sample: DataFrame, rules: Mapping[str, Column]) -> list[str]:
    """Names of ``rules`` by rejections per second over the rows of ``sample``, best first."""
    gain = {}
    for name, failed in rules.items():
        job = sample.agg(F.count_if(failed).alias("n"))
        job.collect()  # compiles
        began = time.perf_counter()
        rejected = job.collect()[0]["n"]
        gain[name] = (rejected + 1) / max(time.perf_counter() - began, 1e-4)
    return sorted(gain, key=lambda name: (-gain[name], name))


def first_failure(rules: Mapping[str, Column], order: list[str]) -> Column:
    """Name of the first failing rule in ``order``, else null; later rules are not evaluated."""
    cascade = F
    for name in order:
        cascade = cascade.when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return cascade.otherwise(F.lit(None).cast("string"))


def passing(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    rules = rules_of_text()
    return docs.where(first_failure(rules, rank_rules(rule_sample(docs.select("text")), rules)).isNull())


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of every document.

    The statistics are wanted of every document, so the cascade begins behind the base rules, with what reads the text again ranked among what doesn't.
    """
    rules = rules_of_statistics()
    order = rank_rules(stored(statistics(rule_sample(docs.select("text"))), "rule-sample"), rules)
    stats = statistics(docs.select("doc_id", "text"))
    base_failed = F.coalesce(base_rules()["too_few_words"] | base_rules()["repeated_words"], F.lit(False))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        F.when(base_failed, False).otherwise(first_failure(rules, order).isNull()).alias("kept"),
    )
