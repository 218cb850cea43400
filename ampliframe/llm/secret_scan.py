"""Secret scan with a randomness test battery (native).

Three kinds of spans come from patterns (assignments, access keys, long
hexadecimal runs). The battery adds spans of kind ``random``: tokens of 20 or
more characters whose inferred encoding (hexadecimal, base 32, base 64) they
fill like random text. Three tests judge a token against uniform randomness
over its encoding's alphabet: chi-squared of the symbol counts, runs above and
below the alphabet's middle, and lag-1 serial correlation of the codes; the
smallest p-value, times three, is the token's. Within each band of lengths the
Benjamini-Hochberg procedure over the tokens of all documents limits the share
of random tokens among those called structured; what it doesn't call
structured is taken as a secret.

p-values are compared on a grid of -log10 p, so that the procedure needs counts
by band and grid cell only (at most ``len(BANDS) * (GRID_MAX + 1)`` rows reach
the driver).

Positions are code points, ends exclusive. Defined cases: a null text is
empty; an empty one has no spans and the hash of the empty string; repeated
rows are scanned one by one; an empty table gives an empty result; a text of
any length is scanned whole, in time that grows a little faster than its
length (a token of a million symbols takes seconds); further columns are
ignored by :func:`scan` and kept, whatever their names, by :func:`redact`.
Ties: spans with equal starts are in the order of their kinds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliframe.llm.common import bind, durable, free_names, scanned, stored

# The patterns of the three base kinds, in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED = 6

#: ``=`` only as padding, so that the value of ``NAME=value`` is a token of its own.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}=*"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the first pattern that fits; each must mix digits and letters.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
#: Lower ends of the length bands.
BANDS = (20, 28, 36, 48, 72)
FALSE_DISCOVERY_RATE = 0.05
GRID_STEP, GRID_MAX = 0.05, 400
PLACEHOLDER = "[SECRET]"

_SPAN = "array<struct<s:int,k:int,e:int>>"


def _matches(text: Column, pattern: str, item: Callable[[Column, Column, Column], Column], kind: str, group: int | None = None) -> Column:
    """``item(start, match, group)`` of all non-overlapping matches: what lies between two matches is what splitting leaves."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern), lambda x: F.length(x)).alias("gap"),
        found.alias("match"),
        groups.alias("group"),
    )
    # the last gap has no match
    matched = bind(parts, lambda x: F.slice(x, F.lit(1), F.size(x) - 1))
    scan = scanned(
        matched,
        F.lit(0),
        kind,
        lambda at, x: at + x["gap"] + F.length(x["match"]),
        lambda at, x: item(at + x["gap"], x["match"], x["group"]),
    )
    return F.when(text.rlike(pattern), scan).otherwise(F.array().cast(f"array<{kind}>"))


def _span(kind: int):
    return lambda start, match, _: F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + F.length(match)).alias("e"))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start and kind."""
    assigned = _matches(
        text,
        ASSIGN,
        lambda start, match, group: F.struct(
            start.alias("s"), F.when(F.length(group) >= MIN_ASSIGNED, 0).otherwise(-1).alias("k"), (start + F.length(match)).alias("e")
        ),
        "struct<s:int,k:int,e:int>",
        2,
    )
    assigned = F.filter(assigned, lambda x: x["k"] == 0)
    kind = "struct<s:int,k:int,e:int>"
    return F.sort_array(F.concat(assigned, _matches(text, ACCESS, _span(1), kind), _matches(text, HEX, _span(2), kind)))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _tests(t: Column, alphabet: Column) -> Column:
    """Of a bound token without padding: three times the least p-value of the tests."""
    symbol = lambda i: F.substring(alphabet, i + 1, F.lit(1))
    squares = F.aggregate(
        F.sequence(F.lit(0), F.length(alphabet) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.pow((F.length(t) - F.length(F.replace(t, symbol(i), F.lit("")))).cast("double"), 2),
    )
    half = F.length(alphabet) / 2

    def step(acc: Column, c: Column) -> Column:
        code = (F.instr(alphabet, c) - 1).cast("double")
        high = F.when(code >= half, 1.0).otherwise(0.0)
        start = acc["n"] == 0
        return bind(
            F.struct(code.alias("x"), high.alias("high")),
            lambda v: F.struct(
                (acc["n"] + 1).alias("n"),
                F.when(start, v["x"]).otherwise(acc["first"]).alias("first"),
                v["x"].alias("last"),
                (acc["sum"] + v["x"]).alias("sum"),
                (acc["squares"] + v["x"] * v["x"]).alias("squares"),
                (acc["lagged"] + F.when(start, 0.0).otherwise(acc["last"] * v["x"])).alias("lagged"),
                (acc["high"] + v["high"]).alias("high"),
                v["high"].alias("side"),
                (acc["runs"] + F.when(start | (acc["side"] != v["high"]), 1.0).otherwise(0.0)).alias("runs"),
            ),
        )

    names = ("n", "first", "last", "sum", "squares", "lagged", "high", "side", "runs")
    zero = F.struct(*[F.lit(0.0).alias(x) for x in names])
    symbols = F.filter(F.split(t, ""), lambda c: c != "")
    sums = F.aggregate(symbols, zero, step)

    def judged(v: Column) -> Column:
        n, a = v["s"]["n"], F.length(alphabet).cast("double")
        chi, df = v["q"] * a / n - n, a - 1
        p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        mean = 2 * v["s"]["high"] * (n - v["s"]["high"]) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(var <= 0, 0.0).otherwise(2 * _upper_tail(F.abs(v["s"]["runs"] - mean) / F.sqrt(var)))
        m = v["s"]["sum"] / n
        spread = v["s"]["squares"] - n * m * m
        lagged = v["s"]["lagged"] - m * (2 * v["s"]["sum"] - v["s"]["first"] - v["s"]["last"]) + (n - 1) * m * m
        p_serial = F.when(spread <= 1e-9, 0.0).otherwise(2 * _upper_tail(F.abs(lagged / spread + 1 / n) * F.sqrt(n)))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    return bind(F.struct(sums.alias("s"), squares.alias("q")), judged)


def battery(token: Column, alphabet: Column) -> Column:
    """p-value of a token against uniform randomness over its alphabet: three times the least of three tests. Linear in the token's length."""
    return bind(F.struct(F.rtrim(token, F.lit("=")).alias("t"), alphabet.alias("a")), lambda x: _tests(x["t"], x["a"]))


def candidates(text: Column) -> Column:
    """Tokens in a known encoding: start, end, length band, and grid cell of -log10 p."""

    def alphabet(match: Column) -> Column:
        a = F
        for pattern, symbols in ENCODINGS:
            a = a.when(match.rlike(pattern), F.lit(symbols))
        return a.otherwise(F.lit(""))

    tokens = _matches(
        text, CANDIDATE, lambda start, match, _: F.struct(start.alias("s"), match.alias("t")), "struct<s:int,t:string>"
    )
    fitting = F.filter(tokens, lambda x: alphabet(x["t"]) != "")

    def judged(x: Column) -> Column:
        n = F.length(x["t"])
        band = sum((F.when(n >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
        p = bind(alphabet(x["t"]), lambda a: battery(x["t"], a))
        cell = F.least(F.lit(GRID_MAX), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) / GRID_STEP)).cast("int")
        return F.struct(x["s"].alias("s"), (x["s"] + n).alias("e"), band.alias("band"), cell.alias("cell"))

    return F.when(text.rlike(CANDIDATE), F.transform(fitting, judged)).otherwise(F.array().cast("array<struct<s:int,e:int,band:int,cell:int>>"))


def structured_from(found: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> list[int]:
    """By length band, the first grid cell that the Benjamini-Hochberg procedure calls structured (beyond the grid: none).

    ``found`` has a column ``candidates``. The p-value of a cell is its upper end, so rounding keeps more tokens as secrets.
    """
    counts = (
        found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.band").alias("band"), F.col("c.cell").alias("cell")).count().collect()
    )
    first = []
    for band in range(len(BANDS)):
        by_cell = {r["cell"]: r["count"] for r in counts if r["band"] == band}
        total, seen, start = sum(by_cell.values()), 0, GRID_MAX + 1
        for cell in sorted(by_cell, reverse=True):
            seen += by_cell[cell]
            if 10 ** (-cell * GRID_STEP) <= rate * seen / total:
                start = cell
        first.append(start)
    return first


def all_spans(base: Column, found: Column, structured: list[int]) -> Column:
    """Base spans and those the battery adds, sorted; a token that touches a base span adds nothing."""
    limit = F.array(*[F.lit(x) for x in structured])
    random = F.filter(found, lambda x: x["cell"] < F.get(limit, x["band"]))
    kind = "struct<s:int,k:int,e:int>"
    as_span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

    def free(both: Column) -> Column:
        # from the left, the end of what base spans have covered; from the right, where the next base span begins
        behind = scanned(
            both,
            F.lit(0),
            kind,
            lambda end, x: F.when(x["k"] < 3, F.greatest(end, x["e"])).otherwise(end),
            lambda end, x: F.struct(x["s"].alias("s"), F.when((x["k"] == 3) & (x["s"] < end), 4).otherwise(x["k"]).alias("k"), x["e"].alias("e")),
        )
        ahead = scanned(
            F.reverse(behind),
            F.lit((1 << 31) - 1),
            kind,
            lambda begin, x: F.when(x["k"] < 3, F.least(begin, x["s"])).otherwise(begin),
            lambda begin, x: F.struct(x["s"].alias("s"), F.when((x["k"] == 3) & (begin < x["e"]), 4).otherwise(x["k"]).alias("k"), x["e"].alias("e")),
        )
        return F.sort_array(F.filter(ahead, lambda x: x["k"] < 4))

    tokens = F.transform(random, as_span(3))
    return F.when(F.size(random) == 0, base).otherwise(free(F.sort_array(F.concat(base, tokens))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = durable(docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("candidates")))
    structured = structured_from(found)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(all_spans(F.col("base"), F.col("candidates"), structured)).alias("spans"),
    )


def redacted_text(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by a placeholder; overlapping spans share one."""
    kind = "struct<at:int,s:int,first:boolean>"

    def written(symbols: Column) -> Column:
        before = scanned(
            spans,
            F.lit(0),
            kind,
            lambda at, x: F.greatest(at, x["e"]),
            lambda at, x: F.struct(at.alias("at"), x["s"].alias("s"), (x["s"] >= at).alias("first")),
        )
        pieces = F.transform(
            F.filter(before, lambda x: x["first"]),
            lambda x: F.concat(F.array_join(F.slice(symbols, x["at"] + 1, x["s"] - x["at"]), ""), F.lit(PLACEHOLDER)),
        )
        end = F.aggregate(spans, F.lit(0), lambda at, x: F.greatest(at, x["e"]))
        tail = bind(end, lambda at: F.array_join(F.slice(symbols, at + 1, F.size(symbols)), ""))
        return F.concat(F.array_join(pieces, ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(bind(F.split(text, ""), written))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` brought up to date; other columns and rows unchanged."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, found, spans, new = free_names(docs.columns, "base", "candidates", "spans", "redacted")
    # the texts are scanned once: the false-discovery control needs all of them before any is redacted
    scanned_docs = stored(docs.withColumns({base: base_spans(text), found: candidates(text)}), "scanned")
    structured = structured_from(scanned_docs.select(F.col(found).alias("candidates")))
    judged = scanned_docs.withColumn(spans, all_spans(F.col(base), F.col(found), structured))
    changed = judged.withColumn(new, bind(F.col(spans), lambda s: F.when(F.size(s) > 0, redacted_text(text, s))))
    out = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return changed.withColumns(out).select(*[F.col(f"`{c}`") for c in docs.columns])
