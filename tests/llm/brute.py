"""Plain single-process versions of the corpus operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ("assign", "access", "hex", "random")


def words(text):
    return WORD.findall(text or "")


def secret_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def removed(docs, width):
    """(n_words, n_removed, kept_sha256) of each text in a list."""
    tokens = [words(t) for t in docs]
    seen = collections.Counter(tuple(w[i : i + width]) for w in tokens for i in range(len(w) - width + 1))
    out = []
    for w in tokens:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    """Smallest id reachable from each, over all pairs for which ``linked`` holds."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def upper_tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def battery(token, alphabet):
    """Three times the least p-value of chi-squared, runs and lag-1 serial correlation, by their formulas."""
    codes = [alphabet.index(c) for c in token.rstrip("=")]
    n, a = len(codes), len(alphabet)
    chi = sum((codes.count(i) - n / a) ** 2 / (n / a) for i in range(a))
    spread = 2 / (9 * (a - 1))
    p = [upper_tail(((chi / (a - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread))]
    high = [2 * c >= a for c in codes]
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * sum(high) * (n - sum(high)) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p.append(0 if var <= 0 else 2 * upper_tail(abs(runs - mean) / math.sqrt(var)))
    m = sum(codes) / n
    squares = sum((c - m) ** 2 for c in codes)
    lagged = sum((x - m) * (y - m) for x, y in zip(codes, codes[1:], strict=False))
    p.append(0 if squares == 0 else 2 * upper_tail(abs(lagged / squares + 1 / n) * math.sqrt(n)))
    return min(1.0, 3 * min(p))


def redacted(text, spans):
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]
