"""Poisson tails and local regression, in plain numpy."""

from __future__ import annotations

import math

import numpy as np

_TAIL_APPROXIMATION = 1e-7


def poisson_upper_tail(k: int, mu: float) -> float:
    """P(X >= k) of a Poisson variable, exact in the far tail down to the smallest double."""
    if k <= 0 or math.isnan(mu):
        return 1.0
    if mu <= 0:
        return 0.0
    log_first = -mu + k * math.log(mu) - math.lgamma(k + 1)
    if k > mu:
        # the terms from k on fall; their sum over the first one
        total = term = 1.0
        i = k
        while term > total * 1e-17 and i < k + 100_000:
            i += 1
            term *= mu / i
            total += term
        log_tail = log_first + math.log(total)
        return math.exp(log_tail) if log_tail > -745 else 0.0
    # the lower part, from k - 1 down
    total = term = 1.0
    i = k - 1
    while i > 0 and term > total * 1e-17:
        term *= i / mu
        total += term
        i -= 1
    lower = math.exp(log_first + math.log(k / mu) + math.log(total))
    return max(0.0, 1.0 - lower)


def abundance_pvalue(reads: int, mu: float, prior: bool = False, detect_singletons: bool = False) -> float:
    """Probability of ``reads`` or more at an expectation of ``mu``, given that one was seen unless the sequence is expected a priori."""
    if mu <= 0:
        return 1.0 if reads <= 0 else 0.0
    tail = poisson_upper_tail(reads, mu)
    if prior or detect_singletons:
        return tail
    seen = -math.expm1(-mu)
    if seen < _TAIL_APPROXIMATION:
        seen = mu - 0.5 * mu * mu
    return min(1.0, tail / seen)


def poisson_cdf(k: int, mu: float) -> float:
    return 1.0 - poisson_upper_tail(k + 1, mu)


def _weighted_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: int, at: float) -> tuple[float, float]:
    """Value and slope at ``at`` of a weighted polynomial of ``order`` coefficients; fewer where the system is singular."""
    for n in range(order, 0, -1):
        design = (x - at)[:, None] ** np.arange(n)
        left = (design * w[:, None]).T @ design
        right = design.T @ (w * y)
        scale = np.abs(left).max()
        if scale > 0 and np.linalg.matrix_rank(left, tol=1e-12 * max(scale, 1.0)) == n:
            c = np.linalg.solve(left, right)
            return float(c[0]), float(c[1]) if n > 1 else 0.0
    return float(np.average(y, weights=w)) if w.sum() > 0 else float("nan"), 0.0


def _local(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: float, span: float, degree: int) -> tuple[float, float]:
    n = len(x)
    d = min(degree, n - 1)
    q = min(max(int(math.floor(span * n)), d + 1), n)
    distance = np.abs(x - at)
    near = np.argsort(distance, kind="stable")[:q]
    widest = distance[near].max()
    u = distance[near] / widest if widest > 0 else np.zeros(q)
    local = (1 - u**3) ** 3 * w[near] if widest > 0 else w[near]
    some = local > 0
    if not some.any():
        return float("nan"), 0.0
    order = min(d + 1, int(some.sum()), len(np.unique(x[near][some])))
    return _weighted_fit(x[near][some], y[near][some], local[some], order, at)


def loess(x, y, weights, at, span: float = 0.75, degree: int = 2, surface: str = "interpolate", cell: float = 0.2) -> np.ndarray:
    """Local polynomial regression with tricube weights.

    ``direct`` fits at every point of ``at``; ``interpolate`` fits value and
    slope at the vertices of a tree over x and joins them by cubic Hermite
    pieces. Outside the data the end values are carried on; points without a
    finite y or a positive weight are left out.
    """
    x, y, w = (np.asarray(v, float) for v in (x, y, weights))
    ok = np.isfinite(y) & (w > 0)
    x, y, w = x[ok], y[ok], w[ok]
    at = np.asarray(at, float)
    if not len(x):
        return np.full(len(at), np.nan)
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    inside = np.clip(at, x[0], x[-1])
    if surface == "direct":
        return np.array([_local(x, y, w, v, span, degree)[0] for v in inside])
    d = min(degree, len(x) - 1)
    most = max(int(math.floor(cell * span * len(x))), d + 1)
    cuts = {0, len(x) - 1}
    cells = [(0, len(x) - 1)]
    while cells:
        lo, hi = cells.pop()
        if hi - lo + 1 > most:
            middle = (lo + hi) // 2
            if middle not in (lo, hi):
                cuts.add(middle)
                cells += [(lo, middle), (middle, hi)]
    vertices = np.unique(x[sorted(cuts)])
    fits = np.array([_local(x, y, w, v, span, degree) for v in vertices])
    if len(vertices) == 1:
        return np.full(len(at), fits[0, 0])
    k = np.clip(np.searchsorted(vertices, inside, "right") - 1, 0, len(vertices) - 2)
    h = vertices[k + 1] - vertices[k]
    t = (inside - vertices[k]) / h
    a, b = fits[k], fits[k + 1]
    return (
        (1 + 2 * t) * (1 - t) ** 2 * a[:, 0]
        + t * (1 - t) ** 2 * h * a[:, 1]
        + t**2 * (3 - 2 * t) * b[:, 0]
        + t**2 * (t - 1) * h * b[:, 1]
    )
