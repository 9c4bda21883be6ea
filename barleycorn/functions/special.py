"""Distribution functions that neither Spark nor numpy has, on numbers."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def bisect(f, low: float, high: float, rounds: int = 200) -> float:
    """A root of a function that is negative at low and positive at high."""
    for _ in range(rounds):
        middle = (low + high) / 2
        if f(middle) < 0:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan
    return bisect(lambda x: normal_cdf(x) - p, -40, 40)


def lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    return min(1.0, _series(a, x)) if x < a + 1 else max(0.0, 1 - _fraction(a, x))


def upper_gamma(a: float, x: float) -> float:
    """1 - lower_gamma, which keeps the digits of small values."""
    if x <= 0:
        return 1.0
    return max(0.0, 1 - _series(a, x)) if x < a + 1 else min(1.0, _fraction(a, x))


def _front(a: float, x: float) -> float:
    return math.exp(a * math.log(x) - x - math.lgamma(a))


def _series(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * _front(a, x)


def _fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return _front(a, x) * h


def log_lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The logarithm of the regularised lower incomplete gamma function; small values keep all their digits."""
    a, x = np.broadcast_arrays(np.asarray(a, np.float64), np.asarray(x, np.float64))
    out = np.full(a.shape, -np.inf)
    some = np.flatnonzero(x > 0)
    if not len(some):
        return out
    whole, back = np.unique(a[some], return_inverse=True)
    front = a[some] * np.log(x[some]) - x[some] - np.array([math.lgamma(v) for v in whole.tolist()])[back]
    small = x[some] < a[some] + 1
    at = some[small]
    n, total = a[at].copy(), 1 / a[at]
    term, live = total.copy(), np.arange(len(at))
    while len(live):  # a series
        n[live] += 1
        term[live] *= x[at[live]] / n[live]
        total[live] += term[live]
        live = live[term[live] > total[live] * 1e-17]
    out[at] = front[small] + np.log(total)
    for k, f in zip(some[~small].tolist(), front[~small].tolist(), strict=True):  # half or more: nothing cancels
        out[k] = math.log(lower_gamma(float(a[k]), float(x[k]))) if f > -700 else 0.0
    return np.minimum(out, 0.0)


def log_abundance_p(abundance: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The logarithm of P(X >= abundance | X >= 1) of Poisson variables; -inf where nothing is expected of more than one."""
    a, mu = np.broadcast_arrays(np.asarray(abundance, np.float64), np.asarray(expected, np.float64))
    pairs, back = np.unique(np.stack([a.ravel(), mu.ravel()]), axis=1, return_inverse=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = log_lower_gamma(pairs[0], pairs[1]) - np.log(-np.expm1(-pairs[1]))
    p = np.where(pairs[0] <= 1, 0.0, np.where(pairs[1] <= 0, -np.inf, np.minimum(p, 0.0)))
    return p[back.ravel()].reshape(a.shape)


def poisson_cdf(k: float, mu: float) -> float:
    """P(X <= k)."""
    if k < 0:
        return 0.0
    return 1.0 if mu <= 0 else 1 - lower_gamma(math.floor(k) + 1, mu)


def chi2_survival(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def gamma_quantile(p: float, a: float) -> float:
    high = max(1.0, a)
    while lower_gamma(a, high) < p:
        high *= 2
    return bisect(lambda x: lower_gamma(a, x) - p, 0, high)


def poisson_interval(n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact interval of the mean of a Poisson count n."""
    low = 0.0 if n <= 0 else gamma_quantile(alpha / 2, n)
    return low, gamma_quantile(1 - alpha / 2, n + 1)
