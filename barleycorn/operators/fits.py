"""Distributions of tumour sizes.

Sizes are reduced to counts and sums of logarithms in narrow bins; these are all that the likelihoods of a
log-normal and of a power-law tail need, so a target of any size is fitted from a bounded array.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32  # a unit of the natural logarithm


def log_bins(tumors: DataFrame, by: str = "target") -> DataFrame:
    """(by, bins): an array of (bin, n, s, q), counts and sums of logarithms and their squares."""
    y = F.ln("cells")
    sums = tumors.where("cells > 0").groupBy(by, F.floor(y * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    return sums.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "s", "q"))).alias("bins"))


def power_law(h: list, grid: int = 400) -> tuple:
    """alpha, log xmin, log-likelihood ratio to the log-normal over sizes from xmin, P, share of sizes in the tail, label."""
    b, n, s, q = (np.array([float(r[c]) for r in h]) for c in ("bin", "n", "s", "q"))
    total = n.sum()
    tail_n, tail_s, tail_q = (np.cumsum(x[::-1])[::-1] for x in (n, s, q))
    cum = np.cumsum(n) / total
    first, last = np.searchsorted(cum, 0.1), np.searchsorted(cum, 0.99)
    choice = np.unique(np.linspace(first, last, grid).astype(int))
    mean = s.sum() / total
    spread = math.sqrt(max(q.sum() / total - mean * mean, 1e-12))
    best = None
    for k in choice:
        m, low = tail_n[k], b[k] / BINS
        over = tail_s[k] - m * low
        if m < 10 or over <= 0:
            continue
        alpha = 1 + m / over
        power = m * math.log(alpha - 1) + m * (alpha - 1) * low - alpha * tail_s[k]
        beyond = 0.5 * math.erfc((low - mean) / spread / math.sqrt(2))
        normal = -m * math.log(spread * math.sqrt(2 * math.pi)) - (tail_q[k] - 2 * mean * tail_s[k] + m * mean * mean) / (2 * spread**2) - tail_s[k] - m * math.log(max(beyond, 1e-300))
        ratio = (power - normal) / math.sqrt(m)
        if best is None or ratio > best[2]:
            best = (alpha, low, ratio, m / total)
    if best is None:
        return None, None, None, None, None, "LN"
    p = 1 / (1 + math.exp(min(700.0, best[2])))
    return best[0], best[1], best[2], p, best[3], "LN+PL" if p < 0.05 else "LN"


def power_law_fits(tumors: DataFrame, by: str = "target") -> DataFrame:
    """by, alpha, log_xmin, ratio, p, tail, best_fit."""

    @F.pandas_udf("alpha double, log_xmin double, ratio double, p double, tail double, best_fit string")
    def fit(bins: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([power_law(h) for h in bins], columns=["alpha", "log_xmin", "ratio", "p", "tail", "best_fit"])

    return log_bins(tumors, by).withColumn("f", fit("bins")).select(by, "f.*")


def anderson_darling(b: np.ndarray, n: np.ndarray, cdf) -> float:
    """The distance of binned values from a distribution, its tails weighing most."""
    x = (b + 0.5) / BINS
    p = np.clip(cdf(x), 1e-12, 1 - 1e-12)
    total = n.sum()
    rank = (np.cumsum(n) - 0.5 * n) / total
    return float((n * (rank - p) ** 2 / (p * (1 - p))).sum())


def best_families(tumors: DataFrame, by: str = "target") -> DataFrame:
    """by, family, distance: of log-normal, exponential, Pareto, Weibull, logistic and Gumbel on the logarithm, the nearest."""

    def families(b: np.ndarray, n: np.ndarray, s: float, q: float) -> dict:
        total = n.sum()
        m = s / total
        d = math.sqrt(max(q / total - m * m, 1e-12))
        size = (n * np.exp((b + 0.5) / BINS)).sum() / total
        low = b.min() / BINS
        erf = np.vectorize(math.erf)
        gumbel = d * math.sqrt(6) / math.pi
        shape = math.pi / (math.sqrt(6) * d)
        return {
            "lognormal": lambda x: 0.5 * (1 + erf((x - m) / d / math.sqrt(2))),
            "exponential": lambda x: 1 - np.exp(-np.exp(x) / size),
            "pareto": lambda x: 1 - np.exp(-(x - low) / max(m - low, 1e-9)),
            "weibull": lambda x: 1 - np.exp(-np.exp(np.clip(shape * (x - m) - 0.5772156649015329, -700, 700))),
            "loglogistic": lambda x: 1 / (1 + np.exp(-(x - m) * math.pi / d / math.sqrt(3))),
            "loggumbel": lambda x: np.exp(-np.exp(np.clip(-(x - m) / gumbel - 0.5772156649015329, -700, 700))),
        }

    @F.pandas_udf("family string, distance double")
    def fit(bins: pd.Series) -> pd.DataFrame:
        rows = []
        for h in bins:
            b, n, s, q = (np.array([float(r[c]) for r in h]) for c in ("bin", "n", "s", "q"))
            far = {k: anderson_darling(b, n, f) for k, f in families(b, n, s.sum(), q.sum()).items()}
            rows.append(min(far.items(), key=lambda kv: (kv[1], kv[0])))
        return pd.DataFrame(rows, columns=["family", "distance"])

    return log_bins(tumors, by).withColumn("f", fit("bins")).select(by, "f.*")
