"""Contamination between samples, library diversity, principal components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import bisect, poisson_cdf
from ..storage import written
from . import overlaps


def poisson_share(k: pd.Series, mu: pd.Series) -> pd.Series:
    return pd.Series([poisson_cdf(a, b) for a, b in zip(k, mu, strict=True)])


def contaminated_pairs(tumors: DataFrame, min_size: float, smallest: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """a, b, expected, observed, p, fwer: pairs where sample b holds more of a's large barcodes than chance brings.

    A barcode is large in a if its size is over min_size / smallest.  Three samples are needed; sizes of one
    barcode in one sample are added up first.  Pairs that share too few barcodes for any expectation to make them
    significant are dropped where they are counted.
    """
    numbers, every = overlaps.numbered(tumors)
    n = numbers.where("sample is not null").count()
    sized = overlaps.by_number(tumors, numbers, every).groupBy("number", "target", "barcode").agg(F.sum("cells").alias("cells"))
    holders = sized.withColumn("asks", F.coalesce(F.col("cells") > min_size / smallest, F.lit(False)))
    found = written(overlaps.counted(overlaps.listed(holders, every, later=False), every, fewest_shared(n, alpha), totals=True), "shared")
    totals = found.where("b is null")
    mean = totals.agg(F.avg("barcodes").alias("m"))
    rates = totals.select("a", F.try_divide("links", F.lit(n - 1)).alias("rate"))
    pairs = found.where("b is not null").select("a", "b", F.col("shared").alias("observed")).join(rates, "a").join(totals.select(F.col("a").alias("b"), "barcodes"), "b")
    pairs = overlaps.named(pairs, numbers, every).withColumn("expected", F.col("rate") * F.col("barcodes") / mean.scalar())
    out = pairs.withColumn("p", F.pandas_udf(poisson_share, "double")("expected", F.col("observed").cast("double")))
    return out.withColumn("fwer", F.least(F.lit(0.5), F.col("p") * n * (n - 1))).where(F.col("fwer") < alpha).select("a", "b", "expected", "observed", "p", "fwer")


def fewest_shared(n: int, alpha: float) -> int:
    """The fewest common barcodes that can make one of n samples' pairs significant: P(X <= k) of a Poisson variable is exp(-mean) at least, and means over 30 are left to the test itself."""
    if n < 2 or not 0 < alpha <= 0.5:
        return 1
    return max(1, min(30, math.floor(math.log(n * (n - 1) / alpha))))


def size_ratios(tumors: DataFrame, pairs: DataFrame | None = None, least: float = 0.75, bins: int = 64) -> DataFrame:
    """(a, b, bin, n): the square roots of the ratios of sizes of shared barcodes, counted in bins of 1 / bins; of all ordered pairs of samples if none are given."""
    one = tumors.select(F.col("sample").alias("a"), "target", "barcode", F.col("cells").alias("x"))
    two = tumors.select(F.col("sample").alias("b"), "target", "barcode", F.col("cells").alias("y"))
    if pairs is None:
        both = one.join(two, ["target", "barcode"]).where("a <> b")
    else:  # few pairs: each looks its own barcodes up, and no other pair is made
        asked = written(pairs.select("a", "b").distinct().where("a <> b"), "asked")
        asked = F.broadcast(asked) if asked.count() <= overlaps.BROADCAST else asked
        both = one.join(asked, "a").join(two, ["b", "target", "barcode"])
    both = both.withColumn("ratio", F.try_divide("x", "y")).where(F.col("ratio") >= least)
    return both.groupBy("a", "b", F.floor(F.least(F.sqrt("ratio"), F.lit(1000.0)) * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def mixture(x: np.ndarray, n: np.ndarray, parts: int = 3, starts: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, spreads, weights and BIC of a normal mixture of values x that occur n times, the best of several starts."""
    rng, best = np.random.default_rng(seed), None
    total, wide = n.sum(), max(x.std(), 1e-3)
    for _ in range(starts):
        mean, spread, weight = rng.choice(x, parts, p=n / total), np.full(parts, wide), np.full(parts, 1 / parts)
        last = -np.inf
        for _ in range(200):
            log = -0.5 * ((x[:, None] - mean) / spread) ** 2 - np.log(spread) - 0.5 * math.log(2 * math.pi) + np.log(weight + 1e-300)
            top = log.max(1, keepdims=True)
            share = np.exp(log - top)
            whole = (n * (top[:, 0] + np.log(share.sum(1)))).sum()
            share = share / share.sum(1, keepdims=True) * n[:, None]
            size = share.sum(0) + 1e-12
            mean = (share * x[:, None]).sum(0) / size
            spread = np.sqrt((share * (x[:, None] - mean) ** 2).sum(0) / size + 1e-6)
            weight = size / size.sum()
            if whole - last < 1e-6 * total:
                break
            last = whole
        if best is None or whole > best[0]:
            best = (whole, mean, spread, weight)
    return best[1], best[2], best[3], -2 * best[0] + (3 * parts - 1) * math.log(total)


def mixtures(x: np.ndarray, n: np.ndarray, parts: int, starts: int = 50, seed: int = 0, cells: int = 400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mixture() of many histograms at once: means, spreads, weights (a row each) and BIC.

    x, n: a row for each histogram, padded by places where n is 0.  All starts of a block of histograms take
    their steps together; those that have settled leave.
    """
    k, width = x.shape
    draws = np.random.default_rng(seed).random((starts, parts))
    out = [np.empty((k, parts)) for _ in range(3)]
    best = np.empty(k)
    step = max(1, cells // (starts * width))
    for at in range(0, k, step):
        hx, hn = x[at : at + step], n[at : at + step]
        m, total = len(hx), hn.sum(1)
        centre = np.array([r[c > 0].std() for r, c in zip(hx, hn, strict=True)])
        cdf = (hn / total[:, None]).cumsum(1)
        cdf /= cdf[:, -1:]
        first = (cdf[:, None, None, :] <= draws[None, :, :, None]).sum(3)
        # one row for each histogram and start; the parts are lists of columns
        own = np.repeat(np.arange(m), starts)
        mean = list(np.take_along_axis(hx, first.reshape(m, -1), 1).reshape(m * starts, parts).T.copy())
        spread, weight = [np.maximum(centre, 1e-3)[own]] * parts, [np.full(m * starts, 1 / parts)] * parts
        last, active = np.full(m * starts, -np.inf), np.arange(m * starts)
        ended = [np.empty(m * starts)] + [np.empty((m * starts, parts)) for _ in range(3)]
        xs, ns, sums = hx[own], hn[own], total[own]
        for turn in range(200):
            log = [(xs - u[:, None]) * (math.sqrt(0.5) / v)[:, None] for u, v in zip(mean, spread, strict=True)]
            log = [(np.log(w + 1e-300) - np.log(v) - 0.5 * math.log(2 * math.pi))[:, None] - z * z for z, v, w in zip(log, spread, weight, strict=True)]
            top = log[0]
            for z in log[1:]:
                top = np.maximum(top, z)
            share = [np.exp(z - top) for z in log]
            norm = sum(share[1:], share[0])
            whole = (ns * (top + np.log(norm))).sum(1)
            norm = ns / norm
            share = [z * norm for z in share]
            size = [z.sum(1) + 1e-12 for z in share]
            mean = [(z * xs).sum(1) / c for z, c in zip(share, size, strict=True)]
            spread = [np.sqrt((z * (xs - u[:, None]) ** 2).sum(1) / c + 1e-6) for z, u, c in zip(share, mean, size, strict=True)]
            all_sizes = sum(size[1:], size[0])
            weight = [c / all_sizes for c in size]
            done = (whole - last < 1e-6 * sums) | (turn == 199)
            if done.any():
                ended[0][active[done]] = whole[done]
                for to, columns in zip(ended[1:], (mean, spread, weight), strict=True):
                    to[active[done]] = np.column_stack([c[done] for c in columns])
                left = ~done
                active, whole, xs, ns, sums = active[left], whole[left], xs[left], ns[left], sums[left]
                mean, spread, weight = ([c[left] for c in columns] for columns in (mean, spread, weight))
                if not len(active):
                    break
            last = whole
        chosen = np.arange(m) * starts + ended[0].reshape(m, starts).argmax(1)
        for to, found in zip(out, ended[1:], strict=True):
            to[at : at + m] = found[chosen]
        best[at : at + m] = -2 * ended[0][chosen] + (3 * parts - 1) * np.log(total)
    return *out, best


def ratio_mixtures(ratios: DataFrame, bins: int = 64, least: float = 0.05, most: float = 0.25) -> DataFrame:
    """a, b, mean, spread, weight, bic, contaminant, fraction: the mixture's contaminating component over each pair's bounded histogram.

    A component may be one whose mean ratio (the square of its mean) lies between 1 and 1 / least, whose squared
    weight is over least and whose spread is at most most; if there is exactly one and the mixture's BIC is
    negative, the pair is contaminated, and fraction is b's share in it.  mean, spread, weight and fraction are
    null unless there is exactly one.
    """

    @F.pandas_udf("mean double, spread double, weight double, bic double, contaminant boolean, fraction double")
    def fit(histogram: pd.Series) -> pd.DataFrame:
        lengths = histogram.map(len).to_numpy()
        rows: list = [None] * len(lengths)
        # histograms of like length together, so that little is padded
        order = np.argsort(lengths, kind="stable")
        for few in np.split(order, np.flatnonzero(np.diff(np.minimum(lengths[order], 3 + lengths[order] // 4 * 4))) + 1):
            if not len(few):
                continue
            x, n = np.zeros((len(few), lengths[few].max())), np.zeros((len(few), lengths[few].max()))
            for i, at in enumerate(few):
                x[i, : lengths[at]] = [(r["bin"] + 0.5) / bins for r in histogram.iloc[at]]
                n[i, : lengths[at]] = [r["n"] for r in histogram.iloc[at]]
            for at, mean, spread, weight, bic in zip(few, *mixtures(x, n, parts=min(3, int(lengths[few].min()))), strict=True):
                fits = np.flatnonzero((mean**2 > 1) & (mean**2 < 1 / least) & (weight**2 > least) & (spread <= most))
                alone = len(fits) == 1
                k = int(fits[0]) if alone else 0
                own = (mean[k], spread[k], weight[k]) if alone else (None, None, None)
                rows[at] = (*own, bic, alone and bic < 0, 1 / (1 + mean[k] ** 2) if alone else None)
        return pd.DataFrame(rows, columns=["mean", "spread", "weight", "bic", "contaminant", "fraction"])

    # fits take long and their rows are few: dealt over as many tasks as are asked for
    dealt = ratios.repartition(int(ratios.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    listed = dealt.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"))
    return listed.withColumn("m", fit("h")).select("a", "b", "m.*")


def diversity(tumors: DataFrame, truncated: bool = True) -> DataFrame:
    """target, observed, unobserved, collision: barcodes that no sample shows, and the mean chance that a barcode of a sample stands for two tumours.

    With truncated, the mean number of samples of a barcode is that of a binomial variable that isn't 0.
    """
    seen = tumors.groupBy("target", "barcode").agg(F.count_distinct("sample").alias("k")).groupBy("target").agg(F.count("*").alias("observed"), F.avg("k").alias("mu"))
    samples = tumors.agg(F.count_distinct("sample").alias("n"))

    @F.pandas_udf("double")
    def unseen(observed: pd.Series, mu: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for o, m, size in zip(observed, mu, n, strict=True):
            if m >= size or m <= 1:
                out.append(0.0 if m >= size else math.inf)
                continue
            mean = (lambda p, s=size: p * s / (1 - (1 - p) ** s)) if truncated else (lambda p, s=size: p * s / (1 - p) ** s)
            p = bisect(lambda q, f=mean, m=m: f(q) - m, 1e-12, 1 - 1e-12)
            none = (1 - p) ** size
            out.append(o * none / (1 - none))
        return pd.Series(out)

    sizes = seen.withColumn("n", samples.scalar()).withColumn("unobserved", unseen("observed", "mu", "n"))
    per_sample = tumors.groupBy("target", "sample").agg(F.count_distinct("barcode").alias("b"))
    rate = F.col("b") / (F.col("observed") + F.col("unobserved"))
    chance = (1 - F.exp(-rate) - rate * F.exp(-rate)) / (1 - F.exp(-rate))
    collisions = per_sample.join(sizes, "target").where(rate > 0).groupBy("target").agg((F.sum(chance * F.col("b")) / F.sum("b")).alias("collision"))
    return sizes.join(collisions, "target", "left").select("target", "observed", "unobserved", "collision")


def target_components(values: DataFrame, row: str = "sample", column: str = "target", value: str = "value") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Targets, weights of the first principal component of rows by targets, and shares of variance.

    Spark makes the targets' products; only their square matrix comes to the driver.
    """
    means = values.groupBy(row, column).agg(F.avg(value).alias("v"))
    centred = means.join(means.groupBy(column).agg(F.avg("v").alias("m")), column).select(row, column, (F.col("v") - F.col("m")).alias("v"))
    other = centred.select(row, F.col(column).alias("__other"), F.col("v").alias("__v"))
    products = centred.join(other, row).groupBy(column, "__other").agg(F.sum(F.col("v") * F.col("__v")).alias("p")).collect()
    names = sorted({r[column] for r in products})
    at = {n: i for i, n in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in products:
        gram[at[r[column]], at[r["__other"]]] = r["p"]
    shares, vectors = np.linalg.eigh(gram)
    first = vectors[:, -1] * (1 if vectors[:, -1].sum() >= 0 else -1)
    return names, first, shares[::-1] / max(shares.sum(), 1e-300)
