"""From abundances to cells: GC bias, spike-ins, filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Quantify
from ..functions.sequence import gc_count


def gc_residuals(combined: DataFrame, how: Quantify = Quantify()) -> DataFrame:
    """combined with gcs, metric y (logarithm if how.logged) and its residual from the mean of sample and target."""
    y = F.expr(how.metric).cast("double")
    out = combined.withColumns({"gcs": gc_count(F.concat("id", "barcode")), "y": F.ln(y) if how.logged else y})
    # a mean by aggregation and a join: a window would bring all rows of a sample and target together
    means = out.groupBy("sample", "target").agg(F.avg("y").alias("group_mean"))
    return out.join(means, ["sample", "target"]).withColumn("residual", F.col("y") - F.col("group_mean"))


def trimmed_means(df: DataFrame, by: str, value: str, share: float, accuracy: int = 10_000) -> DataFrame:
    """(by, trimmed, n): means without the lowest and highest share of each group's n values; nulls don't count.

    Approximate percentiles, which tasks add up, bracket the two values where a group is cut.  Only the distinct
    values between the brackets' ends are put in order, a few thousandths of a group; of all others counts and
    sums are enough.  The result is exact; a bracket that misses its cut would be an error, not another mean.
    """
    slack, inf = 3 / accuracy, float("inf")
    marks = [share - slack, share + slack, 1 - share - slack, 1 - share + slack]
    found = F.percentile_approx("v", [min(1.0, max(0.0, m)) for m in marks], accuracy)
    edge = [F.lit(-inf) if m <= 0 else F.lit(inf) if m >= 1 else F.get("q", F.lit(k)) for k, m in enumerate(marks)]
    rows = df.select(F.col(by), F.col(value).cast("double").alias("v")).where("v is not null")
    edges = rows.groupBy(F.col(by).alias("group")).agg(F.count("*").alias("n"), found.alias("q")).select("group", "n", *[e.alias(f"e{k}") for k, e in enumerate(edge)])
    # below, the lower bracket, between, the upper bracket, above
    part = F.expr("case when v < e0 then 0 when v <= e1 then 1 when v < e2 then 2 when v <= e3 then 3 else 4 end")
    placed = rows.join(edges, F.col(by).eqNullSafe(F.col("group"))).withColumn("part", part)
    sums = placed.groupBy(by, "n", "part", F.when(F.col("part").isin(1, 3), F.col("v")).alias("x")).agg(F.count("*").alias("k"), F.sum("v").alias("s"))
    upto = F.sum("k").over(Window.partitionBy(by).orderBy("part", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = F.floor(F.lit(share) * F.col("n"))
    stays = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("n") - cut) - F.greatest(F.col("upto") - F.col("k"), cut))
    ranked = sums.withColumn("upto", upto).withColumn("stays", stays)
    missed = ((F.col("part") == 2) & (F.col("stays") != F.col("k"))) | (F.col("part").isin(0, 4) & (F.col("stays") > 0))
    kept = F.when(missed, F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")).when(F.col("part") == 2, F.col("s")).when(F.col("stays") > 0, F.col("x") * F.col("stays"))
    return ranked.groupBy(by).agg((F.sum(kept) / F.sum("stays")).alias("trimmed"), F.max("n").alias("n")).where("trimmed is not null")


def fit_polynomial(x: np.ndarray, y: np.ndarray, weights: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Weighted least-squares coefficients of x^0 to x^order, and the adjusted R squared."""
    powers = np.vander(x, order + 1, increasing=True)
    root = np.sqrt(weights)
    coefficients = np.linalg.lstsq(powers * root[:, None], y * root, rcond=None)[0]
    rest = y - powers @ coefficients
    centred = y - np.average(y, weights=weights)
    r2 = 1 - (weights * rest**2).sum() / max((weights * centred**2).sum(), 1e-300)
    free = len(x) - order - 1
    return coefficients, 1 - (1 - r2) * (len(x) - 1) / free if free > 0 else float("nan")


def gc_fit(residuals: DataFrame, how: Quantify = Quantify(), orders: tuple[int, ...] | None = None) -> tuple[np.ndarray, float]:
    """The fit of residuals on GC counts, of how.order or of the order with the best adjusted R squared; there is one point for each GC count."""
    points = trimmed_means(residuals, "gcs", "residual", how.trim).orderBy("gcs").collect()  # a barcode's length at most
    x, y, w = (np.array([float(p[c]) for p in points]) for c in ("gcs", "trimmed", "n"))
    fits = [fit_polynomial(x, y, w, min(o, max(0, len(x) - 1))) for o in (orders or (how.order,))]
    return max(fits, key=lambda f: -np.inf if np.isnan(f[1]) else f[1])


def gc_fitted(residuals: DataFrame, how: Quantify = Quantify(), orders: tuple[int, ...] = (2, 3, 4, 5, 6)) -> DataFrame:
    """(gcs, order, fitted): the fit of the order with the best adjusted R squared, at each GC count that occurs."""
    coefficients, _ = gc_fit(residuals, how, orders)
    powers = [float(c) * F.pow(F.col("gcs").cast("double"), F.lit(float(k))) for k, c in enumerate(coefficients)]
    return residuals.select("gcs").distinct().select("gcs", F.lit(len(coefficients) - 1).alias("order"), sum(powers[1:], powers[0]).alias("fitted"))


def gc_corrected(residuals: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """residuals with the metric without the GC count's effect; the group's mean stays in it."""
    powers = [float(c) * F.pow(F.col("gcs").cast("double"), F.lit(float(k))) for k, c in enumerate(coefficients)]
    return residuals.withColumn("gc_corrected", F.exp(F.col("y") - sum(powers[1:], powers[0])))


def spikes(corrected: DataFrame, how: Quantify = Quantify()) -> DataFrame:
    """(barcode, share) of the spike-in barcodes that hold more than a share of all spike-in abundance."""
    own = corrected.where(F.col("target") == how.spike_target).groupBy("barcode").agg(F.sum("gc_corrected").alias("sum"))
    return own.withColumn("share", F.col("sum") / own.agg(F.sum("sum")).scalar()).where(F.col("share") > how.spike_share).select("barcode", "share")


def cells(corrected: DataFrame, true_spikes: DataFrame, how: Quantify = Quantify()) -> DataFrame:
    """corrected with cells, by each sample's mean of true spike-ins, and concentration n0 / (abundance - n1 - n0).

    A concentration with nothing below the line is infinite, as for the reference values, or NaN for n0 = 0.
    """
    spiked = corrected.where(F.col("target") == how.spike_target).join(true_spikes.select("barcode"), "barcode", "left_semi")
    scale = spiked.groupBy("sample").agg((F.lit(how.spike_cells) / F.avg("gc_corrected")).alias("scale"))
    below = (F.col("abundance") - F.col("n1") - F.col("n0")).cast("double")
    whole = F.when(F.col("n0") == 0, float("nan")).otherwise(F.signum(F.col("n0").cast("double")) * float("inf"))
    out = corrected.join(scale, "sample", "left")
    return out.withColumns({"cells": F.col("gc_corrected") * F.col("scale"), "concentration": F.when(below == 0, whole).otherwise(F.try_divide(F.col("n0").cast("double"), below))}).drop("scale")


def filtered(sized: DataFrame, true_spikes: DataFrame, how: Quantify = Quantify()) -> DataFrame:
    """sized with pass_filter and false_positive: a passing spike-in that is no true one."""
    known = true_spikes.select("barcode", F.lit(True).alias("true_spike"))
    out = sized.join(known, "barcode", "left").withColumn("pass_filter", F.coalesce(F.expr(how.final_filter), F.lit(False)))
    wrong = (F.col("target") == how.spike_target) & F.col("pass_filter") & F.col("true_spike").isNull()
    return out.withColumn("false_positive", wrong).drop("true_spike")


def false_discovery(final: DataFrame) -> DataFrame:
    """One row: passing rows, false positives among them, and their share."""
    passing = F.sum(F.col("pass_filter").cast("long"))
    wrong = F.sum(F.col("false_positive").cast("long"))
    return final.agg(passing.alias("passed"), wrong.alias("false_positives"), F.try_divide(wrong, passing).alias("fdr"))


def quantified(combined: DataFrame, how: Quantify = Quantify()) -> DataFrame:
    """All steps from the combined table to the final one."""
    residuals = gc_residuals(combined, how)
    corrected = gc_corrected(residuals, gc_fit(residuals, how)[0])
    true_spikes = spikes(corrected, how)
    return filtered(cells(corrected, true_spikes, how), true_spikes, how)
