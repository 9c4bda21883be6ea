"""Statistics of tumour sizes (sample, target, barcode, cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import INERTS, PERCENTILES
from ..functions.estimators import ESTIMATORS, ln_mean
from . import overlaps


def ln_means(tumors: DataFrame, by: tuple[str, ...] = ("target",), value: str = "cells") -> DataFrame:
    return tumors.groupBy(*by).agg(F.count("*").alias("n"), ln_mean(F.col(value)).alias("ln_mean"))


def relative_ln_means(tumors: DataFrame, inerts: tuple[str, ...] = INERTS) -> DataFrame:
    """target, n, ln_mean and its ratio to the median of the inert targets'."""
    means = ln_means(tumors)
    middle = means.where(F.col("target").isin(*inerts)).agg(F.median("ln_mean").alias("m"))
    return means.withColumn("relative", F.col("ln_mean") / middle.scalar())


def size_percentiles(tumors: DataFrame, percents: tuple[int, ...] = PERCENTILES, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """A row for each group and percentile, interpolated."""
    found = tumors.groupBy(*by).agg(F.percentile("cells", F.array(*[F.lit(p / 100) for p in percents])).alias("p"))
    return found.select(*by, F.posexplode("p").alias("k", "cells")).withColumn("percent", F.get(F.array(*[F.lit(p) for p in percents]), F.col("k"))).drop("k")


def inert_normalized(tumors: DataFrame, inerts: tuple[str, ...] = INERTS, by: str = "sample", how: str = "median") -> DataFrame:
    """tumors with cells over the estimate of the inert ones of the same sample."""
    level = tumors.where(F.col("target").isin(*inerts)).groupBy(by).agg(ESTIMATORS[how]("cells").alias("level"))
    return tumors.join(level, by, "left").withColumn("relative", F.try_divide("cells", "level")).drop("level")


def decade_shares(tumors: DataFrame) -> DataFrame:
    """target, decade, n, share: of each target's sizes the share within a power of ten."""
    counts = tumors.where("cells > 0").groupBy("target", F.floor(F.log10("cells")).cast("int").alias("decade")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("target")))


def log_histogram(tumors: DataFrame, per_decade: int = 4) -> DataFrame:
    """target, bin, n, density of logarithmic bins; bin k begins at 10^(k / per_decade)."""
    bins = tumors.where("cells > 0").groupBy("target", F.floor(F.log10("cells") * per_decade).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    width = F.pow(F.lit(10.0), (F.col("bin") + 1) / per_decade) - F.pow(F.lit(10.0), F.col("bin") / per_decade)
    return bins.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("target")) / width)


def jackknife_ln_means(tumors: DataFrame) -> DataFrame:
    """target, acceleration: of the log-normal mean, from its values without each single tumour, by sums alone."""
    y = F.ln("cells")
    sums = tumors.groupBy("target").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    each = tumors.join(sums, "target").where("n > 1").withColumn("y", y)
    m = (F.col("s") - F.col("y")) / (F.col("n") - 1)
    left = each.withColumn("out", F.exp(m + ((F.col("q") - F.col("y") * F.col("y")) / (F.col("n") - 1) - m * m) / 2))
    means = left.groupBy("target").agg(F.avg("out").alias("mean"))
    apart = left.join(means, "target").withColumn("d", F.col("out") - F.col("mean"))
    return apart.groupBy("target").agg(F.try_divide(F.sum(F.pow("d", F.lit(3))), 6 * F.pow(F.sum(F.pow("d", F.lit(2))), F.lit(1.5))).alias("acceleration"))


def levels_r2(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """One row: the share of a value's variance that the means of the levels explain."""
    means = df.groupBy(*levels).agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("q"), F.sum(value).alias("s"))
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    rest = F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m"))
    return means.agg((1 - F.try_divide(rest, total)).alias("r2"))


def barcode_overlaps(tumors: DataFrame) -> DataFrame:
    """(a, b, shared) for samples a < b with common (target, barcode)."""
    numbers, n = overlaps.numbered(tumors)
    holders = overlaps.by_number(tumors.where("sample is not null").select("sample", "target", "barcode"), numbers, n).distinct().withColumn("asks", F.lit(True))
    pairs = overlaps.counted(overlaps.listed(holders, n, later=True), n).select("a", "b", "shared")
    return overlaps.named(pairs, numbers, n).select("a", "b", "shared")


def observed_barcodes(tumors: DataFrame) -> DataFrame:
    """target, observed barcodes, and in how many samples one is seen on average."""
    seen = tumors.groupBy("target", "barcode").agg(F.count_distinct("sample").alias("samples"))
    return seen.groupBy("target").agg(F.count("*").alias("observed"), F.avg("samples").alias("mean_samples"))


def without_samples(tumors: DataFrame, dropped: DataFrame) -> DataFrame:
    """tumors of samples that aren't in dropped (sample)."""
    return tumors.join(dropped.select("sample").distinct(), "sample", "left_anti")


def power_tails(tumors: DataFrame, x_min: float) -> DataFrame:
    """target, alpha, x_min, share: the exponent of greatest likelihood of the sizes over x_min, and the share that they are of all."""
    over = F.col("cells") > x_min
    sums = tumors.where("cells > 0").groupBy("target").agg(F.count("*").alias("n"), F.count_if(over).alias("k"), F.sum(F.when(over, F.ln(F.col("cells") / x_min))).alias("s"))
    return sums.where("k > 0").select("target", (1 + F.col("k") / F.col("s")).alias("alpha"), F.lit(float(x_min)).alias("x_min"), (F.col("k") / F.col("n")).alias("share"))


def density_curves(tumors: DataFrame, tails: DataFrame, first: float = 3, decades: float = 4, points: int = 100) -> DataFrame:
    """target, k, size, log_normal, power_law: densities at sizes that are evenly spaced by logarithm, for plots.

    The log-normal is that of greatest likelihood; the tail (tails: target, alpha, x_min, share) is null below its
    x_min, and scaled as the published plots have it, by alpha.
    """
    sized = tumors.where("cells > 0").groupBy("target").agg(F.avg(F.ln("cells")).alias("m"), F.stddev_pop(F.ln("cells")).alias("d"))
    x, a = F.col("size"), F.col("alpha")
    placed = sized.join(tails, "target", "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("size", F.pow(F.lit(10.0), first + decades * F.col("k") / (points - 1)))
    bell = F.when(F.col("d") > 0, F.exp(-F.pow((F.ln(x) - F.col("m")) / F.col("d"), F.lit(2)) / 2) / (x * F.col("d") * F.sqrt(F.lit(2.0) * F.pi())))
    tail = F.when(x >= F.col("x_min"), a * F.pow(F.col("x_min"), a - 1) * F.pow(x, -a) * F.col("share"))
    return placed.select("target", "k", "size", bell.alias("log_normal"), tail.alias("power_law"))
