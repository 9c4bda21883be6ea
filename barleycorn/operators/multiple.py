"""Rules for many P-values (name, p) at once; reject tells what a rule rejects at alpha."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(tests: DataFrame) -> DataFrame:
    # the rank of a P-value among m: its group is the whole family, a row for each hypothesis
    order = Window.orderBy("p", "name")
    return tests.withColumns({"k": F.row_number().over(order) - 1, "m": F.count("*").over(Window.partitionBy())})


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    m = tests.agg(F.count("*").alias("m"))
    return tests.withColumn("reject", F.col("p") <= F.lit(alpha) / m.scalar())


def sidak(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    m = tests.agg(F.count("*").alias("m"))
    return tests.withColumn("reject", F.col("p") <= 1 - F.pow(F.lit(1 - alpha), F.lit(1.0) / m.scalar()))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Ascending; the first P-value above alpha / (m + 1 - k), k from 0, and all not below it stay."""
    ranked = _ranked(tests).withColumn("over", F.col("p") > F.lit(alpha) / (F.col("m") + 1 - F.col("k")))
    first = ranked.where("over").agg(F.min("p").alias("p"))
    return ranked.withColumn("reject", F.coalesce(F.col("p") < first.scalar(), F.lit(True))).drop("k", "m", "over")


def hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Ascending; all are rejected up to the last of the P-values that are at most alpha / (m + 1 - k) without a break from the first."""
    ranked = _ranked(tests).withColumn("over", F.col("p") > F.lit(alpha) / (F.col("m") + 1 - F.col("k")))
    first = ranked.where("over").agg(F.min("k").alias("k"))
    return ranked.withColumn("reject", F.coalesce(F.col("k") < first.scalar(), F.lit(True))).drop("k", "m", "over")
