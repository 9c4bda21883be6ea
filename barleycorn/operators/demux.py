"""Demultiplexing: fuzzy look-up of indices, dual indices, spacers, and mates.

Distinct indices are matched, not reads; the sides of fuzzy joins are the distinct unmatched indices and the
run's index map, which has as many rows as samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import fill_from_mate, find_with_substitutions


def neighbours(index: Column, letters: str = "ACGTN") -> Column:
    """All strings with one substitution, index itself included: the keys of an equi-join at a distance of one."""
    places = F.sequence(F.lit(0), F.length(index) - 1)
    swap = lambda i, c: F.concat(index.substr(F.lit(1), i), F.lit(c), index.substr(i + 2, F.length(index)))
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[swap(i, c) for c in letters]))))


def matched_indices(observed: DataFrame, known: DataFrame, key: str = "barcode", value: str = "sample") -> DataFrame:
    """(index, assigned, how) of distinct observed indices: exact, recovered (one known index at one substitution), unknown (none) or conflict (several).

    observed: index.  The known side is turned into its neighbourhood, so this is an equi-join.
    """
    near = known.select(F.explode(neighbours(F.col(key))).alias("index"), F.col(key).alias("key"), F.col(value).alias("value"))
    hits = observed.join(near, "index").groupBy("index").agg(
        F.max(F.when(F.col("key") == F.col("index"), F.col("value"))).alias("exact"),
        F.count("*").alias("hits"),
        F.min("value").alias("only"),
    )
    out = observed.join(hits, "index", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("hits") == 1, "recovered").when(F.col("hits") > 1, "conflict").otherwise("unknown")
    assigned = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("hits") == 1, F.col("only")).otherwise(how)
    return out.select("index", assigned.alias("assigned"), how.alias("how"))


def dual_index(reads: DataFrame, known: DataFrame) -> DataFrame:
    """reads (index1, index2) with the sample assigned to both mates.

    N bases are filled in from the mate.  Equal indices are looked up; different ones give their common
    assignment, or conflict.
    """
    one, two = fill_from_mate(F.col("index1"), F.col("index2")), fill_from_mate(F.col("index2"), F.col("index1"))
    filled = reads.withColumns({"filled1": one, "filled2": two})
    distinct = filled.select(F.explode(F.array("filled1", "filled2")).alias("index")).distinct()
    found = matched_indices(distinct, known)
    joined = filled.join(found.select(F.col("index").alias("filled1"), F.col("assigned").alias("a1")), "filled1").join(found.select(F.col("index").alias("filled2"), F.col("assigned").alias("a2")), "filled2")
    return joined.withColumn("assigned", F.when(F.col("a1") == F.col("a2"), F.col("a1")).otherwise("conflict")).drop("filled1", "filled2", "a1", "a2")


def tallied(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of the whole, by columns."""
    total = assigned.agg(F.count("*").alias("n"))
    return assigned.groupBy(*by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total.scalar())


def with_spacers(reads: DataFrame, dna: str, anchor: str, spacers: list[int], indel: int, substitutions: int, name: str) -> DataFrame:
    """reads with the spacer length whose neighbourhood the anchor begins in, or null: the anchor's place within indel of it."""
    place = find_with_substitutions(F.col(dna), anchor, substitutions)
    # the place is looked up once; of spacers that overlap the shortest counts
    by_place = [next((s for s in sorted(spacers) if abs(s - p) <= indel), None) for p in range(max(spacers) + indel + 1)]
    return reads.withColumn(name, F.get(F.array(*[F.lit(s).cast("int") for s in by_place]), place))


def routed_by_spacer(reads: DataFrame, routes: DataFrame, use_reverse: bool = False) -> DataFrame:
    """reads (forward, reverse spacer lengths) with their sample: of both spacers, else of the forward alone unless use_reverse asks for both; else Failed."""
    both = routes.select(F.col("forward").alias("f"), F.col("reverse").alias("r"), F.col("sample").alias("s2"))
    out = reads.join(F.broadcast(both), (reads["forward"] == both["f"]) & (reads["reverse"] == both["r"]), "left").drop("f", "r")
    if use_reverse:
        return out.withColumn("assigned", F.coalesce("s2", F.lit("Failed"))).drop("s2")
    first = routes.groupBy(F.col("forward").alias("f")).agg(F.min_by("sample", "reverse").alias("s1"))
    return out.join(F.broadcast(first), out["forward"] == first["f"], "left").withColumn("assigned", F.coalesce("s2", "s1", F.lit("Failed"))).drop("f", "s1", "s2")


def spacer_summary(routed: DataFrame, by: str) -> DataFrame:
    """Reads and the share that failed, for each value of by and in total (null)."""
    return routed.rollup(by).agg(F.count("*").alias("n"), F.avg((F.col("assigned") == "Failed").cast("double")).alias("failed"))


def mate_files(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """(name, mates): names that both, only the first or only the second table has."""
    a, b = forward.select("name").distinct().withColumn("f", F.lit(True)), reverse.select("name").distinct().withColumn("r", F.lit(True))
    return a.join(b, "name", "full").select("name", F.when(F.col("f") & F.col("r"), "both").when(F.col("f"), "forward").otherwise("reverse").alias("mates"))
