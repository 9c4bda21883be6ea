"""Guides of clusters: exact and salvaged look-up, merging, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Annotate
from ..functions.sequence import hamming, piece


def guides_within(windows: DataFrame, known: DataFrame, length: int, places: int, substitutions: int) -> DataFrame:
    """(sequence, gid, gtarget, place): the guides with at most so many substitutions at one of the places 0 to places - 1 of each window w, and their leftmost place.

    One of substitutions + 1 pieces of a guide is left whole: an equi-join on pieces, checked on whole ids.
    """
    cuts = [length * k // (substitutions + 1) for k in range(substitutions + 2)]
    pieces = lambda c: F.array(*[F.struct(F.lit(k).alias("k"), c.substr(F.lit(x + 1), F.lit(y - x)).alias("part")) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))])
    keyed = known.where(F.length("id") == length).select(F.col("id").alias("gid"), F.col("target").alias("gtarget"), F.explode(pieces(F.col("id"))).alias("g")).select("gid", "gtarget", "g.*")
    seen = windows.select("sequence", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.substring("w", p + 1, length).alias("id")) for p in range(places)])).alias("x")).select("sequence", "x.*")
    seen = seen.where(F.length("id") == length).withColumn("g", F.explode(pieces(F.col("id")))).select("sequence", "place", "id", "g.*")
    near = seen.join(keyed, ["k", "part"]).where(hamming(F.col("id"), F.col("gid"), length) <= substitutions)
    return near.groupBy("sequence", "gid", "gtarget").agg(F.min("place").alias("place"))


def annotated(clusters: DataFrame, guides: DataFrame, how: Annotate = Annotate()) -> DataFrame:
    """clusters with id, target, barcode and how they were found.

    The id stands after the flank, the barcode after it up to the other flank.  An id that is no guide's is
    looked for in a window around its place: if one guide alone is found at the expected place, the
    cluster takes its target; if one alone is found anywhere, its target, its id and the barcode after it;
    else the target is Unknown.  guides (id, target) has a row for each guide, with ids of how.id_length.
    """
    a, n = how.flank, how.id_length
    known = guides.where("id <> ''").select("id", "target")
    exact = clusters.withColumns({"id": piece(F.col("sequence"), a, a + n), "barcode": piece(F.col("sequence"), F.lit(a + n), F.length("sequence") - a)})
    exact = exact.join(known, "id", "left")
    misses = exact.where("target is null").select("sequence").distinct()
    window = piece(F.col("sequence"), a - how.indel, a + n + how.indel + 1)
    hits = guides_within(misses.withColumn("w", window), known, n, 2 * how.indel + 2, how.substitutions)
    there, one_there, one = F.col("place") == how.indel, F.col("n_there") == 1, F.col("n") == 1
    found = hits.groupBy("sequence").agg(
        F.count("*").alias("n"), F.count(F.when(there, 1)).alias("n_there"), F.max(F.when(there, F.col("gtarget"))).alias("there_target"), F.max(F.struct("gtarget", "gid", "place")).alias("any")
    )
    salvaged = found.select(
        "sequence",
        F.when(one_there, F.col("there_target")).when(one, F.col("any.gtarget")).otherwise("Unknown").alias("s_target"),
        F.when(~one_there & one, F.col("any.gid")).alias("s_id"),
        F.when(~one_there & one, F.col("any.place")).alias("s_place"),
    )
    out = exact.join(salvaged, "sequence", "left")
    begin = F.col("s_place") + a - how.indel + n
    stop = begin + how.barcode_length - n if how.barcode_length else F.length("sequence") - a
    found = F.when(F.col("target").isNotNull(), "exact").when(F.coalesce("s_target", F.lit("Unknown")) == "Unknown", "unknown").otherwise("salvaged")
    return out.select(
        *clusters.columns,
        F.coalesce("s_id", "id").alias("id"),
        F.coalesce("target", "s_target", F.lit("Unknown")).alias("target"),
        F.when(F.col("s_place").isNotNull(), piece(F.col("sequence"), begin, stop)).otherwise(F.col("barcode")).alias("barcode"),
        found.alias("found"),
    )


def merged(clusters: DataFrame, by: tuple[str, ...] = ("sample", "target", "barcode")) -> DataFrame:
    """Clusters of one sample, target and barcode as one: counts summed, probabilities multiplied, the least distance, the commonest id (the smallest of equals)."""
    ids = clusters.groupBy(*by, "id").agg(
        F.count("*").alias("k"), *[F.sum(c).alias(c) for c in ("abundance", "n0", "n1", "nunq")], *[F.product(F.col(c)).alias(c) for c in ("pval", "birth_pval")], F.min("birth_ham").alias("birth_ham")
    )
    return ids.groupBy(*by).agg(
        F.min_by("id", F.struct(-F.col("k"), F.col("id"))).alias("id"), *[F.sum(c).alias(c) for c in ("abundance", "n0", "n1", "nunq")], *[F.product(F.col(c)).alias(c) for c in ("pval", "birth_pval")], F.min("birth_ham").alias("birth_ham")
    )


def merged_counts(found: DataFrame, by: tuple[str, ...] = ("sample", "target", "barcode")) -> DataFrame:
    """The older merge: abundance, nunq and n10 (n0 and n1 together) of the clusters of one sample, target (as RNA) and barcode."""
    sums = found.groupBy(*by).agg(F.sum("abundance").alias("abundance"), F.sum("nunq").alias("nunq"), F.sum(F.col("n0") + F.col("n1")).alias("n10"))
    return sums.withColumnRenamed("target", "RNA")


def annotation_summary(found: DataFrame) -> DataFrame:
    """For each sample: clusters, and the shares found exactly, salvaged and not, by cluster and by abundance."""
    kinds = ("exact", "salvaged", "unknown")
    shares = [F.avg((F.col("found") == k).cast("double")).alias(f"{k}_share") for k in kinds]
    weighed = [(F.sum(F.when(F.col("found") == k, F.col("abundance")).otherwise(0)) / F.sum("abundance")).alias(f"{k}_abundance") for k in kinds]
    return found.groupBy("sample").agg(F.count("*").alias("clusters"), *shares, *weighed)
