"""Design of guide ids: k-mers that are balanced, free of runs and restriction sites, and far from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gc_count, hamming, longest_run
from ..storage import removed, written


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """(id): the 4^k strings of length k."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(F.array(*[F.lit(c) for c in "ACGT"]), (F.floor(F.col("id") / F.pow(F.lit(4.0), i)) % 4).cast("int")))
    return spark.range(4**k).select(F.array_join(digits, "").alias("id"))


def usable(kmers: DataFrame, k: int, sites: tuple[str, ...] = (), before: str = "", after: str = "", longest: int = 2) -> DataFrame:
    """Half of the bases G or C, no run over longest, no restriction site in the id between its neighbours."""
    whole = F.concat(F.lit(before), F.col("id"), F.lit(after))
    out = kmers.where((gc_count(F.col("id")) == k // 2) & (longest_run(F.col("id")) <= longest))
    for site in sites:
        out = out.where(~F.contains(whole, F.lit(site)))
    return out


def too_close(ids: DataFrame, k: int, distance: int) -> DataFrame:
    """(id, other): pairs of different ids of length k with fewer than distance substitutions, in both directions.

    One of distance pieces is left whole by distance - 1 substitutions: an equi-join on pieces.
    """
    cuts = [k * x // distance for x in range(distance + 1)]
    part = lambda a, b: F.col("id").substr(F.lit(a + 1), F.lit(b - a))
    keyed = ids.select("id", F.posexplode(F.array(*[part(a, b) for a, b in zip(cuts, cuts[1:], strict=False)])).alias("place", "part"))
    both = keyed.join(keyed.withColumnRenamed("id", "other"), ["place", "part"]).where("id <> other")
    return both.where(hamming(F.col("id"), F.col("other"), k) < distance).select("id", "other").distinct()


def taken_apart(ids: DataFrame, k: int, distance: int = 3) -> DataFrame:
    """(id): the ids that far_apart() takes, found in parallel.

    ids: distinct ids of length k.  In each round an id without a smaller undecided one too close to it is taken,
    and all that are too close to it go: what is decided doesn't depend on the order of the others, so the rounds
    end with what taking them one by one ends with.
    """
    close = written(too_close(ids, k, distance), "close")
    open_ids, done = written(ids.select("id"), "open"), []
    while not open_ids.isEmpty():
        edges = close.join(open_ids, "id", "left_semi").join(open_ids.withColumnRenamed("id", "other"), "other", "left_semi")
        waiting = edges.where("other < id").select("id").distinct()
        done.append(written(open_ids.join(waiting, "id", "left_anti"), "taken"))
        gone = done[-1].unionByName(edges.join(done[-1].withColumnRenamed("id", "other"), "other", "left_semi").select("id")).distinct()
        left = written(open_ids.join(gone, "id", "left_anti"), "open")
        removed(open_ids)
        open_ids = left
    out = ids.select("id").limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def far_apart(ids: list[str], distance: int = 3) -> list[str]:
    """In order, each id at least so far from those taken before; for the few thousand ids of a design."""
    taken: list[str] = []
    for i in sorted(ids):
        if all(sum(a != b for a, b in zip(i, t, strict=True)) >= distance for t in taken):
            taken.append(i)
    return taken
