"""Quality rules: fixed base rules, and robust multivariate outliers among what passes them.

Every text's statistics are transformed into a vector.  For each language and source a
minimum-covariance-determinant estimate is made: from several starts, concentration steps over the distinct
vectors, each taking the share of vectors nearest by Mahalanobis distance; the start that ends with the least
determinant wins.  Documents far from their group's estimate are rejected.  All of it is DataFrame expressions; group sums are partial aggregates, and quantiles come
from counts in bins of fixed width, so a group of any size is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, light, words, written

SYMBOLS = "[#*$%&|<>]"
#: Share of a group's distinct vectors in the subset, concentration steps, vectors that an estimate needs, bins a unit of log distance.
SHARE, STEPS, LEAST, BINS = 0.75, 5, 60, 64
#: Starts: the first from medians, the others from random parts of a group's vectors, one of PARTS each.
STARTS, PARTS = 3, 8
#: Estimates of up to so many groups are broadcast.
GROUPS = 20_000
#: Median of a chi-squared variable of five degrees, by which distances are scaled as the subset is too narrow, and the squared
#: distance beyond which a vector is an outlier: a quantile of tail 7e-18, as texts' statistics have far longer tails than a normal law.
MEDIAN, CUTOFF = 4.351, 90.0
#: Transformed statistics with the least standard deviation that counts as spread.
FEATURES = {"x_length": 0.08, "x_symbols": 0.25, "x_lines": 0.25, "x_repeats": 0.35, "x_shout": 0.25}
P = len(FEATURES)


def repeated(w: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(t: Column) -> Column:
        by_hash = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = let(by_hash, lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"])))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t))))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_shouted (capital letters and exclamation marks) of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated(w).alias("n_repeat_words")))
    found = docs.withColumn("__counted", counted)
    whole = {
        "n_words": F.col("__counted.n_words"),
        "word_chars": F.col("__counted.word_chars"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.col("__counted.n_repeat_words"),
        "n_shouted": F.length(F.regexp_replace(text, "[^\\p{Lu}!]+", "")),
    }
    return found.withColumns({k: v.cast("long") for k, v in whole.items()}).drop("__counted")


def vector() -> dict[str, Column]:
    """The transformed statistics; counts are offset so that short texts aren't far from the rest by chance."""
    n, chars = F.col("n_words"), F.col("word_chars")
    logit = lambda part, whole, prior: F.log((part + prior) / (whole - part + 20 * prior))
    return {
        "x_length": F.log((chars + 50) / (n + 10)),
        "x_symbols": logit(F.col("n_symbols"), F.greatest(chars, F.col("n_symbols")), 6.0),
        "x_lines": logit(F.col("n_dup_lines"), F.col("n_dup_lines") + 20, 5.0),
        "x_repeats": logit(F.col("n_repeat_words"), n, 20.0),
        "x_shout": logit(F.col("n_shouted"), F.greatest(chars, F.col("n_shouted")), 10.0),
    }


def solved(groups: DataFrame) -> DataFrame:
    """groups with the inverse Cholesky factor w_i_j of each covariance c_i_j, and log_det."""
    out = groups
    for j in range(P):
        rest = reduce(lambda a, k: a - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{j}_{j}"))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(rest))
        below = {f"l_{i}_{j}": reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}")) / F.col(f"l_{j}_{j}") for i in range(j + 1, P)}
        out = out.withColumns(below) if below else out
    for i in range(P):
        out = out.withColumn(f"w_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
        for j in range(i):
            dot = reduce(lambda a, k: a + F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}"), range(j + 1, i), F.col(f"l_{i}_{j}") * F.col(f"w_{j}_{j}"))
            out = out.withColumn(f"w_{i}_{j}", -dot / F.col(f"l_{i}_{i}"))
    log_det = reduce(lambda a, i: a + F.log(f"l_{i}_{i}"), range(P), F.lit(0.0)) * 2
    return out.select("group", "n", log_det.alias("log_det"), *[f"m_{i}" for i in range(P)], *[f"w_{i}_{j}" for i in range(P) for j in range(i + 1)])


def distance() -> Column:
    """Squared Mahalanobis distance of x_i from the estimate of m_i and w_i_j."""
    x = [F.col(f) - F.col(f"m_{i}") for i, f in enumerate(FEATURES)]
    rows = [reduce(lambda a, j: a + F.col(f"w_{i}_{j}") * x[j], range(i), F.col(f"w_{i}_{i}") * x[i]) for i in range(P)]
    return reduce(lambda a, r: a + r * r, rows[1:], rows[0] * rows[0])


def moments(vectors: DataFrame) -> DataFrame:
    """Mean and covariance of each group's vectors, with the least spread added to the diagonal."""
    # sums around a fixed point near all vectors keep their precision
    x = [F.round(F.col(f) * 65536).cast("long") for f in FEATURES]
    sums = [F.sum(v).alias(f"s_{i}") for i, v in enumerate(x)] + [F.sum((x[i] * x[j]).cast("decimal(38,0)")).cast("double").alias(f"q_{i}_{j}") for i in range(P) for j in range(i + 1)]
    out = vectors.groupBy("group").agg(F.count("*").alias("n"), *sums)
    out = out.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") / 65536.0 for i in range(P)})
    least = list(FEATURES.values())
    return out.withColumns({f"c_{i}_{j}": F.col(f"q_{i}_{j}") / F.col("n") / 65536.0**2 - F.col(f"m_{i}") * F.col(f"m_{j}") + (least[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)})


def quantiles(vectors: DataFrame, value: Column, share: float) -> DataFrame:
    """(group, bin, within) where bin is the least at which the share of a group's vectors is reached."""
    bins = vectors.groupBy("group", F.floor(value).alias("bin")).count()
    total, so_far = F.sum("count").over(Window.partitionBy("group")), F.sum("count").over(Window.partitionBy("group").orderBy("bin"))
    return bins.withColumns({"total": total, "so_far": so_far}).where(F.col("so_far") >= share * F.col("total")).groupBy("group").agg(F.min("bin").alias("bin"))


def estimates(vectors: DataFrame) -> DataFrame:
    """(group, n, log_det, m_i, w_i_j, scale): of each group the concentrated estimate of least determinant; vectors: group and the features, distinct."""
    log_d2 = lambda: F.log(distance() + 1e-9) * BINS
    few = vectors.select("group").distinct().count() <= GROUPS
    small = lambda df: F.broadcast(df) if few else df
    # the first start: medians, and spreads by the median distance from them, feature by feature
    long = vectors.select("group", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("x")) for i, f in enumerate(FEATURES)])).alias("e")).select(F.struct("group", "e.i").alias("group"), "e.x")
    middle = quantiles(long, F.col("x") * BINS, 0.5).select("group", ((F.col("bin") + 0.5) / BINS).alias("median"))
    middle = written(middle, "medians")
    spread = quantiles(long.join(small(middle), "group"), F.abs(F.col("x") - F.col("median")) * BINS, 0.5).select("group", ((F.col("bin") + 0.5) / BINS * 1.4826).alias("spread"))
    both = middle.join(spread, "group").select(F.col("group.group").alias("group"), F.col("group.i").alias("i"), "median", "spread")
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    central = both.groupBy("group").agg(*[pick(i, "median").alias(f"m_{i}") for i in range(P)], *[(pick(i, "spread") ** 2 + least**2).alias(f"c_{i}_{i}") for i, least in enumerate(FEATURES.values())])
    central = central.withColumns({f"c_{i}_{j}": F.lit(0.0) for i in range(P) for j in range(i)} | {"n": F.lit(0).cast("long"), "group": F.struct("group", F.lit(0).alias("start"))})
    # the others: moments of a random part
    started = lambda k: F.struct("group", k.cast("int").alias("start"))
    part = F.pmod(F.xxhash64(*FEATURES), F.lit(PARTS))
    parts = moments(vectors.where(part < STARTS - 1).select(started(part + 1).alias("group"), *FEATURES))
    now = written(solved(central.unionByName(parts.select(*central.columns))), "estimates")
    tried = vectors.select(F.explode(F.array(*[started(F.lit(k)) for k in range(STARTS)])).alias("group"), *FEATURES)
    for _ in range(STEPS):
        placed = tried.join(small(now.drop("n", "log_det")), "group").select("group", *FEATURES, F.floor(log_d2()).alias("at"))
        near = quantiles(placed, F.col("at"), SHARE)
        now = written(solved(moments(placed.join(small(near), "group").where(F.col("at") <= F.col("bin")).select("group", *FEATURES))), "estimates")
    best = now.groupBy(F.col("group.group").alias("of")).agg(F.min_by(F.struct(*now.columns), F.struct("log_det", "group.start")).alias("e")).select(F.col("of").alias("group"), *[F.col(f"e.{c}") for c in now.columns if c != "group"])
    best = written(best, "best")
    placed = vectors.join(small(best), "group").select("group", log_d2().alias("at"))
    scale = quantiles(placed, F.col("at"), 0.5).select("group", F.greatest(F.exp((F.col("bin") + 0.5) / BINS) / MEDIAN, F.lit(0.5)).alias("scale"))
    return best.join(scale, "group")


def judged(docs: DataFrame) -> DataFrame:
    """docs with the statistics, base_failed, distance and kept of each row.

    docs: doc_id, text, lang and source; other columns are ignored.  Null text has no words; null languages and
    sources are groups of their own.  A group with fewer than LEAST distinct vectors takes its language's
    estimate, a small language the estimate of all; if that is small too, nothing more than the base rules
    rejects.  Repeated rows count once in the estimates.  Outliers by the estimate alone are rejected.  Texts
    of any length are measured whole.  Given columns of these names aren't read.  No rows give no rows.
    """
    counted = written(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    return verdicts(counted)


def verdicts(counted: DataFrame) -> DataFrame:
    """base_failed, distance and kept of rows with statistics."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    own, language, everything = F.concat_ws("\u0001", name("lang"), name("source")), name("lang"), F.lit("")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marked = counted.withColumns({"base_failed": failed, "own": own, "language": F.concat(F.lit("\u0002"), language)} | vector())
    vectors = marked.where("not base_failed").select("own", "language", *FEATURES).distinct()
    sizes = vectors.groupBy("own", "language").count()
    all_sizes = sizes.withColumn("in_language", F.sum("count").over(Window.partitionBy("language")))
    group = F.when(F.col("count") >= LEAST, F.col("own")).when(F.col("in_language") >= LEAST, F.col("language")).otherwise(everything)
    chosen = written(all_sizes.select("own", "language", group.alias("group")), "groups")
    needed = chosen.select("group").distinct()
    keyed = vectors.withColumn("group", F.explode(F.array("own", "language", everything))).join(needed, "group", "left_semi").select("group", *FEATURES).distinct()
    found = light(written(estimates(written(keyed, "vectors")).where(F.col("n") >= LEAST * SHARE), "found"), GROUPS)
    out = marked.join(light(chosen.select("own", "group"), GROUPS), "own", "left").join(found, "group", "left").withColumn("distance", distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return out.withColumn("kept", kept).select(*counted.columns, "base_failed", "distance", "kept")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that judged() keeps; rows of one doc_id are told apart by text, lang and source."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    print_of = F.xxhash64("text", name("lang"), name("source"))
    counted = written(statistics(docs.select("doc_id", "text", "lang", "source")).withColumn("print", print_of).drop("text"), "statistics")
    gone = written(verdicts(counted).where("not kept").select(F.col("doc_id").alias("__doc"), F.col("print").alias("__print")).distinct(), "gone")
    return docs.join(light(gone), docs["doc_id"].eqNullSafe(F.col("__doc")) & (print_of == F.col("__print")), "left_anti")
