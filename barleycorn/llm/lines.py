"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Lines of equal sets are one class, known by its first line.  The words of a
class are ordered by rarity; two classes of Jaccard similarity t share a word among the first few of each (the
prefix), have sizes within a factor t, and leave room for enough common words after the places where the
shared word stands.  Candidate pairs that pass these filters are verified on the full sets, and a line with an
earlier match is removed.

DataFrame expressions only.  For a line one earlier match is enough: lines are first compared with the earliest
line that has one of their heads and with the BACK lines before them that have it, and only those that are left look
at all the others.  Heads are the HEADS rarest words and, as those of near copies in a crowd may be what each has of
its own, the TAILS last words of the prefix where they are common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, let, light, written

#: Cells of the table of word frequencies, an array of this many small numbers whatever the input's size.
CELLS = 1 << 22
#: Lines of more distinct words have a second bitmap.
LONG = 40
#: A line's rarest words, and the last of its prefix, by which it finds an earliest line; parts of the lines of a common word, each with its own.
HEADS, TAILS, PARTS = 3, 3, 32
#: Marks a common word in a prefix.
COMMON = 1 << 62
#: Lines before a line that are looked at beside the earliest one of a word.
BACK = 3
#: What names a line, in the order of lines: its document, a text's own number where rows repeat a doc_id, its place.
LINE = ("doc", "twin", "line")


@dataclass(frozen=True)
class Similar:
    """percent: the least Jaccard similarity; words: lines with fewer distinct words always stay; crowd: the lines of a word that occurs more often are dealt out in parts."""

    percent: int = 80
    words: int = 1
    crowd: int = 200


def cell(token: Column) -> Column:
    return F.shiftright(token, 32).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def rank(count: Column) -> Column:
    """A small number that grows with a word's occurrences: thirds of their logarithm."""
    return F.least(F.lit(120), F.floor(F.log2(count) * 3)).cast("tinyint")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, twin, text) of each row with a doc_id: white space but line ends as spaces, null texts left out; twin is 0 unless other rows repeat the doc_id."""
    text = F.when(F.col("text").rlike("[\\t\\x0B\\f\\r]"), F.regexp_replace("text", "[\\t\\x0B\\f\\r]", " ")).otherwise(F.col("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")
    return with_twin(plain, repeated(docs)).select("doc", "twin", text.alias("text"))


def repeated(docs: DataFrame) -> DataFrame:
    """The doc_ids of several rows."""
    return light(written(docs.groupBy(F.col("doc_id").cast("long").alias("doc")).count().where("count > 1 and doc is not null").select("doc", F.lit(True).alias("again")), "repeated"))


def with_twin(docs: DataFrame, again: DataFrame) -> DataFrame:
    return docs.join(again, "doc", "left").withColumn("twin", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("again")


def frequencies(docs: DataFrame) -> DataFrame:
    """One row with an array: for each cell of word hashes the rank of the most frequent word in it, by its occurrences in all documents.

    docs: from numbered().  Words are counted one by one, and only their ranks share cells.
    """
    hashed = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).select(F.shiftright(F.xxhash64("w"), 32).cast("int").alias("h"))
    ranked = hashed.groupBy("h").count().groupBy(F.col("h").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.max("count").alias("n")).select("cell", rank(F.col("n")).alias("rank"))
    full = docs.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(ranked, "cell", "left").select("cell", F.coalesce("rank", F.lit(0).cast("tinyint")).alias("rank"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "rank"))), lambda x: x["rank"]).alias("ranks"))  # CELLS small numbers


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc, twin, line, text) of each line of numbered() documents."""
    return docs.select("doc", "twin", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def rare_first(line: Column, ranks: Column) -> Column:
    """The distinct words of a line as positive 64-bit numbers in the order of rarity: the rank above, a hash below."""
    hashed = F.array_distinct(F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    return F.sort_array(F.transform(hashed, lambda t: F.shiftleft(F.coalesce(F.get(ranks, cell(t)), F.lit(0).cast("tinyint")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(t, 8))))


def with_prefix(lines: DataFrame, ranks: Column, how: Similar) -> DataFrame:
    """LINE, n, h and g (a digest of the set), bits and more (the parity of words by bit), and prefix.

    A line of n words shares one of its first n - ceil(t n) + 1 with any similar line.  Of these prefix has the
    words that occur more than once, each as its place in the line above and its hash below; COMMON is added to those
    that occur more often than how.crowd.
    """
    n, long = F.col("n"), F.col("n") > LONG
    first = F.slice("tokens", 1, F.greatest(F.lit(0), n - F.expr(f"({how.percent} * n + 99) div 100").cast("int") + 1))
    common = lambda t: F.when(F.shiftright(t, 56) >= rank(F.lit(how.crowd)), F.lit(COMMON)).otherwise(F.lit(0).cast("long"))
    packed = F.transform(first, lambda t, k: F.when(F.shiftright(t, 56) > 0, F.shiftleft(k.cast("long"), 32).bitwiseOR(F.hash(t).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseOR(common(t))))
    sized = lines.select(*LINE, rare_first(F.col("text"), ranks).alias("tokens")).withColumn("n", F.size("tokens"))
    flip = "a ^ shiftleft(1L, int(t & 63))"
    parity = lambda step: F.expr(f"aggregate(tokens, 0L, (a, t) -> {step})")
    return sized.select(
        *LINE, "n", F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("g"),
        # a bitmap for each half of a long line's words
        F.when(long, parity(f"if(t & 64 = 0, {flip}, a)")).otherwise(parity(flip)).alias("bits"), F.when(long, parity(f"if(t & 64 = 0, a, {flip})")).alias("more"),
        F.array_compact(packed).alias("prefix"),
    )


def side(names, x: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{x}") for c in names]


ENDS = [f"{c}_{x}" for x in "ab" for c in LINE]


#: far, the distance of two lines' bitmaps.
FAR = "if(a.more is null or b.more is null, bit_count(a.bits ^ coalesce(a.more, 0L) ^ b.bits ^ coalesce(b.more, 0L)), bit_count(a.bits ^ b.bits) + bit_count(a.more ^ b.more))"


def allowed(how: Similar, b: str = "b", first: bool = False) -> str:
    """Whether b is earlier than a, and two lines with a common word in their prefixes pass the length, positional and bitmap filters; a line that is done looks at no other.

    first: the word has to be the first one that the lines share.  A word isn't if the same one stands before it in both
    prefixes; the pair passes by that one, as fewer words stand before it.
    """
    need = f"({how.percent} * (a.n + b.n) + {99 + how.percent}) div {100 + how.percent}"
    later = "(b.doc < a.doc or b.doc = a.doc and (b.twin < a.twin or b.twin = a.twin and b.line < a.line))"
    length = f"100 * least(a.n, b.n) >= {how.percent} * greatest(a.n, b.n)"
    # before the shared word at most the smaller place's words are common, none if it is the first, after it at most the smaller rest
    common = f"{'' if first else 'least(a.place, b.place) + '}least(a.n - a.place, b.n - b.place)"
    positional = f"if(a.done, -1 - int(b.done), {common}) >= {need}"
    fresh = " and coalesce(a.before <> b.before, true)" if first else ""
    # each word that only one has changes the parity of one bit at most
    return f"{later} and {length} and {positional}{fresh} and {FAR} <= a.n + b.n - 2 * ({need})".replace("b.", f"{b}.")


def earliest(rows: DataFrame, how: Similar) -> DataFrame:
    """Pairs of a line and the nearest one of the earliest one of a word and the BACK ones before the line; of a common word, of the line's part of it."""
    part = F.when(F.col("common"), F.pmod(F.xxhash64(*LINE), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    heads = rows.select("token", part.alias("part"), F.struct(*LINE, "n", "bits", "more", "place", "done").alias("a"))
    order = Window.partitionBy("token", "part").orderBy(*[f"a.{c}" for c in LINE])
    others = {"b0": F.first("a").over(order)} | {f"b{i}": F.lag("a", i).over(order) for i in range(1, BACK + 1)}
    found = [F.when(F.expr(allowed(how, b)), F.struct(F.expr(FAR.replace("b.", f"{b}.")).alias("far"), *[F.col(f"{b}.{c}").alias(f"{c}_b") for c in (*LINE, "n")])) for b in others]
    near = heads.select("a", *[c.alias(b) for b, c in others.items()]).select("a", F.least(*found).alias("m")).where("m is not null")
    return near.select(*[F.col(f"a.{c}").alias(f"{c}_a") for c in (*LINE, "n")], "m.*")


def candidates(rows: DataFrame, how: Similar) -> DataFrame:
    """Pairs of a line that isn't done and an earlier one, by the first word that their prefixes share."""
    ends = [*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in (*LINE, "n")], F.expr(FAR).alias("far")]
    # the condition reads done of either side, so that both have one shuffle
    return rows.alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & F.expr(allowed(how, first=True))).select(*ends).distinct()


def nearest(pairs: DataFrame) -> DataFrame:
    """Of each later line the pair of least distance."""
    a, b = [F.col(c) for c in ENDS[:3]], [F.col(c) for c in ENDS[3:]]
    return pairs.groupBy(*a).agg(F.min(F.struct("far", *b, "n_a", "n_b")).alias("m")).select(*a, "m.*")


def verified(pairs: DataFrame, docs: DataFrame, how: Similar) -> DataFrame:
    """The later lines (LINE) of the pairs that are similar by their full sets of words; lines' texts are read again, and compared as they are."""
    ends = written(pairs.select(F.explode(F.array(*[F.struct(*[F.col(f"{c}_{x}").alias(c) for c in LINE]) for x in "ab"])).alias("e")).select("e.*").distinct(), "ends")
    some = docs.join(light(ends.select("doc", "twin").distinct()), ["doc", "twin"], "left_semi")
    texts = written(split_lines(some).join(light(ends), list(LINE), "left_semi").dropDuplicates(list(LINE)), "texts")
    one, two = (texts.select(*side((*LINE, "text"), x)) for x in "ab")
    both = F.size(F.array_intersect(F.array_remove(F.split("text_a", " "), ""), F.array_remove(F.split("text_b", " "), "")))
    joined = pairs.join(one, [f"{c}_a" for c in LINE]).join(two, [f"{c}_b" for c in LINE]).withColumn("both", both)
    similar = joined.where(100 * F.col("both") >= how.percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
    found = written(similar.select(*[F.col(f"{c}_a").alias(c) for c in LINE]).distinct(), "matched")
    dropped(ends, texts)
    return found


def later_matches(docs: DataFrame, how: Similar = Similar()) -> DataFrame:
    """(doc, twin, line) of each line with an earlier line that is at least as similar as how says.

    docs: from numbered().
    """
    ranks = written(frequencies(docs), "ranks")
    # short lines are left out after they are written: a condition on the words would have them made twice
    ranked = split_lines(docs).withColumn("ranks", ranks.scalar())
    all_lines = written(with_prefix(ranked, F.col("ranks"), how), "lines")
    lines = all_lines.where(F.col("n") >= how.words)
    # equal sets: all but the first of each class go, and the first stands for it
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct(*LINE)).alias("c"), F.count("*").alias("count")).where("count > 1").select("h", "g", F.col("c").alias("first"))
    firsts = written(firsts, "firsts")
    placed = lines.join(light(firsts), ["h", "g"], "left").withColumn("again", F.coalesce(F.struct(*LINE) != F.col("first"), F.lit(False)))
    equal = written(placed.where("again").select(*LINE), "equal")
    # a line of n words has n / (n + 1) at most in common with another set: shorter ones match equal sets only
    long_enough = f"100 * n >= {how.percent} * (n + 1)"
    reps = placed.where("not again").where(long_enough).select(*LINE, "n", "bits", "more", "prefix")
    heads = F.filter("prefix", lambda x, k: (k < HEADS) | (x >= COMMON) & (k >= F.size("prefix") - TAILS))
    exploded = lambda df: df.select("*", F.posexplode("prefix").alias("k", "packed"))
    word = lambda packed: F.shiftright(F.shiftleft(packed, 32), 32).cast("int")
    above = F.shiftright("packed", 32).cast("int")
    parts = {"place": above.bitwiseAND(F.lit((1 << 30) - 1)), "common": F.col("packed") >= COMMON, "token": word("packed"), "before": word(F.get("prefix", F.col("k") - 1))}
    words = lambda df: exploded(df).withColumns(parts).drop("packed", "prefix", "k")
    # each line's nearest one is enough here
    first = verified(written(nearest(earliest(words(reps.withColumns({"prefix": heads, "done": F.lit(False)})), how)), "nearest"), docs, how)
    # those that are left look at all lines, and again at the nearest one first
    marked = reps.join(light(first.withColumn("found", F.lit(True))), list(LINE), "left").withColumn("done", F.coalesce("found", F.lit(False))).drop("found")
    pairs = written(candidates(words(marked).drop("common"), how), "pairs")
    near = written(nearest(pairs), "nearest")
    second = verified(near, docs, how)
    ends = [f"{c}_a" for c in LINE]
    others = pairs.join(light(second.select(*side(LINE, "a"))), ends, "left_anti").join(near.select(*ENDS), ENDS, "left_anti")
    third = verified(written(others, "others"), docs, how)
    dropped(ranks, all_lines, firsts, pairs, near)
    return equal.unionByName(first).unionByName(second).unionByName(third)


def deduplicated(docs: DataFrame, how: Similar = Similar()) -> DataFrame:
    """docs with text rid of each line that an earlier one matches, and with n_lines and n_removed.

    docs: doc_id, text and whatever else, which stays; given columns n_lines and n_removed are replaced.
    Lines end at \\n, words are divided by ASCII white space, and a line is its set of words; lines are
    ordered by doc_id and place, and of equal ones the first stays.  Lines without words stay, as do those
    with fewer than how.words distinct words.  Lines and texts of any length count whole.  Null text stays
    null with no lines.  Rows without doc_id stay as they are and match nothing.  Rows that repeat a doc_id
    are documents of their own where their texts differ, in an order of hashes; those of equal text are one
    document, and each gets the text that is left of it.  No rows give no rows.
    """
    late = later_matches(numbered(docs), how)
    removed = written(late.groupBy("doc", "twin").agg(F.array_distinct(F.collect_list("line")).alias("__removed")), "removed")
    removed = light(removed, weight=F.size("__removed"))
    again = repeated(docs).withColumnRenamed("doc", "__doc").withColumnRenamed("again", "__again")
    keyed = docs.join(again, docs["doc_id"].cast("long") == F.col("__doc"), "left").withColumn("__twin", F.when(F.col("__again"), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long"))).drop("__doc", "__again")
    joined = keyed.join(removed.withColumnsRenamed({"doc": "__doc", "twin": "__also"}), (keyed["doc_id"].cast("long") == F.col("__doc")) & (F.col("__twin") == F.col("__also")), "left").drop("__doc", "__also", "__twin")
    kept = let(F.split("text", "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__removed")), lambda i: F.get(x, i)))
    counts = {"n_lines": F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, "n_removed": F.coalesce(F.size("__removed"), F.lit(0))}
    text = F.when(F.col("__removed").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(counts["n_lines"]), "n_removed": F.when(F.col("__removed").isNull(), 0).otherwise(counts["n_removed"]), "text": text}).drop("__removed")
