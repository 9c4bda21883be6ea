"""Spelling variants: words that differ by one code point, grouped by dense prefix-suffix tiles.

Two words, the longer one of length L, differ by one edit if their common prefix and their common suffix
together reach L - 1.  The place of the edit lies in one of two halves of the L places; outside of that half the
words are equal, so that words with the same rest are one group, and near words meet in the group of their half.
Groups that are too crowded are cut again, each into two with half the free places, which ends at the latest with
one free place, where a group has no more members than the alphabet has letters and one.

Tasks write the words of many groups as padded matrices of code points, one aligned to the left and one to the
right, and compare block pairs of rows: where two rows first differ tells the prefix, and the suffix in the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, light, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of words: with them a group with one free place has at most 26 + 64 + 1 members.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Bytes of a matrix and of a comparison of two blocks.
MATRIX, TILE = 1 << 23, 1 << 19


@dataclass(frozen=True)
class Spelling:
    """letters: least code points of a word; least: least occurrences; times: how much more frequent a form is; every: of so many runs one loses a code point; crowd: members of a group, more than 91."""

    letters: int = 7
    least: int = 2
    times: int = 10
    every: int = 31
    crowd: int = 2048


def occurring(docs: DataFrame, how: Spelling) -> DataFrame:
    """(word, n): the words of all texts, after the deletions that their documents' numbers call for."""
    # a shorter run can't become a longer word
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[{LETTERS}]{{{how.letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    h, place = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % how.every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= how.letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= how.least)


def segment(size: Column, low: Column, high: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def grouped(rows: DataFrame, segments: Column) -> DataFrame:
    """A row (word, n, size, low, high, g) for each segment; g is a hash of what is outside of places low to high of a word that has, or would have with one more, size code points."""
    some = rows.select("word", "n", F.explode(segments).alias("s")).select("word", "n", "s.*")
    tail = F.col("size") - F.col("high")
    head, end = F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.length("word") - tail + 1, tail)
    return some.withColumn("g", F.xxhash64("size", "low", "high", head, end))


def placed(words: DataFrame, how: Spelling) -> DataFrame:
    """The words in groups of how.crowd members at most."""
    n = F.length("word")
    halves = lambda size: [segment(size, F.lit(0), F.ceil(size / 2)), segment(size, F.ceil(size / 2), size)]
    rows, out = grouped(words, F.array(*halves(n), *halves(n + 1))), []
    while True:
        crowded = written(rows.groupBy("g").count().where(F.col("count") > how.crowd).select("g"), "crowded")
        if crowded.isEmpty():
            break
        few = light(crowded)
        out.append(rows.join(few, "g", "left_anti"))
        # a crowd has more than one free place but for hashes that collide, and those are told apart by what is left in common
        middle = F.col("low") + F.ceil((F.col("high") - F.col("low")) / 2)
        own = rows.join(few, "g", "left_semi").select("word", "n", F.array(segment(F.col("size"), F.col("low"), middle), segment(F.col("size"), middle, F.col("high"))).alias("halves"))
        rows = written(grouped(own, F.filter("halves", lambda s: s["low"] < s["high"])), "segments")
    for more in out:
        rows = rows.unionByName(more)
    return rows


def matrices(words: pa.StringArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points from the left and from the right; what is empty is 0."""
    _, ends, raw = words.buffers()
    at = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1]
    flat = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
    lead = flat == 0xC3  # letters beyond ASCII are C3 80 to C3 BF
    code = (flat + (np.concatenate([[False], lead[:-1]]) * np.uint8(0x40)))[~lead]
    length = np.diff(at) - np.add.reduceat(np.concatenate([lead, [False]]).astype(np.int64), at[:-1] - at[0])
    row = np.repeat(np.arange(len(words)), length)
    col = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    left, right = (np.zeros((len(words), size), np.uint8) for _ in range(2))
    left[row, col] = code
    right[row, np.repeat(length, length) - 1 - col] = code
    return length, left, right


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points agree before the first that doesn't, in the last axis."""
    same = a == b
    first = same.argmin(-1)
    return np.where(first > 0, first, np.where(same[..., 0], same.shape[-1], 0))


def blocks(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Block pairs that cover all pairs within groups: small groups share a block, larger ones are cut."""
    low = high = 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if high > low and (b - low > most or a != high):
            yield low, high, low, high
            low = high = a
        if b - a > most:
            for i in range(a, b, most):
                for j in range(i, b, most):
                    yield i, min(i + most, b), j, min(j + most, b)
            low = high = b
        else:
            low, high = (a, b) if high == low else (low, b)
    if high > low:
        yield low, high, low, high


def near_pairs(rows: pa.Table) -> pa.Table | None:
    """(word, near, n) in both directions of whole groups of one segment, sorted by g."""
    size, low, high = (rows[c][0].as_py() for c in ("size", "low", "high"))
    g = rows["g"].to_numpy()
    cut = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
    several = np.repeat(np.diff(cut) > 1, np.diff(cut))
    if not several.any():
        return None
    rows, g = rows.filter(pa.array(several)), g[several]
    words = rows["word"].combine_chunks()
    words = words if isinstance(words, pa.Array) else pa.concat_arrays(words.chunks)
    length, left, right = matrices(words, size)
    cut = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
    tail, found = size - high, []
    for a, b, c, d in blocks(cut[:-1], cut[1:], max(2, int((TILE / (high - low)) ** 0.5))):
        p = common(left[a:b, None, low:high], left[None, c:d, low:high])
        s = common(right[a:b, None, tail : tail + high - low], right[None, c:d, tail : tail + high - low])
        hit = (p + s >= high - low - 1) & (g[a:b, None] == g[None, c:d]) & ((length[a:b, None] == size) | (length[None, c:d] == size))
        if a == c:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        if len(i):
            found.append(np.stack([i + a, j + c]))
    if not found:
        return None
    i, j = np.concatenate(found, axis=1)
    # hashes may collide, so that whole words decide; a pair counts in the segment of its first difference only
    p, s = (np.concatenate([common(m[i[k : k + 4096]], m[j[k : k + 4096]]) for k in range(0, len(i), 4096)]) for m in (left, right))
    shorter = np.minimum(length[i], length[j])
    p, s = np.minimum(p, shorter), np.minimum(s, shorter)
    place = np.minimum(p, size - 1)
    own = (p + s >= size - 1) & (shorter >= size - 1) & (place >= low) & (place < high)
    i, j = i[own], j[own]
    one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    return pa.table({"word": words.take(one), "near": words.take(two), "n": rows["n"].take(two)})


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """near_pairs of sorted rows, of as many groups at once as fit in matrices of bounded size."""
    held: pa.Table | None = None
    for batch in _ended(batches):
        if batch is not None:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows * held["size"][0].as_py() < MATRIX and _one_segment(held):
                continue
        if held is None or not held.num_rows:
            continue
        keys = np.column_stack([held[c].to_numpy() for c in ("size", "low", "high", "g")])
        of_segment = np.concatenate([[0], np.flatnonzero((keys[1:, :3] != keys[:-1, :3]).any(1)) + 1])
        groups = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        whole = held.num_rows if batch is None else int(groups[-1])  # the last group may go on
        for low, high in zip(of_segment.tolist(), [*of_segment[1:].tolist(), held.num_rows], strict=True):
            high, step = min(high, whole), max(1, MATRIX // int(keys[low, 0]))
            while low < high:
                ends = groups[(groups > low) & (groups <= low + step)]
                after = groups[groups > low]
                end = high if low + step >= high else int(ends[-1]) if len(ends) else min(high, int(after[0]) if len(after) else high)
                pairs = near_pairs(held.slice(low, end - low))
                if pairs is not None:
                    yield from pairs.to_batches(max_chunksize=1 << 16)
                low = end
        held = held.slice(whole)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _one_segment(rows: pa.Table) -> bool:
    return all(rows[c][0].as_py() == rows[c][-1].as_py() for c in ("size", "low", "high"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word of forms (word, form), where steps double until nothing moves."""
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = written(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(ends)
        ends = both.drop("moved")
        if both.where("moved").isEmpty():
            return ends


def variants(docs: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs.

    docs: doc_id and text; other columns are ignored.  Words are the maximal runs of letters A to z and
    U+00C0 to U+00FF, in lower case as far as A to Z go; one in how.every runs, by the checksum of doc_id
    and run, has lost a code point.  A word has how.letters code points and how.least occurrences at least.
    A word's form is its most frequent near word, of equally frequent ones the smallest, if it is how.times
    as frequent; root is the form that forms lead to.  Null texts have no words, a null doc_id counts as
    empty, rows that repeat count again, texts and words of any length count whole, and no rows give no rows.
    """
    words = written(occurring(docs, how), "spellings")
    sorted_rows = placed(words, how).repartition("g").sortWithinPartitions("size", "low", "high", "g")
    pairs = sorted_rows.mapInArrow(tiled, "word string, near string, n long")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("near"))).alias("b"))
    near = written(best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.n")).alias("near_n")), "near")
    known = written(words.join(near, "word", "left").withColumn("fits", F.coalesce(F.col("near_n") >= how.times * F.col("n"), F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("near")).alias("form"), F.when(F.col("fits"), F.col("near_n")).alias("form_n")), "forms")
    dropped(words, near)
    roots = followed(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
