"""Phrase collocations, counted by double-array tries.

Candidates are Apriori-safe: a phrase is looked for only if its two parts without the last and without the first
word can be frequent.  What can be frequent is told by occurrences in hashed buckets, of which there are a fixed
number, so that nothing that grows with the corpus is broadcast for it, and nothing frequent is missed.

Most frequent phrases come nowhere near a language's first ones.  A floor below the score of its last one is guessed
from a part of the phrases, by a hash of them, that is counted over all texts.  A phrase is a candidate if its bucket
leaves it a score of the floor, or if a phrase inside it, or one that it is a part of, needs its occurrences.  As every
phrase from the floor on is found and dropped or kept rightly, a language that keeps enough of them has its first ones
exactly; one that keeps fewer is done again without a floor.

Candidates are dealt out to tries of bounded size by a hash of their first two words, each built in a task, so that
a position in a text belongs to one trie.  A trie's symbols are the halves of a
word's number; it is a double array, where the child of state s by symbol c is base[s] + c if check has s there.
Tasks take the texts as byte arrays, and numpy advances the states of all words' positions at once, word by word;
accepting states are counted by bincount.  A few tries are broadcast at a time; their shards of counts are summed.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Bytes by kind: 0 belongs to a word, 1 stands between words, 2 ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text that are looked at together, and rows that are handed on together.
SLICE, ROWS = 1 << 21, 1 << 16


@dataclass(frozen=True)
class Phrases:
    """longest: words of a phrase at most; least: occurrences of a candidate; percent: a candidate goes if a longer one that holds it has that share of its occurrences; top: phrases of a language.

    bits: 2 ** bits buckets; shard: phrases of a trie; at_once: tries that are broadcast together.
    every: one in so many phrases is counted for the floors; known: frequent words whose occurrences are broadcast, at most.
    """

    longest: int = 3
    least: int = 10
    percent: int = 50
    top: int = 2000
    bits: int = 26
    shard: int = 1 << 19
    at_once: int = 8
    every: int = 64
    known: int = 1 << 18


def hashed(names: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def paired(lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A positive number for the hashes of a language and two words."""
    with np.errstate(over="ignore"):
        return (mixed(mixed(lang, one), two) >> np.uint64(1)).astype(np.int64)


@dataclass
class Tokens:
    """Words of a slice of texts: number among the distinct words, index of the language, and whether the next word stands in the same piece."""

    code: np.ndarray
    lang: np.ndarray
    joined: np.ndarray
    words: pa.StringArray
    langs: pa.StringArray

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the languages and words by position."""
        return hashed(self.langs)[self.lang], hashed(self.words)[self.code]

    def pairs(self) -> np.ndarray:
        """Numbers of a language, a word and the next one, by position but the last, which deal phrases to tries."""
        lang, word = self.hashes()
        return paired(lang[:-1], word[:-1], word[1:])


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that end where a text or, in a long one, a piece ends."""
    low, end = int(offsets[0]), int(offsets[-1])
    while low < end:
        high = min(low + size, end)
        if high < end:
            text = int(offsets[np.searchsorted(offsets, high, "right") - 1])
            if text > low:
                high = text
            else:  # a text longer than size: its last piece that ends in time, or the first one
                ends = np.flatnonzero(KIND[data[low:high]] == 2)
                while not len(ends) and high < end and KIND[data[high]] != 2:
                    high += 1
                high = low + int(ends[-1]) + 1 if len(ends) else min(high + 1, end)
        yield low, high
        low = high


def tokens(batch: pa.RecordBatch) -> Iterator[Tokens]:
    """The words of a batch of (lang, text), without nulls."""
    lang, text = (batch.column(i) for i in (0, 1))
    _, ends, raw = text.buffers()
    offsets = np.frombuffer(ends, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data, by_lang = np.frombuffer(raw, np.uint8), lang.dictionary_encode()
    of_row = by_lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high in slices(data, offsets):
        part = data[low:high]
        kind = KIND[part]
        inside = kind == 0
        fresh = np.zeros(len(part), bool)  # where a text begins
        bounds = offsets[(offsets >= low) & (offsets < high)] - low
        fresh[bounds] = True
        start = np.flatnonzero(inside & (fresh | np.concatenate([[True], ~inside[:-1]])))
        if not len(start):
            continue
        stop = np.flatnonzero(inside & np.concatenate([fresh[1:] | ~inside[1:], [True]])) + 1
        joined = np.ones(len(start), bool)
        before = np.searchsorted(start, np.concatenate([np.flatnonzero(kind == 2), bounds]))
        joined[before[before > 0] - 1] = False
        joined[-1] = False
        at = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(LOWER[part[inside]])).dictionary_encode()
        row = np.searchsorted(offsets, start + low, "right") - 1
        yield Tokens(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of_row[row], joined, coded.dictionary, by_lang.dictionary)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


#: Buckets have levels: 0 with fewer than the least occurrences, then one more for each doubling, up to LEVELS.
LEVELS = 15


def level(levels: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The levels of buckets, two of which share a byte."""
    return (levels[bucket >> 1] >> ((bucket & 1) << 2).astype(np.uint8)) & 15


def most(levels: np.ndarray, bucket: np.ndarray, how: Phrases) -> np.ndarray:
    """What a phrase of a bucket may occur at most; 0 if it can't be frequent."""
    upper = how.least * 2.0 ** np.arange(LEVELS + 1) - 1
    upper[[0, LEVELS]] = 0, np.inf
    return upper[level(levels, bucket)]


def grams(t: Tokens, maps: dict[int, np.ndarray], longest: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, positions, buckets) for phrases of 2 to longest words, as long as maps tell which shorter ones can be frequent."""
    lang, word = t.hashes()
    with np.errstate(over="ignore"):
        g, possible = mixed(lang, word), np.ones(len(word), bool)
        for k in range(2, longest + 1):
            n = len(word) - k + 1
            if n <= 0 or k > 2 and k - 1 not in maps:
                return
            fits = possible[:n] & possible[1 : n + 1] & t.joined[k - 2 : k - 2 + n] if k > 2 else t.joined[:n]
            g = mixed(g[:n], word[k - 1 :])
            bucket = (g >> np.uint64(64 - bits)).astype(np.int64)
            yield k, np.flatnonzero(fits), bucket
            possible = fits
            if k in maps:
                possible = fits & (level(maps[k], bucket) > 0)


def spelled(t: Tokens, at: np.ndarray, k: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The distinct languages and phrases of k words at some positions, their first positions, and how many have each."""
    size, key = len(t.words), t.lang[at]
    for j in range(k):
        if j:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + t.code[at + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    at = at[first]
    return [t.langs.take(pa.array(t.lang[at])), pc.binary_join_element_wise(*[t.words.take(pa.array(t.code[at + j])) for j in range(k)], " ")], at, n


def merged(tables: list[pa.Table], by: list[str], sums: bool) -> list[pa.Table]:
    """Tables as one without repetitions, n added up."""
    whole = pa.concat_tables(tables).group_by(by, use_threads=False)
    out = whole.aggregate([("n", "sum")] if sums else [])
    return [pa.table([out[c] for c in by] + ([out["n_sum"]] if sums else []), names=[*by, *(["n"] if sums else [])])]


def gathered(found: Iterator[pa.Table], by: list[str], sums: bool, most: int = 1 << 21) -> Iterator[pa.Table]:
    """The tables merged as far as most rows go."""
    held: list[pa.Table] = []
    fresh = 0
    for table in found:
        held.append(table)
        fresh += table.num_rows
        if fresh > most:
            held, fresh = merged(held, by, sums), 0
            if held[0].num_rows > most:
                yield held.pop()
    if held:
        yield merged(held, by, sums)[0]


def counted(texts: DataFrame, maps, k: int, how: Phrases) -> DataFrame:
    """(lang, word, n, cell, places, counts): occurrences of words, if k is 2, and of buckets of phrases of k words.

    Buckets are handed on in cells, as arrays of 16-bit places and counts, so that a row stands for thousands.
    """
    shape = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("cell", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, full = maps.value, [], []

        def cells() -> pa.RecordBatch:
            b, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            n = np.minimum(n, 65535).astype(np.uint16)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(b >> 16)) + 1, [len(b)]])
            ends = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            low = (b & 65535).astype(np.uint16)
            none = pa.nulls(len(ends), pa.string())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(ends), pa.int64()), pa.array(b[cut[:-1]] >> 16, pa.int32()), pa.array([low[x:y].tobytes() for x, y in ends], pa.binary()), pa.array([n[x:y].tobytes() for x, y in ends], pa.binary())], schema=shape)

        def words() -> Iterator[pa.Table]:
            for batch in batches:
                for t in tokens(batch):
                    for size, at, bucket in grams(t, known, k, how.bits):
                        if size == k and len(at):
                            held.append(bucket[at].astype(np.int32))
                    if sum(map(len, held)) > 1 << 22:
                        full.append(cells())
                    if k == 2:
                        key, n = np.unique(t.lang * len(t.words) + t.code, return_counts=True)
                        yield pa.table([t.langs.take(pa.array(key // len(t.words))), t.words.take(pa.array(key % len(t.words))), pa.array(n, pa.int64())], names=["lang", "word", "n"])
                    else:
                        yield pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["lang", "word", "n"])

        def out() -> Iterator[pa.Table | pa.RecordBatch]:
            for table in gathered(words(), ["lang", "word"], True):
                yield pa.table([table["lang"], table["word"], table["n"], *[pa.nulls(table.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]], schema=shape)
                while full:
                    yield full.pop()
            if held:
                full.append(cells())
            while full:
                yield full.pop()

        for x in out():
            yield from x.to_batches(max_chunksize=ROWS) if isinstance(x, pa.Table) else [x]

    return written(texts.mapInArrow(run, "lang string, word string, n long, cell int, places binary, counts binary"), f"counted-{k}")


def leveled(found: DataFrame, how: Phrases) -> np.ndarray:
    """The level of each bucket by its occurrences: 2 ** how.bits in all, whatever the input.

    A cell's rows follow each other in a task, which adds them up in an array of 65,536 numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sums = None, np.zeros(65536, np.int64)
        done: list[tuple[int, bytes]] = []

        def close() -> None:
            if cell is not None:
                levels = np.searchsorted(how.least << np.arange(LEVELS), sums, "right").astype(np.uint8)
                done.append((cell, (levels[::2] | levels[1::2] << 4).tobytes()))
            sums[:] = 0

        for batch in batches:
            for c, places, counts in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if c != cell:
                    close()
                    cell = c
                n = np.frombuffer(counts, np.uint16).astype(np.int64)
                n[n == 65535] = 1 << 40  # as many or more
                sums[np.frombuffer(places, np.uint16)] += n
        close()
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int32()), pa.array([b for _, b in done], pa.binary())], names=["cell", "levels"])

    rows = found.where("cell is not null").select("cell", "places", "counts").repartition("cell").sortWithinPartitions("cell")
    out = np.zeros(max(1 << (how.bits - 1), 32768), np.uint8)
    for row in rows.mapInArrow(run, "cell int, levels binary").toLocalIterator():
        out[row["cell"] * 32768 : row["cell"] * 32768 + 32768] = np.frombuffer(bytes(row["levels"]), np.uint8)
    return out


# ---- floors


def part_of_phrases(texts: DataFrame, maps, how: Phrases) -> DataFrame:
    """(lang, phrase, n, left, right) of one in how.every phrases: its occurrences, and what its parts without the last and without the first word may have at most, null for single words."""
    shape = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("left", pa.float64()), ("right", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value

        def phrases() -> Iterator[pa.Table]:
            for batch in batches:
                for t in tokens(batch):
                    before = None
                    for k, at, bucket in grams(t, known, how.longest, how.bits):
                        at = at[(bucket[at] % how.every == 0) & (level(known[k], bucket[at]) > 0)]
                        if len(at):
                            names, at, n = spelled(t, at, k)
                            ends = [pa.array(most(known[k - 1], before[at + j], how)) for j in (0, 1)] if k > 2 else [pa.nulls(len(at), pa.float64())] * 2
                            yield pa.table([*names, *ends, pa.array(n, pa.int64())], schema=shape)
                        before = bucket

        for table in gathered(phrases(), ["lang", "phrase", "left", "right"], True):
            yield from table.to_batches(max_chunksize=ROWS)

    found = texts.mapInArrow(run, "lang string, phrase string, left double, right double, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")).where(F.col("n") >= how.least)


def guessed_floors(part: DataFrame, words: DataFrame, how: Phrases) -> dict[str, int]:
    """By language a score that twice how.top phrases or so reach, if there are as many; a shorter phrase, which a longer one may explain, counts a quarter."""
    split = F.split("phrase", " ", -1)
    ends = part.select("lang", "n", "left", "right", F.size(split).alias("k"), F.element_at(split, 1).alias("one"), F.element_at(split, -1).alias("two"))
    l, r = (words.select("lang", F.col("phrase").alias(end), F.col("n").alias(name)) for end, name in (("one", "l"), ("two", "r")))
    with_ends = ends.join(l, ["lang", "one"]).join(r, ["lang", "two"])
    score = F.lit(1e6) * F.col("n") * F.col("n") / F.when(F.col("k") == 2, F.col("l").cast("double") * F.col("r")).otherwise(F.greatest(F.col("l") * F.col("right"), F.col("left") * F.col("r")))
    weight = F.when(F.col("k") == how.longest, 1.0).otherwise(0.25)
    steps = with_ends.select("lang", F.floor(4 * F.log2(score + 1)).alias("step"), weight.alias("weight")).groupBy("lang", "step").agg(F.sum("weight").alias("weight"))
    above = F.sum("weight").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    enough = steps.withColumn("above", above).where(F.col("above") * how.every >= 2 * how.top).groupBy("lang").agg(F.max("step").alias("step"))
    return {row["lang"]: floor for row in enough.collect() if (floor := int(2 ** (row["step"] / 4) - 1)) > 0}


def frequent_words(words: DataFrame, floors: dict[str, int], how: Phrases) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words of the languages with floors, how.known at most, as language, line end and word, and their occurrences."""
    if not floors:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    own = words.where(F.col("lang").isin(list(floors)))
    least, total = 64, 0
    for row in own.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > how.known:
            break
        least = row["step"]
    table = own.where(F.col("n") >= 2.0**least).select(F.concat_ws("\n", "lang", "phrase").alias("word"), "n").toArrow()
    return table["word"].combine_chunks().cast(pa.string()), table["n"].to_numpy()


def wanted(t: Tokens, maps: dict[int, np.ndarray], floors: dict[str, int], words: tuple[pa.Array, np.ndarray], how: Phrases) -> dict[int, np.ndarray]:
    """By words of a phrase the positions of those that have to be counted, if scores below floors don't matter.

    A phrase with a occurrences, whose parts have l and r, has 1000000 a a / (l r), and neither l nor r is less than a.
    It counts as well if it may explain a phrase inside it that reaches the floor, or is a part of one that counts.
    """
    floor = np.array([floors.get(x, 0) for x in t.langs.to_pylist()])[t.lang] / 1e6 * (1 - 1e-9)
    n = np.zeros(len(t.code))
    if floor.any() and len(words[1]):
        pair, back = np.unique(t.lang * len(t.words) + t.code, return_inverse=True)
        names = pc.binary_join_element_wise(t.langs.take(pa.array(pair // len(t.words))), t.words.take(pa.array(pair % len(t.words))), "\n")
        place = pc.fill_null(pc.index_in(names, value_set=words[0]), -1).to_numpy(zero_copy_only=False)
        n = np.where(place >= 0, words[1][place], 0).astype(float)[back]
    found: dict[int, np.ndarray] = {}
    inside = None  # the least occurrences by which a phrase explains one inside it
    for k, at, bucket in grams(t, maps, how.longest, how.bits):
        may = np.zeros(len(bucket))
        may[at] = most(maps[k], bucket[at], how)
        first, last = n[: len(bucket)], n[k - 1 :]
        need = np.maximum(how.least, floor[: len(bucket)] * np.maximum(first, last))
        if k == 2:
            need = np.maximum(need, np.sqrt(floor[: len(bucket)] * first * last))
        reached = (may > 0) & (may >= need)
        held = np.full(len(bucket), np.inf) if inside is None else np.minimum(inside[:-1], inside[1:])
        found[k] = reached | (may > 0) & (may >= held)
        inside = np.minimum(held, np.where(reached, need * how.percent / 100, np.inf))
    for k in sorted(found, reverse=True)[:-1]:
        found[k - 1][:-1] |= found[k]
        found[k - 1][1:] |= found[k]
    return {k: np.flatnonzero(x) for k, x in found.items()}


def candidates(texts: DataFrame, maps, floors, how: Phrases) -> DataFrame:
    """(lang, phrase): the distinct Apriori-safe phrases of the texts that have to be counted; floors: a broadcast of those and of frequent_words()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value
        of_lang, words = floors.value

        def phrases() -> Iterator[pa.Table]:
            for batch in batches:
                for t in tokens(batch):
                    for k, at in wanted(t, known, of_lang, words, how).items():
                        if len(at):
                            yield pa.table(spelled(t, at, k)[0], names=["lang", "phrase"])

        for table in gathered(phrases(), ["lang", "phrase"], False):
            yield from table.to_batches(max_chunksize=ROWS)

    return written(texts.mapInArrow(run, "lang string, phrase string").distinct(), "candidates")


# ---- double arrays


def packed(parent: np.ndarray, symbol: np.ndarray, n: int, radix: int, taken: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's base, and each edge's slot.

    Edges are sorted by parent; slots below taken are not free.  Sets of several symbols go to the first
    place of a region that has room for all of them, the larger ones first: the places where they fit are
    found together, by shifting the region's bitmap of free slots by each symbol.  Single ones fill what is left.
    """
    nodes, first, fan = np.unique(parent, return_index=True, return_counts=True)
    base = np.zeros(n, np.int64)
    region = 8 * radix
    full = (1 << region) - 1
    free = [full] * ((taken + region - 1) // region + 1)
    for k in range(taken):
        free[k // region] &= ~(1 << (k % region))
    order = np.argsort(-fan, kind="stable")
    order = order[fan[order] > 1]
    syms, at, last = symbol.tolist(), 0, 0
    for node, low, size in zip(nodes[order].tolist(), first[order].tolist(), fan[order].tolist(), strict=True):
        own = syms[low : low + size]
        if size != last:  # smaller sets may fit where larger ones did not
            at, last = max(0, at - 64), size
        while True:
            if at == len(free):
                free.append(full)
            room = full
            for s in own:
                room &= free[at] >> s
                if not room:
                    break
            if room:
                b = (room & -room).bit_length() - 1
                for s in own:
                    free[at] &= ~(1 << (b + s))
                base[node] = at * region + b
                break
            at += 1
    many = fan > 1
    slot = np.zeros(len(parent), np.int64)
    lone = first[~many]
    of_many = np.repeat(many, fan)
    slot[of_many] = base[parent[of_many]] + symbol[of_many]
    holes = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(x.to_bytes(region // 8, "little") for x in free), np.uint8), bitorder="little"))
    more = len(lone) - len(holes)
    holes = np.concatenate([holes, np.arange(max(0, more)) + len(free) * region]) if more > 0 else holes
    slot[lone] = holes[: len(lone)]
    base[parent[lone]] = slot[lone] - symbol[lone]
    return base, slot


def trie(lang: list[str], phrase: list[str]) -> tuple[dict, np.ndarray]:
    """base, check, radix, words and langs (in the order of their numbers) of a double array, and the state that accepts each phrase."""
    by_lang = pa.array(lang, pa.string()).dictionary_encode()
    split = pc.split_pattern(pa.array(phrase, pa.string()), " ")
    coded, size = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    radix = max(8, int(np.ceil(np.sqrt(len(coded.dictionary)))))
    radix += -radix % 8
    start, code = np.concatenate([[0], np.cumsum(size)[:-1]]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    node = by_lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, parents, symbols = len(by_lang.dictionary), [], []
    for step in range(2 * int(size.max())):
        live = np.flatnonzero(size > step // 2)
        word = code[start[live] + step // 2]
        key, back = np.unique(node[live] * radix + (word % radix if step % 2 else word // radix), return_inverse=True)
        parents.append(key // radix)
        symbols.append(key % radix)
        node[live] = n + back
        n += len(key)
    roots = len(by_lang.dictionary)
    parent, symbol = np.concatenate(parents), np.concatenate(symbols)  # sorted by parent, as levels follow each other
    base, slot = packed(parent, symbol, n, radix, roots)
    state = np.concatenate([np.arange(roots), slot])
    top = int(state.max()) + 1
    bases, check = np.full(top, -1 << 30, np.int32), np.full(top, -1, np.int32)
    inner = np.unique(parent)
    bases[state[inner]] = base[inner]
    check[slot] = state[parent]
    return {"base": bases, "check": check, "radix": radix, "words": coded.dictionary.to_pylist(), "langs": by_lang.dictionary.to_pylist()}, state[node]


def frozen(made: dict) -> bytes:
    out = io.BytesIO()
    names = np.frombuffer(json.dumps([made["radix"], made["langs"], made["words"]]).encode(), np.uint8)
    np.savez(out, base=made["base"], check=made["check"], names=names)
    return out.getvalue()


def thawed(raw: bytes) -> dict:
    read = np.load(io.BytesIO(raw))
    radix, langs, words = json.loads(read["names"].tobytes())
    return {"base": read["base"], "check": read["check"], "radix": radix, "words": pa.array(words, pa.string()), "langs": pa.array(langs, pa.string())}


def advanced(made: dict, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the states have a child by their symbol, and the children."""
    to = made["base"][state] + symbol
    ok = (to >= 0) & (to < len(made["check"]))
    ok[ok] = made["check"][to[ok]] == state[ok]
    ok = np.flatnonzero(ok)
    return ok, to[ok]


def accepted(made: dict, t: Tokens, at: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """The states that the positions at reach with each word after the first."""
    of_word, of_lang = (pc.fill_null(pc.index_in(have, value_set=made[what]), -1).to_numpy(zero_copy_only=False).astype(np.int64) for have, what in ((t.words, "words"), (t.langs, "langs")))
    code, state = of_word[t.code], of_lang[t.lang[at]]
    on = (code[at] >= 0) & (state >= 0)
    at, state = at[on], state[on]
    for k in range(longest):
        if k:
            on = t.joined[at + k - 1]
            at, state = at[on], state[on]
            on = code[at + k] >= 0
            at, state = at[on], state[on]
        for half in (np.floor_divide, np.remainder):
            ok, state = advanced(made, state, half(code[at + k], made["radix"]))
            at = at[ok]
        if k:
            yield state


def counts(texts: DataFrame, tries: dict, shards: int, how: Phrases) -> DataFrame:
    """(shard, state, n) of the accepting states of the broadcast tries, of shards in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: b.value for k, b in tries.items()}
        sums = {k: np.zeros(len(m["check"]), np.int64) for k, m in made.items()}
        held: dict[int, list[np.ndarray]] = {k: [] for k in made}

        def add(k: int) -> None:
            sums[k] += np.bincount(np.concatenate([np.empty(0, np.int64), *held[k]]), minlength=len(sums[k]))
            held[k].clear()

        for batch in batches:
            for t in tokens(batch):
                at = np.flatnonzero(t.joined[:-1])
                shard = t.pairs()[at] % shards
                order = np.argsort(shard, kind="stable")
                at, shard = at[order], shard[order]
                for k, m in made.items():
                    own = at[np.searchsorted(shard, k) : np.searchsorted(shard, k, "right")]
                    held[k] += accepted(m, t, own, how.longest)
                    if sum(map(len, held[k])) > 1 << 20:
                        add(k)
        for k in made:
            add(k)
        for k, n in sums.items():
            at = np.flatnonzero(n)
            for low in range(0, len(at), ROWS):
                few = at[low : low + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), k), pa.int32()), pa.array(few, pa.int32()), pa.array(n[few], pa.int64())], names=["shard", "state", "n"])

    return texts.mapInArrow(run, "shard int, state int, n long").groupBy("shard", "state").agg(F.sum("n").alias("n"))


def frequent_phrases(texts: DataFrame, found: DataFrame, how: Phrases) -> DataFrame:
    """(lang, phrase, n) of the candidates with how.least occurrences or more, counted exactly by their tries."""
    spark = texts.sparkSession
    shards = max(1, -(-found.count() * 10 // (9 * how.shard)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        lang, phrase = rows["lang"].tolist(), rows["phrase"].tolist()
        made, state = trie(lang, phrase)
        shard = int(rows["shard"].iloc[0])
        head = pd.DataFrame({"shard": [shard], "state": [-1], "lang": [None], "phrase": [None], "trie": [frozen(made)]})
        return pd.concat([head, pd.DataFrame({"shard": shard, "state": state, "lang": lang, "phrase": phrase, "trie": None})])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, words = batch.column(0), pc.split_pattern(batch.column(1), " ")
            number = paired(hashed(lang), *(hashed(pc.list_element(words, k)) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([lang, batch.column(1), pa.array((number % shards).astype(np.int32))], names=["lang", "phrase", "shard"])

    dealt = found.mapInArrow(deal, "lang string, phrase string, shard int")
    # one group a shard, of how.shard phrases or so
    made = written(dealt.groupBy("shard").applyInPandas(build, "shard int, state int, lang string, phrase string, trie binary"), "tries")
    out = []
    for low in range(0, shards, how.at_once):
        tries = {}
        for k in range(low, min(shards, low + how.at_once)):
            for row in made.where((F.col("state") == -1) & (F.col("shard") == k)).select("trie").collect():
                tries[k] = spark.sparkContext.broadcast(thawed(bytes(row["trie"])))
        out.append(written(counts(texts, tries, shards, how).where(F.col("n") >= how.least), "counts"))
        for b in tries.values():
            b.unpersist()
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    named = made.where("state >= 0").select("shard", "state", "lang", "phrase")
    frequent = written(total.join(named, ["shard", "state"]).select("lang", "phrase", "n"), "phrases")
    dropped(made, *out)
    return frequent


def collocations(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first how.top phrases of each language.

    docs: text and lang; other columns are ignored.  Letters A to Z are lower-cased; texts are split at
    [.,;:!?\\x0A-\\x0D] into pieces and those at spaces and tabs into words.  A phrase's occurrences a overlap
    and stay within pieces; l and r are those of its two parts at the cut of the lowest score
    floor(1000000 a a / (l r)), of equal ones the first; n counts the language's words.  Phrases that a
    longer frequent one largely explains go.  Null texts are empty, a null lang is `und`; rows that repeat
    count again, texts of any length count whole, and no rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known: dict[int, np.ndarray] = {}
    for k in range(2, how.longest + 1):
        of_less = spark.sparkContext.broadcast(known)
        found = counted(texts, of_less, k, how)
        known[k] = leveled(found, how)
        of_less.unpersist()
        if k == 2:
            words = written(found.where("word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("n")), "words")
        dropped(found)
    maps = spark.sparkContext.broadcast(known)
    part = written(part_of_phrases(texts, maps, how), "part")
    floors = guessed_floors(part, words, how)
    dropped(part)
    while True:
        both = spark.sparkContext.broadcast((floors, frequent_words(words, floors, how)))
        found = candidates(texts, maps, both, how)
        both.unpersist()
        frequent = frequent_phrases(texts, found, how)
        dropped(found)
        out = ranked(words, frequent, floors, how)
        if not floors:
            break
        enough = {row["lang"] for row in out.where(F.col("rank") == how.top).select("lang").collect()}
        if enough >= floors.keys():
            break
        floors = {lang: floor for lang, floor in floors.items() if lang in enough}
    maps.unpersist()
    return out


def ranked(words: DataFrame, frequent: DataFrame, floors: dict[str, int], how: Phrases) -> DataFrame:
    """The scores and ranks of frequent phrases, of words and phrases (lang, phrase, n) with their occurrences; those below the floor of their language go."""
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = words.where(F.col("n") >= how.least).unionByName(frequent)
    split, size = F.split("phrase", " ", -1), F.size(F.split("phrase", " ", -1))
    longer = frequent.where(size > 2).select("lang", F.col("n").alias("longer"), split.alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    within = longer.select("lang", "longer", F.explode(runs).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = frequent.withColumnRenamed("n", "a").join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < how.percent * F.col("a"), F.lit(True)))
    cuts = left.select("lang", "phrase", "a", split.alias("w"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("one"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("two"))
    l, r = (parts.select("lang", F.col("phrase").alias(end), F.col("n").alias(name)) for end, name in (("one", "l"), ("two", "r")))
    scored = cuts.join(l, ["lang", "one"]).join(r, ["lang", "two"])
    score = F.expr("cast(1000000 as decimal(7, 0)) * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = scored.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    if floors:
        spark = best.sparkSession
        of_lang = spark.createDataFrame(list(floors.items()), "lang string, floor long")
        best = best.join(F.broadcast(of_lang), "lang", "left").where(F.col("score") >= F.coalesce("floor", F.lit(0))).drop("floor")
    # each task passes on how.top phrases of a language at most
    best = written(best, "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranks = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= how.top)
    out = ranks.join(F.broadcast(total), "lang") if total.count() <= 100_000 else ranks.join(total, "lang")
    return out.select("lang", "rank", "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])


def sql(how: Phrases = Phrases()) -> str:
    """DuckDB SQL with the same rows."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " union all ".join(
        f"select lang, array_to_string(w[i : i + {k - 1}], ' ') as phrase, {k} as k from (select lang, w, unnest(range(1, len(w) - {k} + 2)) as i from pieces where len(w) >= {k})" for k in range(1, how.longest + 1)
    )
    return f"""
with pieces as (
  select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
f as materialized (select lang, phrase, k, cast(count(*) as hugeint) as n from ({grams}) group by all),
total as (select lang, cast(sum(n) as bigint) as n from f where k = 1 group by lang),
c as materialized (select *, string_split(phrase, ' ') as w from f where k >= 2 and n >= {how.least}),
inner_phrases as (
  select lang, phrase, max(n) as longer from (
    select lang, n, array_to_string(w[i : i + s - 1], ' ') as phrase from (select lang, n, w, s, unnest(range(1, k - s + 2)) as i from (select lang, n, w, k, unnest(range(2, k)) as s from c where k > 2))) group by all),
kept as (select c.* from c left join inner_phrases x using (lang, phrase) where x.longer is null or 100 * x.longer < {how.percent} * c.n),
cuts as (select lang, phrase, n as a, cut, array_to_string(w[1 : cut], ' ') as one, array_to_string(w[cut + 1 :], ' ') as two from (select *, unnest(range(1, k)) as cut from kept)),
scored as (select x.lang, x.phrase, x.a, x.cut, l.n as l, r.n as r, (1000000 * x.a * x.a) // (l.n * r.n) as score from cuts x join f l on l.lang = x.lang and l.phrase = x.one join f r on r.lang = x.lang and r.phrase = x.two),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select b.lang, cast(row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as integer) as rank, b.phrase, cast(b.a as bigint) as a, cast(b.l as bigint) as l, cast(b.r as bigint) as r, t.n, cast(b.score as bigint) as score
from best b join total t on t.lang = b.lang qualify rank <= {how.top}"""
