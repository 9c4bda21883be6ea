"""Near-duplicate documents: banded MinHash candidates, odd sketches, exact confirmation.

Each document's MinHash samples are folded into a parity bitmap (an odd sketch): the population count of
two bitmaps' XOR tells how many samples differ, most precisely where few do.  Documents that share a band
of samples are candidates; pairs whose sketches are too far apart are passed over, and the rest are
confirmed on their full shingle sets.  A second bitmap has the parity of all shingles: it differs in at most
as many bits as sets differ in shingles, and tells near misses from matches where sets are small.

Groups of any size stay linear: documents with equal sets are one node; in each bucket of a band the
members are first compared with one hub, a member in the middle of a group.  Those that aren't connected
with the hub then meet all members of another component, each pair in its first common band only.  Where
very many are left, as where a common passage has brought documents together, they meet by their rarest
shingles instead, of which similar sets share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light, written
from .components import components

CACHE_WORDS = 400_000
#: Comparisons of sketches within a bucket; documents of buckets that need more meet by rare shingles.
COMPARED = 1 << 20
#: Cells of a table of shingle frequencies.
CELLS = 1 << 17

_M = np.uint64(0xBF58476D1CE4E5B9)
_N = np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class MinHash:
    """words a shingle, the least similarity in per cent, bands of rows samples, bits of a sketch and of a set's parity, and how many standard deviations below the similarity an estimate may lie.

    32 bands of 5 miss a pair at 0.8 with probability 3e-6.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 512
    set_bits: int = 1024
    slack: float = 4.0
    seed: int = 7

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """The largest population count of two sketches' XOR that still allows the similarity."""
        s = self.percent / 100
        differ = 2 * self.samples * min(1.0, 1 - s + self.slack * math.sqrt(s * (1 - s) / self.samples))
        mean = self.bits / 2 * (1 - (1 - 2 / self.bits) ** differ)
        return math.ceil(mean + self.slack * math.sqrt(self.bits) / 4)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _N
    return x ^ (x >> np.uint64(31))


def shingler(n: int):
    """A function from a text to the sorted distinct 64-bit hashes of its shingles of n words, A-Z lower-cased; a text of fewer words is one shingle."""
    known: dict[bytes, int] = {}
    powers = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def hashed(w: bytes) -> int:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(known) < CACHE_WORDS and len(w) < 64:
                known[w] = h
        return h

    def shingles(text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(hashed, found), np.uint64, len(found))
        if len(h) < n:
            return mixed(np.array([(h * powers[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(h) - n + 1 + k] * powers[k]
        return np.unique(mixed(total))

    return shingles


def sketched(docs: DataFrame, how: MinHash) -> DataFrame:
    """(id, n, digest, bands, sketch) of each document; digest identifies the set, and is null for an empty one; sketch has the odd sketch and then the set's parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, rng = shingler(how.words), np.random.default_rng(how.seed)
        a = rng.integers(0, 2**63, how.samples, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, how.samples, np.uint64)
        of_row = mixed(np.arange(100, 100 + how.rows, dtype=np.uint64)) | np.uint64(1)
        of_band = mixed(np.arange(1000, 1000 + how.bands, dtype=np.uint64))
        of_sample = mixed(np.arange(5000, 5000 + how.samples, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                n, digests, bands, sketches = [], [], [], []
                for text in few.column(1):
                    s = shingles(text.as_py())
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if not len(s):
                        bands.append(np.empty(0, np.uint64))
                        sketches.append(np.empty(0, np.int64))
                        continue
                    least = np.full(how.samples, 2**64 - 1, np.uint64)
                    for k in range(0, len(s), 512):
                        np.minimum(least, (a[:, None] * s[None, k : k + 512] + b[:, None]).min(1), out=least)
                    bands.append(mixed((least.reshape(how.bands, how.rows) * of_row).sum(1, dtype=np.uint64) + of_band))
                    places = (mixed(least ^ of_sample) % np.uint64(how.bits)).astype(np.int64)
                    own = (s >> np.uint64(20)) % np.uint64(how.set_bits)
                    odd = [np.bincount(x, minlength=size) & 1 for x, size in ((places, how.bits), (own.astype(np.int64), how.set_bits))]
                    sketches.append(np.packbits(np.concatenate(odd).astype(np.uint8)).view(np.int64))
                listed = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x).view(np.int64))) for x in (bands, sketches)]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *listed], names=["id", "n", "digest", "bands", "sketch"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, digest binary, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, how: MinHash) -> DataFrame:
    """(id, shingles) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(how.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                sets = [shingles(t.as_py()) for t in few.column(1)]
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([few.column(0), listed], names=["id", "shingles"])

    wanted = docs.join(light(ids), "id", "left_semi")
    return wanted.select("id", "text").mapInArrow(run, "id long, shingles array<long>").dropDuplicates(["id"])


def near_enough(how: MinHash, x: str = "s_a", y: str = "s_b"):
    """Whether sizes, odd sketches and parities of two sets, n_a and n_b, allow the similarity."""
    far = lambda first, last: " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(first // 64, last // 64))
    most, half = f"({100 - how.percent} * (n_a + n_b) div {100 + how.percent})", how.set_bits / 2
    # so many shingles differ at most, and so many bits of a parity with them
    chance = f"{half} * (1 - pow({1 - 1 / half}D, {most})) + {(how.slack + 1) * math.sqrt(how.set_bits) / 2}"
    sizes = f"100 * least(n_a, n_b) >= {how.percent} * greatest(n_a, n_b)"
    return F.expr(f"{sizes} and {far(0, how.bits)} <= {how.most_bits} and {far(how.bits, how.bits + how.set_bits)} <= least({most}, {chance})")


def likely(pairs: DataFrame, nodes: DataFrame, how: MinHash) -> DataFrame:
    """(a, b, n_a, n_b) of the pairs (a, b) whose sketches allow the similarity."""
    one, two = (nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").where(near_enough(how)).select("a", "b", "n_a", "n_b")


def confirmed(near: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """The pairs (a, b) of near that are similar enough by their full sets."""
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return near.join(one, "a").join(two, "b").withColumn("both", both).where(100 * F.col("both") >= how.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def rare_prefixes(sets: DataFrame, how: MinHash) -> DataFrame:
    """(id, n, place, shingle): the first shingles of each set in the order of rarity, so many that similar sets have one in common.

    Rarity is counted over all the given sets, in CELLS cells of hashes; any order gives all pairs.
    """
    counted = sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(CELLS)).cast("int").alias("cell")).count().toArrow()  # CELLS rows at most
    counts = np.zeros(CELLS, np.int64)
    counts[counted["cell"].to_numpy()] = counted["count"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = []
            for s in batch.column(1):
                h = s.values.to_numpy()
                firsts.append(h[np.lexsort((h, counts[h % CELLS]))][: len(h) - (how.percent * len(h) + 99) // 100 + 1])
            n = pa.array([len(s.values) for s in batch.column(1)], pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, listed], names=["id", "n", "prefix"])

    return sets.mapInArrow(run, "id long, n long, prefix array<long>").select("id", "n", F.posexplode("prefix").alias("place", "shingle"))


def unlike(one: DataFrame, two: DataFrame, on: str, how: MinHash, *also) -> DataFrame:
    """(a, b, n_a, n_b) of rows (on, id, c, n, sketch) with one key, of different components, whose sizes and sketches allow the similarity and for which also holds."""
    of = lambda df, x: df.select(on, *[F.col(c).alias(f"{k}_{x}") for c, k in (("id", "id"), ("c", "c"), ("n", "n"), ("sketch", "s"), ("place", "p"), ("bands", "g")) if c in df.columns])
    met = of(one, "a").join(of(two, "b"), on).where((F.col("c_a") != F.col("c_b")) & near_enough(how) & reduce(and_, also, F.lit(True)))
    first = F.col("id_a") < F.col("id_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(pick("id_a", "id_b").alias("a"), pick("id_b", "id_a").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b")).distinct()


def in_buckets(placed: DataFrame, few: DataFrame, how: MinHash) -> DataFrame:
    """Pairs of the buckets of few: members outside the hub's component meet those of other components, in their first common band."""
    rows = placed.join(few, "key")
    minor = rows.where(F.col("c") != F.col("main"))
    return unlike(minor, rows, "key", how, F.element_at(F.array_intersect("g_a", "g_b"), 1) == F.col("key"))


def by_rare_shingles(sets: DataFrame, placed: DataFrame, how: MinHash) -> DataFrame:
    """Pairs of sets that share one of their rarest shingles and leave room for enough others after it."""
    rows = rare_prefixes(sets, how).join(placed, "id")
    parted = rows.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("shingle")
    rows = written(rows.join(parted, "shingle", "left_semi"), "rare")
    need = F.expr(f"({how.percent} * (n_a + n_b) + {99 + how.percent}) div {100 + how.percent}")
    return unlike(rows, rows, "shingle", how, F.col("id_a") < F.col("id_b"), F.expr("least(p_a, p_b) + least(n_a - p_a, n_b - p_b)") >= need)


def near_duplicates(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    docs: doc_id and text; other columns are ignored.  Null, empty and blank texts have no shingles and are
    linked with nothing; a text of any length counts whole.  doc_id names a document: rows that repeat one
    are linked.  A row without doc_id is kept, without component.  component_id is the smallest doc_id
    reachable by links, and the document that has it is kept.  No rows give no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    known = plain.where("id is not null")
    signed = written(sketched(plain, how), "sketches")
    classes = signed.where("id is not null and digest is not null").groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = signed.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["id", "digest"])
    buckets = nodes.select("id", F.explode("bands").alias("key"))
    several = buckets.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key", "size")
    shared = written(buckets.join(several, "key"), "buckets")
    nodes = written(nodes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "n", "sketch", "bands"), "nodes")
    # the hub of a bucket is the member that meets most others in all its buckets: one in the middle of a group
    central = shared.groupBy("id").agg(F.sum("size").alias("met"))
    hubs = shared.join(central, "id").groupBy("key").agg(F.max(F.struct(F.col("met"), (-F.col("id")).alias("back"))).alias("h")).select("key", (-F.col("h.back")).alias("hub"))
    hubs = written(hubs, "hubs")
    stars = shared.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    near = written(likely(stars, nodes.drop("bands"), how), "near")
    sets = written(shingle_sets(known, ends(near), how), "sets")
    of = written(components(confirmed(near, sets, how)), "components")
    # members that aren't connected with their bucket's hub yet
    placed = shared.select("key", "id").join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    main = hubs.join(of.withColumnRenamed("id", "hub"), "hub", "left").select("key", F.coalesce("component", "hub").alias("main"))
    left = placed.join(main, "key").groupBy("key", "main").agg(F.count("*").alias("size"), F.count_if(F.col("c") != F.col("main")).alias("minor")).where("minor > 0")
    left = written(left, "left")
    placed = written(placed.join(left.select("key"), "key", "left_semi").join(nodes, "id"), "parted")
    many = F.col("minor") * F.col("size") > COMPARED
    pairs = in_buckets(placed, left.where(~many).select("key", "main"), how)
    crowded = left.where(many).select("key")
    if not crowded.isEmpty():
        crowd = written(placed.drop("bands").join(crowded, "key", "left_semi").drop("key", "n").dropDuplicates(["id"]), "crowd")
        pairs = pairs.unionByName(by_rare_shingles(written(shingle_sets(known, crowd.select("id"), how), "sets"), crowd, how)).distinct()
    more = written(pairs.join(near.select("a", "b"), ["a", "b"], "left_anti"), "near")
    found = of
    if not more.isEmpty():
        sets = sets.unionByName(written(shingle_sets(known, ends(more).join(sets.select("id"), "id", "left_anti"), how), "sets"))
        links = written(confirmed(more, sets, how), "links")
        if not links.isEmpty():
            found = components(of.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))
    # back to all documents: a class of equal sets has its smallest document's component
    of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").where("copies > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def kept_rows(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps."""
    gone = written(near_duplicates(docs, how).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(light(gone), docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
