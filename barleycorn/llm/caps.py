"""Near-duplicate embeddings by spherical-cap filters.

Filter directions form a random product code: the space is turned and cut into blocks, each block has a few
random code words, and a direction is a choice of one word per block.  A vector belongs to every direction
whose inner product with it exceeds a threshold; list decoding finds them without looking at the others.
Vectors of one label that share a direction are compared in double precision.

Equal vectors are one node with a count.  A direction's vectors are compared in blocks of bounded size, so
that crowds are spread over many tasks, and no task's output is larger than its input: a vector's links are
counted (a link in its first common direction only) and tied to the smallest vector they reach in the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components


@dataclass(frozen=True)
class Caps:
    """cosine: the least of a link; per_vector: directions a vector has on average; crowd: vectors that chance brings to one; block: rows of a block.

    With 16 directions a pair at 0.98 shares none with a probability under 0.001 where vectors are spread evenly.
    """

    cosine: float = 0.98
    per_vector: int = 16
    crowd: int = 24
    block: int = 1024
    seed: int = 3


@dataclass(frozen=True)
class Code:
    """blocks of words code words each: words ** blocks directions over a space of width dimensions."""

    width: int
    blocks: int
    words: int
    threshold: float
    seed: int

    def parts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The turn of the space, and each block's words, scaled so that directions have length 1."""
        rng = np.random.default_rng(self.seed)
        turn = np.linalg.qr(rng.normal(size=(self.width, self.width)))[0]
        code = []
        for own in np.array_split(np.arange(self.width), self.blocks):
            w = rng.normal(size=(self.words, len(own)))
            code.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt(len(own) / self.width))
        return turn, code


def code_for(n: int, width: int, how: Caps) -> Code:
    """As many directions as bring about how.crowd of n evenly spread vectors together."""
    directions = max(256, n * how.per_vector / how.crowd)
    blocks = min(width, max(2, math.ceil(math.log(directions) / math.log(512))))
    words = max(2, math.ceil(directions ** (1 / blocks)))
    share, low, high = how.per_vector / words**blocks, 0.0, 12.0
    for _ in range(60):  # the normal quantile of that share
        z = (low + high) / 2
        low, high = (z, high) if math.erfc(z / math.sqrt(2)) / 2 > share else (low, z)
    return Code(width, blocks, words, z / math.sqrt(width), how.seed)


def decoded(x: np.ndarray, code: Code, parts: tuple) -> list[np.ndarray]:
    """The numbers of all directions of each unit vector; the nearest one where none is near enough."""
    turn, words = parts
    turned = x @ turn
    cuts = np.cumsum([0] + [w.shape[1] for w in words])
    scores = [turned[:, a:b] @ w.T for a, b, w in zip(cuts, cuts[1:], words, strict=False)]
    best = [s.max(1) for s in scores]
    out = []
    for row in range(len(x)):
        own = [s[row] for s in scores]
        at, sums = np.zeros(1, np.int64), np.zeros(1)
        for k, s in enumerate(own):  # a choice is given up as soon as the best of the other blocks can't save it
            hope = sum(float(b[row]) for b in best[k + 1 :])
            total = sums[:, None] + s[None, :]
            i, j = np.nonzero(total >= code.threshold - hope)
            at, sums = at[i] * code.words + j, total[i, j]
        if not len(at):
            nearest = 0
            for s in own:
                nearest = nearest * code.words + int(s.argmax())
            at = np.array([nearest])
        out.append(at)
    return out


def compared(sorted_rows: DataFrame, how: Caps) -> DataFrame:
    """(id, links, root) of the vectors of each block pair; rows are sorted by label, width, direction and pair."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list = []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "width", "direction", "pair")])
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cut, cut[1:], strict=False):
                if held and (held[0][0] != keys[a]).any():
                    yield pa.Table.from_batches([h[1] for h in held])
                    held = []
                held.append((keys[a], batch.slice(a, b - a)))
        if held:
            yield pa.Table.from_batches([h[1] for h in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, links, roots = [], [], []
        for group in runs(batches):
            if group.num_rows < 2:
                continue
            ident = group["id"].to_numpy()
            count, side, direction = group["copies"].to_numpy(), group["side"].to_numpy(), int(group["direction"][0].as_py())
            x = np.frombuffer(b"".join(group["unit"].to_pylist()), np.float64).reshape(len(ident), -1)
            near = x @ x.T >= how.cosine
            np.fill_diagonal(near, False)
            if side.any():  # two blocks: only what lies between them
                near &= side[:, None] != side[None, :]
            if not near.any():
                continue
            i, j = np.nonzero(np.triu(near))
            lists = group["directions"].to_pylist()
            # a link counts in the first direction that both vectors have
            few = {k: frozenset(lists[k]) for k in set(i.tolist()) | set(j.tolist())}
            smaller = {k: {d for d in s if d < direction} for k, s in few.items()}
            first = np.fromiter((smaller[a].isdisjoint(smaller[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            total = np.bincount(i[first], count[j[first]], len(ident)) + np.bincount(j[first], count[i[first]], len(ident))
            root = ident.copy()
            while True:
                new = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
                if (new == root).all():
                    break
                root = new
            some = near.any(1)
            ids.append(ident[some])
            links.append(total[some].astype(np.int64))
            roots.append(root[some])
            if sum(map(len, ids)) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, links, roots)], names=["id", "links", "root"])
                ids, links, roots = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, links, roots)], names=["id", "links", "root"])

    return sorted_rows.mapInArrow(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, how: Caps = Caps()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    vectors: vec_id, embedding (an array of numbers) and label; other columns are ignored.  Rows without
    label and vectors that are null, empty, zero or hold null or non-finite components are linked with
    nothing.  Vectors of different widths are never linked; numbers of any size are scaled first.  Rows that
    repeat a vec_id count as vectors of their own and share a component.  No rows give no rows.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    classes = plain.where(fit).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    decodable = written(classes.select("id", "label", "copies", "v"), "vectors")
    # a code for each width that occurs
    codes = {r["width"]: code_for(r["count"], r["width"], how) for r in decodable.groupBy(F.size("v").alias("width")).count().collect()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {w: c.parts() for w, c in codes.items()}
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(3)], np.int64)
            for width in np.unique(widths).tolist():
                of_width = batch.take(pa.array(np.flatnonzero(widths == width)))
                for at in range(0, of_width.num_rows, 1024):
                    few = of_width.slice(at, 1024)
                    x = few.column(3).flatten().to_numpy().reshape(few.num_rows, width)
                    x = x / np.abs(x).max(1, keepdims=True)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    found = decoded(x, codes[width], parts[width])
                    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
                    same = pa.array(np.full(few.num_rows, width), pa.int64())
                    yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), few.column(2), same, pa.array([r.tobytes() for r in x], pa.binary()), listed], names=["id", "label", "copies", "width", "unit", "directions"])

    nodes = written(decodable.mapInArrow(decode, "id long, label long, copies long, width long, unit binary, directions array<long>"), "directions")
    rows = nodes.select("*", F.explode("directions").alias("direction"))
    crowds = rows.groupBy("label", "width", "direction").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / how.block).cast("int"))
    parted = rows.join(crowds.drop("count"), ["label", "width", "direction"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # each pair of parts meets once; side tells them apart, and is 0 for all where a part meets itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct((F.least("part", k) * F.col("parts") + F.greatest("part", k)).alias("pair"), (F.col("part") > k).cast("int").alias("side")))
    met = parted.withColumn("p", F.explode(pairs)).select("label", "width", "direction", "p.pair", "p.side", "id", "copies", "unit", "directions")
    placed = met.repartition("label", "width", "direction", "pair").sortWithinPartitions("label", "width", "direction", "pair")
    links = written(compared(placed, how), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # back to all rows, by the class of equal vectors
    of_class = decodable.select("label", "v", "id", "copies").join(counts, "id", "left").join(found, "id", "left")
    of_class = of_class.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = plain.withColumn("fit", fit).withColumn("key", F.when(F.col("fit"), F.col("v"))).join(of_class.withColumnRenamed("v", "key"), ["label", "key"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
