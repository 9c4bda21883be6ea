"""Approximate nearest neighbours by inner product, through low-dimensional stable projections.

Vectors are scaled and given one more component, so that all have length 1 and the largest inner product is the
least distance.  A projection on a few normally distributed directions turns a squared distance into that
distance times a chi-square variable.  So whatever is as near as the k-th neighbour found so far lies, with the
chance `sure`, within the k-th squared distance times a chi-square quantile in the projection: neighbours in the
projection are verified one leaf after another of a kd-tree, until the next one lies beyond.

The projected points are dealt to cells by a kd-tree that is fitted on a sample of bounded size; each cell has a
kd-tree of its own in a task.  A query looks in its nearest cell first; the bound found there tells the cells
that have to be looked at besides.  Equal vectors are one point with its smallest numbers, as many as can count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gamma_quantile
from .common import dropped, written


@dataclass(frozen=True)
class Stable:
    """k: neighbours of a query; every: queries are the rows whose vec_id it divides; dims: projections; sure: the chance that a neighbour lies within the stopping radius.

    cell: points of a cell; cells: cells at most; sample: points on which the cells are fitted; leaf: points of a leaf; queries: queries of a cell that are one task.
    """

    k: int = 20
    every: int = 20
    dims: int = 10
    sure: float = 0.98
    cell: int = 8192
    cells: int = 4096
    sample: int = 65_536
    leaf: int = 32
    queries: int = 2048
    seed: int = 13


@dataclass
class Space:
    """Vectors of one width: their cells begin at number first, exponent scales them, longest is the greatest length after that; dim and cut are the splits of a complete tree."""

    width: int
    first: int
    exponent: int
    longest: float
    turn: np.ndarray
    dim: np.ndarray | None = None
    cut: np.ndarray | None = None
    boxes: dict | None = None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.ldexp(x, -self.exponent)

    def projected(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Scaled vectors, as points or as queries."""
        length = np.sqrt((x * x).sum(1))
        unit = x / (length[:, None] if query else self.longest)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1 - (length / self.longest) ** 2))
        return np.concatenate([unit, rest[:, None]], 1) @ self.turn

    def cells(self, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(y), np.int64)
        for _ in range(int(math.log2(len(self.dim) + 1))):
            node = 2 * node + 1 + (y[np.arange(len(y)), self.dim[node]] > self.cut[node])
        return self.first + node - len(self.dim)


def outside(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    gap = np.maximum(0.0, np.maximum(low - y, y - high))
    return (gap * gap).sum(1)


def splits(y: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree of medians of the widest dimension."""
    dim, cut, parts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), [y]
    for node in range(len(dim)):
        own = parts[node]
        if len(own):
            dim[node] = int((own.max(0) - own.min(0)).argmax())
            cut[node] = float(np.median(own[:, dim[node]]))
        right = own[:, dim[node]] > cut[node]
        parts += [own[~right], own[right]]
        parts[node] = None
    return dim, cut


def leaves(y: np.ndarray, most: int) -> list[np.ndarray]:
    """The leaves of a kd-tree of points, by halves of the widest dimension."""
    todo, out = [np.arange(len(y))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        of = y[own]
        d = int((of.max(0) - of.min(0)).argmax())
        order, half = np.argpartition(of[:, d], len(own) // 2), len(own) // 2
        todo += [own[order[:half]], own[order[half:]]]
    return out


class Tree:
    """A cell's points: x, their projections y and the numbers that share each."""

    def __init__(self, points: pa.Table, how: Stable):
        y = np.frombuffer(b"".join(points["y"].to_pylist()), np.float64).reshape(points.num_rows, -1)
        parts = leaves(y, how.leaf)
        order = np.concatenate(parts)
        self.y, self.x = y[order], np.frombuffer(b"".join(points["x"].to_pylist()), np.float64).reshape(points.num_rows, -1)[order]
        self.of, ids = points["id"].to_numpy()[order], points["ids"].to_pylist()
        self.ids = [ids[k] for k in order]
        self.count = np.array([len(i) for i in self.ids])
        ends = np.cumsum([len(p) for p in parts])
        self.start, self.end = ends - [len(p) for p in parts], ends
        self.low, self.high = (np.stack([f(self.y[a:b], axis=0) for a, b in zip(self.start, self.end, strict=True)]) for f in (np.min, np.max))

    def search(self, q: np.ndarray, y: np.ndarray, bound: float, space: Space, how: Stable, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Points and scores that may be among the nearest, and the squared distance within which how.k + 1 numbers are known."""
        far = outside(y, self.low, self.high)
        order, at, step = np.argsort(far, kind="stable"), 0, 4
        length = float(np.sqrt((q * q).sum())) * space.longest
        found, scores = np.empty(0, np.int64), np.empty(0)
        while at < len(order) and far[order[at]] <= factor * bound:
            take = order[at : at + step]
            at, step = at + step, min(64, 2 * step)
            near = np.concatenate([np.arange(self.start[k], self.end[k]) for k in take.tolist() if far[k] <= factor * bound])
            gap = self.y[near] - y
            near = near[(gap * gap).sum(1) <= factor * bound]
            if not len(near):
                continue
            found, scores = np.concatenate([found, near]), np.concatenate([scores, (self.x[near] * q).sum(1)])
            best = np.argsort(-scores, kind="stable")
            enough = np.cumsum(self.count[found[best]]) > how.k
            if enough.any():  # of equal scores the numbers decide later
                least = scores[best[int(enough.argmax())]]
                bound = min(bound, max(0.0, 2 - 2 * least / length))
                best = best[scores[best] >= least]
            found, scores = found[best], scores[best]
        return found, scores, bound


SCHEMA = "cell long, part int, kind int, id long, y binary, x binary, ids array<long>, bound double"


def searched(rows: DataFrame, spaces: list[Space], how: Stable) -> DataFrame:
    """(id, bound, found): of each query in rows, which are dealt and sorted by cell, part and kind: a cell's points stand before its queries."""
    factor = 2 * gamma_quantile(how.sure, how.dims / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, tree = None, [], None
        of_width = {s.width: s for s in spaces}
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if tuple(keys[a, :2]) != key:
                    key, points, tree = tuple(keys[a, :2]), [], None
                if not keys[a, 2]:
                    points.append(own)
                    continue
                if tree is None and points:
                    tree, points = Tree(pa.Table.from_batches(points), how), []
                out = []
                for ident, y, x, bound in zip(own.column("id").to_pylist(), own.column("y").to_pylist(), own.column("x").to_pylist(), own.column("bound").to_pylist(), strict=True):
                    q = np.frombuffer(x, np.float64)
                    space = of_width[len(q)]
                    at, scores, bound = tree.search(q, np.frombuffer(y, np.float64), bound, space, how, factor) if tree else ((), (), bound)
                    with np.errstate(over="ignore"):
                        real = np.ldexp(np.asarray(scores, np.float64), 2 * space.exponent).tolist()
                    out.append({"id": ident, "bound": bound, "found": [{"of": int(tree.of[p]), "vec_id": i, "score": s} for p, s in zip(at, real, strict=True) for i in tree.ids[p]]})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", pa.int64()), ("bound", pa.float64()), ("found", pa.list_(pa.struct([("of", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])))]))

    return rows.mapInArrow(run, "id long, bound double, found array<struct<of: long, vec_id: long, score: double>>")


def dealt(points: DataFrame, queries: DataFrame, how: Stable) -> DataFrame:
    """Cells with their queries; a cell that many queries look at is copied for as many parts."""
    parts = queries.groupBy("cell").agg(F.ceil(F.count("*") / how.queries).cast("int").alias("parts"))
    copied = points.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asking = queries.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = copied.withColumns({"kind": F.lit(0), "bound": F.lit(0.0)}).select(*names).unionByName(asking.withColumns({"kind": F.lit(1), "ids": F.lit(None).cast("array<long>")}).select(*names))
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")


def spaces_of(classes: DataFrame, how: Stable) -> list[Space]:
    """A Space for each width that occurs, with its cells."""
    top = {r["w"]: (r["top"], r["n"]) for r in classes.groupBy(F.size("v").alias("w")).agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"), F.count("*").alias("n")).collect()}
    out = []
    for width, (largest, n) in sorted(top.items()):
        exponent = max(-1000, min(1000, math.frexp(largest)[1]))
        own = classes.where(F.size("v") == width)
        longest = math.sqrt(own.agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + (x * 2.0**-exponent) * (x * 2.0**-exponent)))).first()[0])
        space = Space(width, out[-1].first + len(out[-1].dim) + 1 if out else 0, exponent, longest or 1.0, np.random.default_rng(how.seed + width).normal(size=(width + 1, how.dims)))
        depth = max(0, min(math.ceil(math.log2(max(1.0, n / how.cell))), int(math.log2(how.cells))))
        some = own.select("v").sample(min(1.0, how.sample / n), seed=how.seed).limit(2 * how.sample).toArrow() if depth else None
        x = np.array(some["v"].to_pylist(), np.float64).reshape(-1, width) if depth else np.empty((0, width))
        space.dim, space.cut = splits(space.projected(space.scaled(x), False), depth)
        out.append(space)
    return out


def neighbours(vectors: DataFrame, how: Stable = Stable()) -> DataFrame:
    """query_id, rank, vec_id, score: the how.k nearest found of each query, by inner product.

    vectors: vec_id and embedding (an array of numbers); other columns are ignored.  Queries are the rows
    whose vec_id how.every divides, candidates all rows but the query's own; nearest first, of equal scores
    the smallest vec_id.  Rows without vec_id and vectors that are null, empty, zero or hold null or
    non-finite components take no part, and vectors of another width than the query's are no candidates.
    Rows that repeat a vec_id and vector count once; those that repeat only a vec_id are rows of their own.
    A query with fewer candidates has fewer ranks, and no rows give no rows.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    fit = plain.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()
    # more equal vectors than these can't be among how.k neighbours
    few = fit.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= how.k + 1)
    ids = few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = fit.where(F.col("id") % how.every == 0)
    classes = written(ids.join(asked.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left"), "vectors")
    spaces = spaces_of(classes, how)
    of_width = {s.width: s for s in spaces}

    def project(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths = np.array([len(v) for v in batch.column(1)], np.int64)
                for width in np.unique(widths).tolist():
                    own, space = batch.take(pa.array(np.flatnonzero(widths == width))), of_width[width]
                    x = space.scaled(own.column(1).flatten().to_numpy().reshape(-1, width))
                    y = space.projected(x, query)
                    cell = space.cells(y)
                    if query:  # the nearest box
                        names, low, high = space.boxes
                        cell = np.array([names[int(outside(row, low, high).argmin())] for row in y], np.int64)
                    binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cell), own.column(0), binary(y), binary(x), own.column(2), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), how.dims).cast(pa.list_(pa.float64()))], names=["cell", "id", "y", "x", "ids", "at"])

        return run

    shape = "cell long, id long, y binary, x binary, ids array<long>, at array<double>"
    projected = written(classes.select("id", "v", "ids").mapInArrow(project(False), shape), "points")
    ends = [f(F.col("at")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(how.dims)]
    boxes = projected.groupBy("cell").agg(*ends).collect()  # how.cells at most
    for space in spaces:
        own = [r for r in boxes if space.first <= r["cell"] <= space.first + len(space.dim)]
        space.boxes = (np.array([r["cell"] for r in own]), *[np.array([[r[f"{e}{k}"] for k in range(how.dims)] for r in own]) for e in ("low", "high")])
    points = projected.drop("at")
    queries = written(classes.where("asks").select("id", "v", "ids").mapInArrow(project(True), shape).select("cell", "id", "y", "x", F.lit(math.inf).alias("bound")), "queries")
    first = written(searched(dealt(points, queries, how), spaces, how), "first")
    factor = 2 * gamma_quantile(how.sure, how.dims / 2)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for row, (home, y, x, bound) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("cell", "y", "x", "bound")], strict=True)):
                names, low, high = of_width[len(x) // 8].boxes
                there = names[(outside(np.frombuffer(y, np.float64), low, high) <= factor * bound) & (names != home)]
                rows.append(np.full(len(there), row))
                cells.append(there)
            at = pa.array(np.concatenate([np.empty(0, np.int64), *rows]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *cells])), *[batch.column(c).take(at) for c in ("id", "y", "x", "bound")]], names=["cell", "id", "y", "x", "bound"])

    wider = queries.drop("bound").join(first.select("id", "bound"), "id").select("cell", "id", "y", "x", "bound")
    second = written(searched(dealt(points, written(wider.mapInArrow(others, "cell long, id long, y binary, x binary, bound double"), "routes"), how), spaces, how), "second")
    order = [F.desc("score"), F.asc("vec_id")]
    found = first.unionByName(second).select("id", F.explode("found").alias("f")).select("id", "f.*")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order, "of"))).where(F.col("r") <= how.k + 1).drop("r")
    # back to the rows that ask, each without itself
    own = ids_of_queries(asked, classes)
    out = own.join(best, "id").where((F.col("vec_id") != F.col("query_id")) | (F.col("of") != F.col("id")))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*order, "of"))).where(F.col("rank") <= how.k)
    dropped(projected, queries)
    return out.select("query_id", "rank", "vec_id", "score")


def ids_of_queries(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """(query_id, id): the class of each row that asks."""
    return asked.select("v", F.col("id").alias("query_id")).join(classes.where("asks").select("v", "id"), "v").select("query_id", "id")
