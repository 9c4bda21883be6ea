"""Toxicity by weak supervision.

Voters are found in labelled documents: lexicon voters hold words, pattern voters hold word beginnings,
which labelled documents tie to toxicity.  A generative model of the votes is fitted by expectation
maximisation: each voter's accuracy on either class, and the correlations of voters within a class, by which
voters that repeat each other lose weight.  Accuracies come from how voters agree: given labels choose the
terms, tell which class is which and place the cut between them.  The posterior labels train a linear
classifier on the words and beginnings themselves, and that scores the whole of every text.

Words and beginnings are counted by Spark over all labelled documents; only the matrices of a bounded number
of them come to the driver to be fitted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS


@dataclass(frozen=True)
class Supervision:
    """most_rows: labelled documents that the models are fitted on; terms: words and beginnings that are features; voters: of each kind; odds: the least ratio of a term's rates among toxic and other documents; sure: how many standard deviations the rates must differ by; support: toxic documents that it needs; agreed: voters that find something in a text that is toxic at first sight."""

    most_rows: int = 20_000
    terms: int = 4000
    voters: int = 12
    odds: float = 6.0
    sure: float = 5.0
    support: int = 3
    beginnings: tuple[int, ...] = (4, 5)
    rounds: int = 30
    agreed: int = 6
    seed: int = 17


_SIGNS = re.compile(r"[^\w]+")


def tokens_of(text: str | None) -> list[str]:
    """The words of a text in lower case, without signs."""
    return [w for w in _SIGNS.split((text or "").lower()) if w]


def terms_of(text: str | None, beginnings: tuple[int, ...]) -> set[str]:
    """The words of a text, and the beginnings of longer ones, marked by a hyphen."""
    found = set(tokens_of(text))
    return found | {w[:n] + "-" for n in beginnings for w in found if len(w) > n}


class Features:
    """The known terms of a text, and numbers that sum them up: their strength, how many there are and how dense they stand."""

    WIDTH = 7

    def __init__(self, terms: list[tuple[str, float]]) -> None:
        self.number = {t: i for i, (t, _) in enumerate(terms)}
        self.odds = np.array([o for _, o in terms])
        self.words = {t for t, _ in terms if not t.endswith("-")}
        self.begun = {t[:-1]: i for i, (t, _) in enumerate(terms) if t.endswith("-")}
        self.lengths = sorted({len(t) for t in self.begun})

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        tokens = tokens_of(text)
        distinct = set(tokens)
        words = distinct & self.words
        begun = [(w, b) for n in self.lengths for w in distinct if len(w) > n and (b := w[:n]) in self.begun]
        heads = {self.begun[b] for _, b in begun}
        telling = words | {w for w, _ in begun}
        total = sum(t in telling for t in tokens)
        own, other = sorted(self.odds[self.number[w]] for w in words), sorted(self.odds[h] for h in heads)
        summed = [max(own, default=0.0), sum(own[-10:]), max(other, default=0.0), sum(other[-10:]), math.log1p(total), math.log((total + 0.5) / (len(tokens) + 20)), float(len(words))]
        return sorted({self.number[w] for w in words} | heads), [float(x) for x in summed]


def fitted_votes(votes: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The posterior of class 1 of each row of votes (0 or 1), the rates of votes by class, the weights of voters and their correlations.

    prior: a first guess of the posterior, by which the classes are told apart.
    """
    post = prior.astype(float)
    n, k = votes.shape
    weights, correlation = np.ones(k), np.eye(k)
    for _ in range(rounds):
        share = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        rates = np.stack([((1 - post) @ votes + 0.5) / ((1 - post).sum() + 1.0), (post @ votes + 0.5) / (post.sum() + 1.0)])
        # correlations that the classes don't explain
        mean = np.outer(1 - post, rates[0]) + np.outer(post, rates[1])
        rest = votes - mean
        spread = np.sqrt((rest * rest).mean(0) + 1e-6)
        correlation = (rest.T @ rest) / n / np.outer(spread, spread)
        weights = 1 / (1 + (np.clip(correlation, 0, 1) ** 2).sum(1) - np.clip(np.diag(correlation), 0, 1) ** 2)
        # what voters don't find tells little, what they find much
        found, missed = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        log_odds = np.log(share / (1 - share)) + votes @ (weights * found) + (1 - votes) @ (weights * missed)
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, rates, weights, correlation


def linear(rows: list[np.ndarray], width: int, dense: np.ndarray, target: np.ndarray, rounds: int = 600, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse and dense features and the bias of a logistic regression of target (0 to 1), by Adam on the whole matrix."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.concatenate([np.empty(0, np.int64), *rows])
    k = dense.shape[1]
    w, m, v = (np.zeros(width + k + 1) for _ in range(3))
    shrink = np.concatenate([np.full(width, decay), np.full(k, decay / 10), [0.0]])
    for step in range(1, rounds + 1):
        z = np.bincount(at, w[columns], len(rows)) + dense @ w[width:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.concatenate([np.bincount(columns, error[at], width), dense.T @ error, [error.sum()]]) + shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:width], w[width:-1], float(w[-1])


def cut(z: np.ndarray, label: np.ndarray) -> float:
    """Of the cuts of scores z that part given labels best the one nearest to 0."""
    order = np.argsort(z, kind="stable")
    z, label = z[order], label[order]
    ends = np.concatenate([[True], z[1:] > z[:-1], [True]])  # between equal scores there is no cut
    right = np.concatenate([[0], np.cumsum(1 - label)]) + label.sum() - np.concatenate([[0], np.cumsum(label)])
    low, high = np.concatenate([[-np.inf], z]), np.concatenate([z, [np.inf]])
    best = ends & (right >= right[ends].max())
    # a cut may lie anywhere between its neighbours
    at = np.clip(0.0, low + np.minimum(0.05, (high - low) / 2), high - np.minimum(0.05, (high - low) / 2))
    return float(min(at[best], key=abs))


@dataclass(frozen=True)
class Model:
    """terms with their odds, and the classifier's weights of them and of their sums."""

    terms: tuple[tuple[str, float], ...]
    weights: tuple[float, ...]
    dense: tuple[float, ...]
    bias: float

    def scorer(self):
        """A function from a text to its score."""
        features, weights, dense = Features(list(self.terms)), np.array(self.weights), np.array(self.dense)

        def score(text: str | None) -> float:
            hits, sums = features(text)
            z = self.bias + float(weights[hits].sum() if hits else 0.0) + float(np.dot(dense, sums))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def learned(docs: DataFrame, labels: DataFrame, how: Supervision = Supervision()) -> Model:
    """A model from the documents (doc_id, text) that have a label (doc_id, toxic); null labels are none, and rows that repeat a label count once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))

    # all labelled documents, of which the same bounded share is fitted each time
    known = known.select(F.col("doc_id").cast("long"), "toxic")
    sizes = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(how.seed)), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * how.most_rows / max(1, sizes)))
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known) if sizes <= BROADCAST_ROWS else known, "doc_id")
    joined = labelled.where(part)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: Counter = Counter()
        every: Counter = Counter()

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([bad[t] for t in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["term", "bad", "all"])
            bad.clear()
            every.clear()
            return out

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py(), how.beginnings)
                every.update(found)
                if toxic:
                    bad.update(found)
                if len(every) > 200_000:
                    yield table()
        yield table()

    totals = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model((), (), (0.0,) * Features.WIDTH, -3.0 if not bad else 3.0)
    counts = labelled.select("toxic", "text").mapInArrow(counted, "term string, bad long, all long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    clean = F.col("all") - F.col("bad")
    rate = ((F.col("bad") + 0.5) / (bad + 1)) / ((clean + 2.0) / (good + 2))
    both = F.col("all") / (bad + good)
    apart = (F.col("bad") / bad - clean / good) / F.sqrt(both * (1 - both) * (1 / bad + 1 / good) + 1e-12)
    telling = counts.where(F.col("bad") >= how.support).withColumns({"odds": rate, "apart": apart}).where((F.col("odds") >= how.odds) & (F.col("apart") >= how.sure))
    terms = [(r["term"], math.log(r["odds"])) for r in telling.orderBy(F.desc(F.col("bad") * F.log("odds")), "term").limit(how.terms).collect()]
    if not terms:
        return Model((), (), (0.0,) * Features.WIDTH, math.log(bad / good))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(terms)
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["doc_id", "toxic", "hits", "sums"])

    fitted = joined.select("doc_id", "toxic", "text").mapInArrow(measured, "doc_id long, toxic int, hits array<int>, sums array<double>").collect()  # most_rows at most
    fitted.sort(key=lambda r: (r["doc_id"], r["sums"]))
    rows = [np.array(r["hits"], np.int64) for r in fitted]
    sums, label = np.array([r["sums"] for r in fitted]), np.array([r["toxic"] for r in fitted], float)
    # each voter holds terms of like strength
    voter = np.zeros(len(terms), np.int64)
    odds = np.array([o for _, o in terms])
    for first, ends in ((0, False), (how.voters, True)):
        own = np.array([i for i, (t, _) in enumerate(terms) if t.endswith("-") == ends], np.int64)
        own = own[np.argsort(-odds[own], kind="stable")]
        voter[own] = first + np.arange(len(own)) * how.voters // max(1, len(own))
    votes = np.zeros((len(rows), 2 * how.voters))
    for i, r in enumerate(rows):
        votes[i, voter[r]] = 1
    # more patterns: several terms, dense terms
    more = [sums[:, 6] >= 2, sums[:, 6] >= 4, *(sums[:, 5] >= math.log(x) for x in (0.005, 0.01, 0.02, 0.04))]
    votes = np.column_stack([votes, *more]).astype(float)
    # the first guess: how many voters find something; the given labels only tell which class is which
    post = fitted_votes(votes, 0.05 + 0.9 * np.clip(votes.sum(1) / how.agreed, 0, 1), how.rounds)[0]
    if (post * label).sum() * (1 - label).sum() < (post * (1 - label)).sum() * label.sum():
        post = 1 - post
    mean, spread = sums.mean(0), sums.std(0) + 1e-9
    weights, dense, bias = linear(rows, len(terms), (sums - mean) / spread, post)
    z = np.array([weights[r].sum() for r in rows]) + (sums - mean) / spread @ dense + bias
    return Model(tuple(terms), tuple(weights.tolist()), tuple((dense / spread).tolist()), bias - cut(z, label) - float((dense * mean / spread).sum()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from the whole text alone; null texts are empty.

    docs: doc_id and text; other columns are ignored.  Repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
