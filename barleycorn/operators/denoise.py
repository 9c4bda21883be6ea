"""Denoising: error rates from training reads, and clusters of barcodes by an abundance test.

Our own implementation of the published idea: a sequence belongs to a more abundant one close to it unless it
is too abundant to be its errors, under one error rate or under rates by quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import bases, hamming, piece, text_bytes
from ..functions.special import log_abundance_p, poisson_interval
from ..storage import written


def transitions(reads: DataFrame, reference: str | Column, by_sample: bool = True, cells: int = 4_000_000) -> DataFrame:
    """(sample, mutation, phred, n): how often each base of the reference was read as another at each quality; N isn't counted.

    reference: a string as long as the reads, or a column with each read's own.  Without by_sample, (mutation,
    phred, n) of all samples together.  Tasks count in an array of samples by mutations and qualities, of at most
    so many cells before they hand it on; reads are dealt by ranges of samples, crowded ones over several tasks.
    """
    own, text = isinstance(reference, Column), reference if isinstance(reference, str) else ""
    rows = reads.select(*(["sample"] if by_sample else []), "dna", "qc", *([reference.alias("reference")] if own else [])).where("dna is not null and qc is not null")
    if by_sample:
        rows = rows.repartitionByRange("sample", F.xxhash64("dna", "qc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, int] = {}
        columns, counts = np.full(TALLIED, -1, np.int64), np.zeros((0, 0), np.int64)

        def handed_on() -> Iterator[pa.RecordBatch]:
            names, kinds = pa.array(list(known), pa.string()), np.empty(counts.shape[1], np.int32)
            kinds[columns[columns >= 0]] = np.flatnonzero(columns >= 0)
            row, column = counts[: len(known)].nonzero()
            for at in range(0, len(row), 1 << 16):
                r, c = row[at : at + (1 << 16)], column[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*([names.take(pa.array(r))] if by_sample else []), pa.array(kinds[c]), pa.array(counts[r, c])], names=[*(["sample"] if by_sample else []), "x", "n"])

        for batch in batches:
            if by_sample:
                coded = batch.column(0).dictionary_encode()
                code = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
                found = [*coded.dictionary.to_pylist(), None]
                here = np.array([known.setdefault(found[k], len(known)) for k in np.unique(code)], np.int64)
                place = here[np.unique(code, return_inverse=True)[1]]
            else:
                known[None] = 0
                place = np.zeros(batch.num_rows, np.int64)
            dna, qc = text_bytes(batch.column("dna")), text_bytes(batch.column("qc"))
            for at, x in _paired(dna, qc, text_bytes(batch.column("reference")) if own else text):
                here = np.bincount(x.ravel(), minlength=TALLIED + 1)[:TALLIED]
                fresh = np.flatnonzero((here > 0) & (columns < 0))
                columns[fresh] = np.arange(counts.shape[1], counts.shape[1] + len(fresh))
                if len(known) > counts.shape[0] or len(fresh):
                    grown = np.zeros((max(counts.shape[0], len(known) + (4096 if by_sample else 0)), counts.shape[1] + len(fresh)), np.int64)
                    grown[: counts.shape[0], : counts.shape[1]] = counts
                    counts = grown
                if by_sample:
                    key = (place[at] * counts.shape[1])[:, None] + columns[np.minimum(x, TALLIED - 1)]
                    np.add.at(counts.reshape(-1), key[x < TALLIED], 1)
                else:
                    counts[0, columns[here > 0]] += here[here > 0]
            if len(known) * counts.shape[1] > cells:
                yield from handed_on()
                known, counts = {}, np.zeros((0, 0), np.int64)
                columns[:] = -1
        yield from handed_on()

    parts = rows.mapInArrow(run, ("sample string, " if by_sample else "") + "x int, n long")
    keys = ["sample"] if by_sample else []
    counted = parts.groupBy(*keys, "x").agg(F.sum("n").alias("n"))
    letter = lambda i: F.substring(F.lit("ACGT"), i + 1, F.lit(1))
    phred = F.when(F.col("x") % 256 != MISSING, F.col("x") % 256 - 33)
    return counted.select(*keys, F.concat(letter(F.shiftright("x", 10)), F.lit("2"), letter(F.shiftright("x", 8) % 4)).alias("mutation"), phred.alias("phred"), "n")


#: Kinds of a base: what the reference has and what was read, by quality character; one of these stands for none.
TALLIED, MISSING = 16 * 256, 255
_TALLY = np.full(256, 4, np.uint8)
_TALLY[[ord(c) for c in "ACGT"]] = range(4)


def _paired(dna: tuple[np.ndarray, np.ndarray], qc: tuple[np.ndarray, np.ndarray], reference: tuple[np.ndarray, np.ndarray] | str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, kinds) for rows of like lengths: of each read and place its kind, TALLIED where there is none.  A base without a quality counts only where each read has its own reference."""
    own = not isinstance(reference, str)
    if not own:
        whole = np.frombuffer(reference.encode("ascii", "replace"), np.uint8)
    lengths = np.stack([np.diff(dna[1]), np.diff(qc[1]), np.diff(reference[1]) if own else np.full(len(dna[1]) - 1, len(whole))], 1)

    def cut(of: tuple[np.ndarray, np.ndarray], at: np.ndarray, places: int) -> np.ndarray:
        begin = of[1][:-1][at]
        if len(at) and begin[-1] - begin[0] == (len(at) - 1) * places and (np.diff(begin) == places).all():  # all of one length: no copy
            return of[0][begin[0] : begin[0] + len(at) * places].reshape(len(at), places)
        return of[0][begin[:, None] + np.arange(places)]

    same = len(lengths) > 0 and (lengths == lengths[0]).all()
    for size in lengths[:1] if same else np.unique(lengths, axis=0):
        at = np.arange(len(lengths)) if same else np.flatnonzero((lengths == size).all(1))
        places = int(min(size[0], size[2]) if own else size.min())
        a, b = _TALLY[cut(reference, at, places)] if own else _TALLY[whole[:places]][None, :], _TALLY[cut(dna, at, places)]
        x = (a * np.uint8(4) + b).astype(np.int32) << 8
        rated = min(places, int(size[1]))
        x[:, :rated] += cut(qc, at, rated)
        x[:, rated:] += MISSING
        x[(a > 3) | (b > 3)] = TALLIED
        yield at, x


def error_rates(tallies: DataFrame) -> DataFrame:
    """sample, phred, n, error: the share of bases read wrong, by quality."""
    right = F.sum(F.when(F.substring("mutation", 1, 1) == F.substring("mutation", 3, 1), F.col("n")).otherwise(0))
    return tallies.groupBy("sample", "phred").agg(F.sum("n").alias("n"), (1 - right / F.sum("n")).alias("error"))


def error_excess(rates: DataFrame) -> DataFrame:
    """sample, excess: how far errors are above what the qualities say, weighted by bases."""
    expected = F.pow(F.lit(10.0), -F.col("phred") / 10.0)
    return rates.groupBy("sample").agg((F.sum((F.col("error") - expected) * F.col("n")) / F.sum("n")).alias("excess"))


def mutation_excess(tallies: DataFrame) -> DataFrame:
    """mutation, excess: over a third of the error that the quality says, among the bases of its kind, weighted by bases."""
    first, last = F.substring("mutation", 1, 1), F.substring("mutation", 3, 1)
    counts = tallies.groupBy("mutation", "phred").agg(F.sum("n").alias("n"))
    each = counts.withColumn("total", F.sum("n").over(Window.partitionBy(first, "phred"))).where(first != last)
    expected = F.pow(F.lit(10.0), -F.col("phred") / 10.0)
    return each.groupBy("mutation").agg((F.sum((F.col("n") / F.col("total") - expected / 3) * F.col("total")) / F.sum("total")).alias("excess"))


def cohort_errors(tallies: DataFrame, edges: tuple[int, ...] = (10, 20, 25, 30, 35)) -> DataFrame:
    """cohort, n, error: errors by ranges of quality; cohort k holds qualities from edge k on."""
    cohort = sum(((F.col("phred") >= e).cast("int") for e in edges), F.lit(0))
    right = F.sum(F.when(F.substring("mutation", 1, 1) == F.substring("mutation", 3, 1), F.col("n")).otherwise(0))
    return tallies.groupBy(cohort.alias("cohort")).agg(F.sum("n").alias("n"), (1 - right / F.sum("n")).alias("error"))


def largest_shares(clusters: DataFrame) -> DataFrame:
    """sample, share: of the most abundant cluster."""
    return clusters.groupBy("sample").agg((F.max("abundance") / F.sum("abundance")).alias("share"))


def abundance_p(abundance: pd.Series, expected: pd.Series) -> pd.Series:
    """P(X >= abundance | X >= 1) of a Poisson variable."""
    return pd.Series(np.exp(log_abundance_p(abundance.to_numpy(np.float64), expected.to_numpy(np.float64))))


def close_pairs(derep: DataFrame, most: int, length: int | None = None, fold: float = 2.0) -> DataFrame:
    """(sample, sequence, abundance, parent, larger, ham): pairs of sequences of one length and sample with few substitutions, parent fold times as abundant at least; with a fold of 1 the smaller sequence of two equally abundant ones is the parent.

    Sequences are cut into most + 1 parts, one of which a close pair has in common: an equi-join on parts.
    length: only sequences of that length.
    """
    n = F.length("sequence")
    cut = lambda k: F.floor(n * k / (most + 1)).cast("int")
    parts = F.array(*[F.struct(F.lit(k).alias("k"), piece(F.col("sequence"), cut(k), cut(k + 1)).alias("part")) for k in range(most + 1)])
    keyed = of_length(derep, length).select("sample", "sequence", "abundance", n.alias("length"), F.explode(parts).alias("p")).select("sample", "sequence", "abundance", "length", "p.*")
    other = keyed.select("sample", F.col("sequence").alias("parent"), F.col("abundance").alias("larger"), "length", "k", "part")
    tied = (F.col("larger") == F.col("abundance")) & (F.col("parent") < F.col("sequence"))
    more = F.col("larger") >= fold * F.col("abundance") if fold > 1 else (F.col("larger") > F.col("abundance")) | tied
    other = other.where(F.col("larger") >= fold)
    joined = keyed.join(other, ["sample", "length", "k", "part"]).where(more).withColumn("ham", hamming(F.col("sequence"), F.col("parent"))).where(F.col("ham") <= most)
    return joined.select("sample", "sequence", "abundance", "parent", "larger", "ham").distinct()


def of_length(derep: DataFrame, length: int | None) -> DataFrame:
    return derep if length is None else derep.where(F.length("sequence") == length)


def rate_of_errors(sequence: Column, parent: Column, mean_q: Column, rates: dict[int, float], error: float) -> Column:
    """The chance that parent is read as sequence, from the rates at the sequence's mean qualities; error where a quality has no rate."""
    known = F.create_map(*[F.lit(x) for q, r in rates.items() for x in (int(q), min(max(float(r), 1e-9), 0.75))]) if rates else None
    at = lambda q: F.lit(error) if known is None else F.coalesce(F.try_element_at(known, F.round(q).cast("int")), F.lit(error))
    places = F.zip_with(F.zip_with(bases(sequence), bases(parent), lambda a, b: a == b), mean_q, lambda same, q: F.when(same, 1 - at(q)).otherwise(at(q) / 3))
    return F.aggregate(places, F.lit(1.0), lambda p, x: p * x)


def followed(up: DataFrame, what: str = "roots") -> DataFrame:
    """(sample, sequence, root) with chains of roots followed to their ends, doubling the step until no root has a root of its own.

    Each round is written, so that lineage ends there.
    """
    ends = written(up.select("sample", "sequence", "root"), what)
    while True:
        nxt = ends.select("sample", F.col("sequence").alias("root"), F.col("root").alias("next"))
        both = written(ends.join(nxt, ["sample", "root"]).select("sample", "sequence", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), what)
        moved, ends = not both.where("moved").isEmpty(), both.drop("moved")
        if not moved:
            return ends


def clustered(derep: DataFrame, length: int | None = None, error: float = 0.003, omega: float = 1e-10, most: int = 2, rates: dict[int, float] | None = None, fold: float = 2.0) -> DataFrame:
    """sample, sequence, abundance, n0, n1, nunq, pval, birth_pval, birth_ham of each cluster.

    derep: sample, sequence, abundance, and mean_q (an array) if rates are given: error rates by quality, as
    error_rates() finds them; otherwise all bases have one rate, error.  Each sequence's parent is the one of
    its length, fold times as abundant, that explains most of it; one whose abundance it can't explain (P below omega) is a cluster of
    its own.  Chains of parents are followed to their ends.  length: only sequences of that length are looked at.
    """
    derep = of_length(derep, length)
    if rates is None:
        lam = F.pow(F.lit(error / 3), F.col("ham")) * F.pow(F.lit(1 - error), F.length("sequence") - F.col("ham"))
        pairs = close_pairs(derep, most, fold=fold).withColumn("expected", F.col("larger") * lam)
    else:
        pairs = close_pairs(derep, most, fold=fold).join(derep.select("sample", "sequence", "mean_q"), ["sample", "sequence"])
        pairs = pairs.withColumn("expected", F.col("larger") * rate_of_errors(F.col("sequence"), F.col("parent"), F.col("mean_q"), rates, error)).drop("mean_q")
    best = pairs.groupBy("sample", "sequence").agg(F.max_by(F.struct("parent", "expected", "ham"), F.struct("expected", "parent")).alias("b"), F.max("abundance").alias("abundance"))
    tested = best.select("sample", "sequence", "b.*", "abundance").withColumn("p", F.pandas_udf(abundance_p, "double")(F.col("abundance").cast("double"), "expected"))
    up = derep.select("sample", "sequence", "abundance").join(tested.drop("abundance"), ["sample", "sequence"], "left")
    up = written(up.withColumn("root", F.when(F.col("p") >= omega, F.col("parent")).otherwise(F.col("sequence"))), "parents")
    placed = up.drop("root").join(followed(up), ["sample", "sequence"])
    own = placed.where("sequence = root").select("sample", "sequence", F.coalesce("p", F.lit(0.0)).alias("birth_pval"), F.coalesce("ham", F.lit(0)).alias("birth_ham"))
    n0 = F.sum(F.when(F.col("sequence") == F.col("root"), F.col("abundance")).otherwise(0))
    n1 = F.sum(F.when((F.col("sequence") != F.col("root")) & (F.col("ham") == 1), F.col("abundance")).otherwise(0))
    sums = placed.groupBy("sample", "root").agg(F.sum("abundance").alias("abundance"), n0.alias("n0"), n1.alias("n1"), F.count("*").alias("nunq"), F.min(F.when(F.col("sequence") != F.col("root"), F.col("p"))).alias("pval"))
    out = sums.withColumnRenamed("root", "sequence").join(own, ["sample", "sequence"]).select("sample", "sequence", "abundance", "n0", "n1", "nunq", F.coalesce("pval", F.lit(1.0)).alias("pval"), "birth_pval", "birth_ham")
    out = written(out, "clusters")
    before, after = (t.agg(F.sum("abundance")).first()[0] or 0 for t in (up, out))
    if before != after:
        raise AssertionError(f"clusters hold {after} reads of {before}")
    return out


def _interval(n: pd.Series) -> pd.DataFrame:
    known = {k: poisson_interval(int(k)) for k in set(n)}
    return pd.DataFrame([known[k] for k in n], columns=["low", "high"])


def with_intervals(counts: DataFrame, n: str = "n") -> DataFrame:
    """counts with the exact 95 % interval of each count's mean: low, high."""
    return counts.withColumn("i", F.pandas_udf(_interval, "low double, high double")(F.col(n))).select("*", "i.*").drop("i")


def error_intervals(tallies: DataFrame) -> DataFrame:
    """phred, n, wrong, error, low, high: all samples' errors by quality, with the exact 95 % interval of the count of wrong bases, as shares."""
    wrong = F.sum(F.when(F.substring("mutation", 1, 1) != F.substring("mutation", 3, 1), F.col("n")).otherwise(0))
    counts = with_intervals(tallies.groupBy("phred").agg(F.sum("n").alias("n"), wrong.alias("wrong")), "wrong")
    return counts.select("phred", "n", "wrong", *[F.try_divide(v, "n").alias(c) for c, v in (("error", "wrong"), ("low", "low"), ("high", "high"))])
