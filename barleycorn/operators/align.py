"""Alignment and classification of reads."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Classify, Scoring, Template
from ..functions import alignment as al
from ..functions.sequence import passes_chastity, piece, reverse_complement

ALIGNED = "dna string, score int, score2 int, ref_begin int, ref_end int, read_begin int, read_end int, ref_end2 int, cigar string, nm int, bc_start int, bc_stop int, repaired string"


def aligned(reads: DataFrame, reference: str, scoring: Scoring = Scoring(), turned: bool = False) -> DataFrame:
    """reads with the best local alignment of their dna to reference, extended CIGAR, NM, the place of the reference's N run, and the read with its N repaired; nulls where dna is null.

    Tasks are independent, and nothing is dealt anew: each distinct sequence of a batch is aligned once.  turned:
    dna or its reverse complement, whichever scores strictly higher, takes dna's place; reverse tells which.
    """
    names, at_dna, found_fields = reads.columns, reads.columns.index("dna"), [f.split() for f in ALIGNED.split(", ")[1:]]
    shape = StructType([*reads.schema.fields, *StructType.fromDDL(ALIGNED).fields[1:], *(StructType.fromDDL("reverse boolean").fields if turned else [])])
    given = shape.names
    if turned:
        reads = reads.withColumn("__turned", reverse_complement(F.col("dna")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, n = list(batch.columns), batch.num_rows
            dna = columns[at_dna]
            coded = (pa.concat_arrays([dna, columns.pop()]) if turned else dna).dictionary_encode()
            found = al.described(coded.dictionary.to_pylist(), reference, scoring)
            arrays = [pa.array(found[c], pa.int32() if kind == "int" else pa.string()) for c, kind in found_fields]
            at = coded.indices.slice(0, n)
            if turned:
                other = coded.indices.slice(n)
                better = pc.fill_null(pc.greater(arrays[0].take(other), arrays[0].take(at)), False)
                at = pc.if_else(better, other, at)
                columns[at_dna] = coded.dictionary.take(at)
            yield pa.RecordBatch.from_arrays([*columns, *[a.take(at) for a in arrays], *([better] if turned else [])], names=given)

    out = reads.mapInArrow(run, shape)
    return out.select("dna", *[c for c in given if c != "dna"]) if names[0] != "dna" else out


def align_reads(reads: DataFrame, reference: str, scoring: Scoring = Scoring(), least: int = 0) -> DataFrame:
    """reads with their alignments of at least so high a score."""
    return aligned(reads.where("dna is not null"), reference, scoring).where(F.col("score") >= least)


def align_both_strands(reads: DataFrame, reference: str, scoring: Scoring = Scoring()) -> DataFrame:
    """Alignments of reads or of their reverse complements, whichever scores strictly higher; reverse tells which.  A row for each read, like ones too."""
    found = aligned(reads.where("dna is not null"), reference, scoring, turned=True)
    keys = [c for c in reads.columns if c != "dna"]
    return found.select(*keys, *[c for c in found.columns if c not in keys])


def align_all_pairs(queries: DataFrame, targets: list[tuple[str, str]], scoring: Scoring = Scoring(), least: int = 0) -> DataFrame:
    """name, target and alignment of every query with each of the given (name, sequence) targets; queries are read once for each target."""
    out = None
    for name, sequence in targets:
        one = align_reads(queries, sequence, scoring, least).withColumn("target", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


#: Columns of an alignment by a substitution matrix.
SCORED = "dna string, score int, score2 int, ref_begin int, ref_end int, read_begin int, read_end int, ref_end2 int, cigar string"


def align_by_matrix(sequences: DataFrame, reference: str, letters: al.Letters, scoring: Scoring = Scoring(), least: int = 1) -> DataFrame:
    """The best local alignment of each distinct dna with a reference, of proteins or of bases with ambiguity codes: scores of pairs by letters, gaps by scoring.  Alignments that score less than least go, null and empty sequences too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found, paths = al.alignments(texts, reference, scoring, letters=letters)
            kept = np.flatnonzero(found["score"] >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), *[pa.array(found[c][kept]) for c in al.PLACES], pa.array(al.plain_cigars([paths[k] for k in kept]), pa.string())], names=["dna", *al.PLACES, "cigar"])

    return sequences.select("dna").where("dna <> ''").distinct().mapInArrow(run, SCORED)


def mapping_quality(score: Column, second: Column) -> Column:
    apart = F.abs(score - second) / F.greatest(score, F.lit(1))
    return F.when(score == second, 0).otherwise(F.least(F.lit(254), F.floor(F.floor(-4.343 * F.ln(F.greatest(1 - apart, F.lit(1e-30)))) + 4.99))).cast("int")


def classified(reads: DataFrame, template: Template, how: Classify = Classify(), scoring: Scoring = Scoring()) -> DataFrame:
    """reads with their alignment, outcome, training and cluster sequence.

    Outcomes, the first that holds: Filtered (the sequencer's flag), Unaligned (too low a score), Wrong Barcode
    Length, Residual N, Insufficient Flank, Clustered.  Training sequences, the flanks without the barcode,
    are given whenever both flanks are whole and free of N.
    """
    best = template.best_score(scoring)
    found = aligned(reads, template.reference, scoring)
    start = F.col("read_begin") if how.leading else F.col("bc_start")
    stop = F.col("read_begin") if how.leading else F.col("bc_stop")
    length = stop if how.leading else stop - start
    found = found.withColumns({"start": F.lit(0) if how.leading else start, "stop": stop, "length": length})
    left, right = F.col("start") - how.cluster_flank, F.col("stop") + how.cluster_flank
    cluster = piece(F.col("repaired"), F.lit(0), right) if how.leading else piece(F.col("repaired"), left, right)
    before = F.lit("") if how.leading else piece(F.col("dna"), F.col("start") - how.training_flank, F.col("start"))
    after = piece(F.col("dna"), F.col("stop"), F.col("stop") + how.training_flank)
    whole = (F.lit(True) if how.leading else F.col("start") >= how.training_flank) & (F.length("dna") >= F.col("stop") + how.training_flank)
    outcome = (
        F.when(~passes_chastity(F.col("header")), "Filtered")
        .when(F.coalesce("score", F.lit(0)) < math.ceil(how.min_score * best), "Unaligned")
        .when(F.abs(F.col("length") - template.barcode_length) > how.deviation, "Wrong Barcode Length")
        .when(F.contains(cluster, F.lit("N")), "Residual N")
        .when(((F.lit(False) if how.leading else left < 0)) | (F.length("repaired") < right), "Insufficient Flank")
        .otherwise("Clustered")
    )
    training = F.concat(before, after)
    out = found.withColumn("outcome", outcome)
    trains = ~F.col("outcome").isin("Filtered", "Unaligned") & whole & ~F.contains(training, F.lit("N"))
    return out.withColumns({"training": F.when(trains, training), "cluster": F.when(F.col("outcome") == "Clustered", cluster)})


def outcomes(classed: DataFrame) -> DataFrame:
    """outcome, n, share."""
    counts = classed.groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each outcome


def best_hits(queries: DataFrame, targets: DataFrame, scoring: Scoring = Scoring(mismatch=-2), most_e: float = 1e-10, lam: float = 1.28, k: float = 0.46, letters: al.Letters | None = None) -> DataFrame:
    """dna, target, score, e of each distinct query's best target, the last by name of the best, by Karlin and Altschul's expectation over all targets' bases.

    targets: name, sequence; a small table, of which each task has a copy.  Each distinct query meets all
    targets in one pass.
    """
    known = sorted((r["name"], r["sequence"]) for r in targets.select("name", "sequence").collect())
    bases = sum(len(s) for _, s in known)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, same in frame.groupby(frame["dna"].str.len()):
                for at in range(0, len(same), 4096):
                    dna = same["dna"].iloc[at : at + 4096]
                    coded = np.stack([al.encode(d, letters) for d in dna])
                    found, score = np.zeros(len(dna), np.int64), np.full(len(dna), -1, np.int32)
                    for t, (_, sequence) in enumerate(known):
                        own = al.best_scores(coded, sequence, scoring, letters=letters)
                        better = own >= score
                        found[better], score[better] = t, own[better]
                    yield pd.DataFrame({"dna": dna.to_numpy(), "target": [known[t][0] for t in found], "score": score})

    best = queries.select("dna").where("dna <> ''").distinct().mapInPandas(run, "dna string, target string, score int") if known else queries.sparkSession.createDataFrame([], "dna string, target string, score int")
    e = F.lit(k * bases) * F.length("dna") * F.exp(F.lit(-lam) * F.col("score"))
    return best.withColumn("e", e).where(F.col("e") <= most_e)
