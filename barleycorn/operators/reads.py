"""Filters, slices and tallies of reads (sample, read_id, header, dna, qc)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import degenerate, expected_errors, passes_chastity, piece


def chaste(reads: DataFrame) -> DataFrame:
    return reads.where(passes_chastity(F.col("header")))


def without_degenerate(reads: DataFrame) -> DataFrame:
    return reads.where(~degenerate(F.col("dna")))


def usual_length(reads: DataFrame, first: int = 999) -> DataFrame:
    """Reads as long as the median of the reads with the first ids."""
    few = reads.select("read_id", F.length("dna").alias("n")).orderBy("read_id").limit(first)
    return reads.where(F.length("dna") == few.agg(F.floor(F.median("n")).cast("int")).scalar())


def co_sliced(reads: DataFrame, start: int, stop: int) -> DataFrame:
    """The same part of dna and qc."""
    return reads.withColumns({c: piece(F.col(c), start, stop) for c in ("dna", "qc")})


def sliced_by(reads: DataFrame, start: str, stop: str, start2: str | None = None, stop2: str | None = None) -> DataFrame:
    """Each row's own part of dna and qc, and a second part after it where columns for that are named."""
    own = lambda c: piece(F.col(c), F.col(start), F.col(stop))
    both = (lambda c: F.concat(own(c), piece(F.col(c), F.col(start2), F.col(stop2)))) if start2 else own
    return reads.withColumns({c: both(c) for c in ("dna", "qc")})


def few_errors(reads: DataFrame, most: float = 2.0) -> DataFrame:
    return reads.where(expected_errors(F.col("qc")) <= most)


def matching(reads: DataFrame, condition: str) -> DataFrame:
    """Reads for which an SQL condition on their columns holds; where it is null it doesn't."""
    return reads.where(F.expr(condition))


def trusted_quality(reads: DataFrame, bad: str = "#") -> DataFrame:
    return reads.where(~F.contains("qc", F.lit(bad)))


def dereplicated(reads: DataFrame) -> DataFrame:
    """sample, sequence, abundance."""
    return reads.groupBy("sample", F.col("dna").alias("sequence")).agg(F.count("*").alias("abundance"))


def mean_qualities(reads: DataFrame) -> DataFrame:
    """sample, sequence, abundance and the mean Phred score of each place.

    A mean is kept for each place up to the longest read's, not the reads, so an abundant sequence needs no
    more memory than a rare one; no read is taken apart into rows.
    """
    longest = reads.agg(F.max(F.length("qc"))).first()[0] or 0
    places = [F.avg(F.when(F.length("qc") > k, F.ascii(F.substring("qc", k + 1, 1)) - 33)).alias(f"q{k}") for k in range(longest)]
    means = reads.groupBy("sample", F.col("dna").alias("sequence")).agg(F.count("*").alias("abundance"), *places)
    listed = F.array_compact(F.array(*[F.col(f"q{k}") for k in range(longest)])) if longest else F.array().cast("array<double>")
    return means.select("sample", "sequence", "abundance", listed.alias("mean_q"))


def dense_counts(df: DataFrame, column: str, most: int) -> DataFrame:
    """(column, n) for each whole number from 0 to most, zeros included."""
    counts = df.groupBy(F.col(column).cast("int").alias(column)).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(most + 1).select(F.col("id").cast("int").alias(column))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def score_histogram(scores: DataFrame, column: str, most: int, least: int) -> DataFrame:
    """(column, n, passed) for each score from 0 to most; passed where it is at least the least an alignment may have."""
    return dense_counts(scores, column, most).withColumn("passed", F.col(column) >= least)


def wrong_lengths(classed: DataFrame, most: int = 299) -> DataFrame:
    """(length, n) for each length from 0 to most: the barcodes of reads that were put aside for their length."""
    return dense_counts(classed.where(F.col("outcome") == "Wrong Barcode Length").where(F.col("length").between(0, most)), "length", most)


def cluster_slices(reads: DataFrame, start: str, length: int = 29, flank: int = 7) -> DataFrame:
    """reads with dna and qc cut to the barcode at the 0-based place start and flank bases on either side; reads without start, those that end before the cut does, and cuts with an N go."""
    width = length + 2 * flank
    cut = lambda c: F.substr(F.col(c), F.col(start) - flank + 1, F.lit(width))
    inside = (F.col(start) >= flank) & (F.length("dna") >= F.col(start) - flank + width)
    return reads.where(inside).withColumns({"dna": cut("dna"), "qc": cut("qc")}).where(~F.contains("dna", F.lit("N")))


def commonest(counts: DataFrame, column: str) -> DataFrame:
    """The value with the largest n, the smallest of equals, and its share."""
    return counts.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column), (F.max("n") / F.sum("n")).alias("share"))


def frequent(reads: DataFrame, share: float) -> DataFrame:
    """sequence, n, share of sequences that make up at least so much of all reads.

    One total row is joined to counts; nothing is sorted.
    """
    counts = reads.groupBy(F.col("dna").alias("sequence")).agg(F.count("*").alias("n"))
    total = reads.agg(F.count("*").alias("total"))
    return counts.withColumn("share", F.col("n") / total.scalar()).where(F.col("share") >= share)


def sharing_kmers(reads: DataFrame, contaminants: DataFrame, k: int = 16) -> DataFrame:
    """Reads that have a k-mer of a contaminant (seq)."""
    kmers = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - k + 1)), lambda i: F.substr(F.col(c), i, F.lit(k)))
    known = contaminants.select(F.explode(kmers("seq")).alias("kmer")).where(F.length("kmer") == k).distinct()
    hits = reads.select("dna").distinct().select("dna", F.explode(kmers("dna")).alias("kmer")).join(known, "kmer", "left_semi").select("dna").distinct()
    return reads.join(hits, "dna", "left_semi")


def position_weights(tumors: DataFrame) -> DataFrame:
    """place, base, n, share: the bases of barcodes at each place."""
    found = tumors.select(F.posexplode(F.filter(F.split("barcode", ""), lambda c: c != "")).alias("place", "base"))
    counts = found.groupBy("place", "base").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("place")))


def between_kmers(reads: DataFrame, before: tuple[str, str], after: tuple[str, str], expected: tuple[int, int], off: int = 4, substitutions: int = 1) -> DataFrame:
    """reads with start and stop of the barcode: after the k-mer that ends the flank before it, before the one that begins the other.

    Each side has a second k-mer, next to the first and away from the barcode, that stands in where the first
    isn't found.  Places more than off bases from the expected ones are null.
    """
    from ..functions.sequence import find_with_substitutions

    place = lambda k: F.nullif(find_with_substitutions(F.col("dna"), k, substitutions), F.lit(-1))
    near, far = before
    start = F.coalesce(place(near) + len(near), place(far) + len(far) + len(near))
    stop = F.coalesce(place(after[0]), place(after[1]) - len(after[0]))
    kept = lambda c, e: F.when(F.abs(c - e) <= off, c)
    return reads.withColumns({"start": kept(start, expected[0]), "stop": kept(stop, expected[1])})


def repaired_by_template(reads: DataFrame, template: str, most: int = 3, around: int = 3) -> DataFrame:
    """reads with N bases replaced where the bases around them stand in the template once N is any base; reads with more N, and N without a match, stay.

    The template's places are tried from the left.  Each N is looked at in the order of the read.
    """
    width = 2 * around + 1
    windows = [template[i : i + width] for i in range(len(template) - width + 1)]

    def fix(dna):
        place = F.instr(dna, "N")
        inside = (place > around) & (place <= F.length(dna) - around)
        context = F.substr(dna, F.greatest(F.lit(1), place - around), F.lit(width))
        found = F.get(F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: F.forall(F.zip_with(F.split(w, ""), F.split(context, ""), lambda a, b: (a == b) | (b == "N")), lambda x: x)), F.lit(0))
        base = F.coalesce(F.substr(found, F.lit(around + 1), F.lit(1)), F.lit("n"))
        return F.when((place > 0) & inside, F.overlay(dna, base, place)).when(place > 0, F.overlay(dna, F.lit("n"), place)).otherwise(dna)

    count = F.length("dna") - F.length(F.replace("dna", F.lit("N"), F.lit("")))
    out = reads.withColumn("__fixed", F.col("dna"))
    for _ in range(most):
        out = out.withColumn("__fixed", fix(F.col("__fixed")))
    return out.withColumn("dna", F.when(count <= most, F.upper("__fixed")).otherwise(F.col("dna"))).drop("__fixed")
