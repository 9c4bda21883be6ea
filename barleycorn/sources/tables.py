"""Reading and writing the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.estimators import ESTIMATORS
from .fastq import sample

CLUSTER_COLUMNS = ("sequence", "abundance", "n0", "n1", "nunq", "pval", "birth_pval", "birth_ham")
_KINDS = {"sequence": "string", "pval": "double", "birth_pval": "double", "birth_ham": "int"}


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster tables with a header, one file a sample; columns that aren't needed aren't read."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(sample().alias("sample"), *[F.col(c).cast(_KINDS.get(c, "long")).alias(c) for c in CLUSTER_COLUMNS])


def read_ranked_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster tables by position: id, sequence, score, abundance."""
    raw = spark.read.option("header", True).schema("id long, sequence string, score double, abundance long").csv(path)
    return raw.select(sample().alias("sample"), "sequence", "abundance")


def read_sgrnas(spark: SparkSession, path: str) -> DataFrame:
    """sequence, id, target of a guide table; ids in capitals, missing ones empty, all of one length or an error."""
    raw = spark.read.option("header", True).csv(path)
    found = raw.select(F.col("Sequence").alias("sequence"), F.upper(F.coalesce("ID", F.lit(""))).alias("id"), "target")
    lengths = [r[0] for r in found.where("id <> ''").select(F.length("id")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("guide ids differ in length")
    return found


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """sample, barcode of a run's index map: two columns by tab, without a header; as dual_index() takes it."""
    return spark.read.option("sep", "\t").schema("sample string, barcode string").csv(path).where("barcode is not null")


def read_spacers(spark: SparkSession, path: str) -> DataFrame:
    """input_file, forward_spacer_length, reverse_spacer_length, sample of a spacer map with a header, by the names of its columns."""
    raw = spark.read.option("header", True).csv(path)
    lengths = [F.col(f"{k}_spacer_length").cast("int").alias(f"{k}_spacer_length") for k in ("forward", "reverse")]
    return raw.select("input_file", *lengths, "sample")


def read_tallies(spark: SparkSession, path: str) -> DataFrame:
    """sample, mutation, phred, n of mutation tables: from, to, and a column for each Phred score."""
    raw = spark.read.option("header", True).csv(path).withColumn("sample", sample())
    first, second, *phreds = [c for c in raw.columns if c != "sample"]
    long = raw.unpivot(["sample", first, second], phreds, "phred", "n")
    return long.select("sample", F.concat(first, F.lit("2"), second).alias("mutation"), F.col("phred").cast("int"), F.coalesce(F.col("n").cast("double").cast("long"), F.lit(0)).alias("n"))


def merge_replicates(tumors: DataFrame, by: list[str], how: str = "mean", value: str = "cells") -> DataFrame:
    return tumors.groupBy(*by).agg(ESTIMATORS[how](value).alias(value))


def with_metadata(tumors: DataFrame, metadata: DataFrame, columns: list[str], drop: str | None = None, merger: str | None = None, how: str = "mean") -> DataFrame:
    """Tumours with columns of their samples' metadata, without the samples whose column drop is true, replicates of one merger name merged."""
    kept = metadata if drop is None else metadata.where(~F.coalesce(F.col(drop).cast("boolean"), F.lit(False)))
    joined = tumors.join(kept.select("sample", *columns, *([merger] if merger and merger not in columns else [])), "sample")
    if merger is None:
        return joined
    named = joined.withColumn("sample", F.coalesce(F.col(merger), F.col("sample")))
    return merge_replicates(named, [*columns, "sample", "target", "barcode"], how)


def write_combined(df: DataFrame, path: str) -> None:
    """CSV with a header, gzipped."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def transition_matrix(tallies: DataFrame, most_phred: int) -> DataFrame:
    """A row for each mutation and a column for each Phred score from 0, zeros where none was seen."""
    return tallies.groupBy("mutation").pivot("phred", list(range(most_phred + 1))).agg(F.sum("n")).na.fill(0)


def read_matrix(lines: list[str]) -> tuple[list[str], list[list[int]]]:
    """Letters and scores of a substitution matrix: a header of letters, rows that may begin with theirs, # for comments."""
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    letters = rows[0]
    scores = [[int(v) for v in (r[1:] if len(r) > len(letters) else r)] for r in rows[1:]]
    if len(scores) != len(letters) or any(len(r) != len(letters) for r in scores):
        raise ValueError("not a square matrix")
    return letters, scores


def sam_header(targets: DataFrame) -> DataFrame:
    """(value): the header lines of a SAM file, of targets (name, sequence), in order: the version, then each target's name and length."""
    first = targets.sparkSession.createDataFrame([("@HD\tVN:1.4\tSO:queryname",)], "value string")
    return first.unionByName(targets.orderBy("name").select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.length("sequence").cast("string")).alias("value")))


def sam_lines(aligned: DataFrame, reference_name: str) -> DataFrame:
    """(value) SAM records of reads with score, score2, ref_begin, ref_begin's cigar and nm; unaligned reads have flag 4."""
    apart = F.abs(F.col("score") - F.col("score2")) / F.greatest(F.col("score"), F.lit(1))
    mapq = F.when(F.col("score") == F.col("score2"), 0).otherwise(F.least(F.lit(254), F.floor(F.floor(-4.343 * F.ln(F.greatest(1 - apart, F.lit(1e-30)))) + 4.99))).cast("int")
    hit = F.col("score") > 0
    flag = F.when(~hit, 4).when(F.col("reverse"), 16).otherwise(0)
    tags = F.concat_ws("\t", F.concat(F.lit("AS:i:"), "score"), F.concat(F.lit("NM:i:"), "nm"), F.concat(F.lit("ZS:i:"), "score2"))
    head = ["name", flag.cast("string"), F.when(hit, F.lit(reference_name)).otherwise("*"), F.when(hit, F.col("ref_begin") + 1).otherwise(0).cast("string"), F.when(hit, mapq).otherwise(0).cast("string"), F.when(hit, F.col("cigar")).otherwise("*")]
    return aligned.select(F.concat_ws("\t", *head, F.lit("*"), F.lit("0"), F.lit("0"), "dna", F.lit("*"), tags).alias("value"))
