"""Reading and writing FASTQ and FASTA."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

def sample():
    """A file's sample: its name up to the first point."""
    return F.regexp_extract(F.col("_metadata.file_name"), "^([^.]*)", 1)


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """(instrument) of the files' first headers; more than one row means that files of different runs are mixed."""
    firsts = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).where(F.col("value").startswith("@") & F.col("value").contains(":"))
    return firsts.groupBy("file").agg(F.first("value").alias("header")).select(F.split("header", ":")[0].alias("instrument")).distinct()


def read_fastq(spark: SparkSession, path: str, instrument: str | None = None) -> DataFrame:
    """sample, header, dna, qc of the records of plain, gz and bz2 files; files are split where a record of the instrument begins.

    instrument: what all headers begin with, up to the first colon, @ included; by default that of the first
    file.  Records of another number of lines, or with dna and qc of different lengths, are an error.
    """
    if instrument is None:
        found = [r["instrument"] for r in instruments(spark, path).limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"one instrument is needed: {found}")
        instrument = found[0]
    # a record keeps this prefix only where it begins a file
    pieces = spark.read.option("lineSep", f"\n{instrument}:").text(path).withColumn("sample", sample())
    whole = F.when(F.col("value").startswith(f"{instrument}:"), F.col("value")).otherwise(F.concat(F.lit(f"{instrument}:"), F.col("value")))
    parts = F.split(F.rtrim(F.regexp_replace(whole, "\r", ""), F.lit("\n")), "\n")
    rows = pieces.where(F.length(F.trim("value")) > 0).select("sample", parts.alias("p"))
    right = (F.size("p") == 4) & (F.length(F.get("p", F.lit(1))) == F.length(F.get("p", F.lit(3))))
    checked = F.when(right, F.get("p", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.array_join("p", " / "))))
    return rows.select("sample", checked.alias("header"), F.get("p", F.lit(1)).alias("dna"), F.get("p", F.lit(3)).alias("qc"))


def header_fields(reads: DataFrame) -> DataFrame:
    """reads with instrument, run, flowcell, lane, index and mate from their headers."""
    fields, comment = F.split(F.split("header", " ")[0], ":"), F.split(F.get(F.split("header", " "), F.lit(1)), ":")
    named = {name: F.get(fields, F.lit(k)) for k, name in enumerate(("instrument", "run", "flowcell", "lane"))}
    return reads.withColumns(named | {"mate": F.get(comment, F.lit(0)), "index": F.get(comment, F.lit(3))}).withColumn("instrument", F.regexp_replace("instrument", "^@", ""))


def fastq_text(reads: DataFrame, fake_header: str | None = None) -> DataFrame:
    """(value) records as text, four lines each."""
    return reads.select(F.concat_ws("\n", F.lit(fake_header) if fake_header else F.col("header"), "dna", F.lit("+"), "qc").alias("value"))


def write_fastq(reads: DataFrame, path: str, by: list[str] | None = None, compression: str = "gzip") -> None:
    """Write reads as FASTQ, in a folder for each value of the columns by."""
    text = reads.select(*(by or []), F.concat_ws("\n", "header", "dna", F.lit("+"), "qc").alias("value"))
    writer = text.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).text(path)


def read_set(reads: DataFrame, qualities: str = "qcs") -> DataFrame:
    """A record for each quality string of an array, all with the row's dna."""
    return reads.withColumn("qc", F.explode(qualities)).drop(qualities)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq of the records of FASTA files; sequences may have several lines."""
    pieces = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>|\r", "")
    parts = F.split(F.rtrim(body, F.lit("\n")), "\n")
    head = F.split(F.get(parts, F.lit(0)), "[ \t]+", 2)
    found = pieces.where(F.length(F.trim("value")) > 0).select(head.alias("h"), F.array_join(F.slice(parts, 2, 1_000_000), "").alias("seq"))
    return found.select(F.get("h", F.lit(0)).alias("name"), F.get("h", F.lit(1)).alias("comment"), F.regexp_replace("seq", "[^!-~]", "").alias("seq"))


OPENERS = {"gz": gzip.open, "gzip": gzip.open, "bz2": bz2.open, "xz": lzma.open, "lzma": lzma.open}


def records(lines: Iterator[str]) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, seq, qual) of FASTA and FASTQ records, mixed as they may be."""
    line = next(lines, None)
    while line is not None:
        while line is not None and line[:1] not in "@>":
            line = next(lines, None)
        if line is None:
            return
        name, _, comment = line[1:].rstrip("\r\n").partition(" ")
        seq: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in ("@", ">", "+"):
            seq.append("".join(line.split()))
            line = next(lines, None)
        whole = "".join(seq)
        if line is None or line[0] != "+":
            yield name, comment or None, whole, None
            continue
        qual = ""
        while len(qual) < len(whole):
            line = next(lines, None)
            if line is None:
                raise ValueError(f"the quality of {name} is cut off")
            qual += line.rstrip("\r\n")
        if len(qual) != len(whole):
            raise ValueError(f"sequence and quality of {name} differ in length")
        yield name, comment or None, whole, qual
        line = next(lines, None)


class _File(InputPartition):
    pass


class _Sequences(DataSourceReader):
    def __init__(self, path: str) -> None:
        from glob import glob

        self.paths = sorted(glob(path)) or [path]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition):
        opener = OPENERS.get(partition.value.rsplit(".", 1)[-1], open)
        with opener(partition.value, "rt") as lines:
            yield from records(iter(lines))


class SequenceSource(DataSource):
    """spark.read.format("sequences"): FASTA or FASTQ of any of the usual compressions, xz among them; a task for each file."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "name string, comment string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _Sequences(self.options["path"])
