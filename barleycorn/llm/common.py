"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written  # noqa: F401

#: Words are runs of anything but the ASCII white space 0x20 and 0x09 to 0x0D.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(*tables: DataFrame) -> None:
    """Remove the files of written() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def words(text):
    """The words of a text column as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def let(value, body):
    """body(value) with value computed once a row and not again in every lambda call."""
    return F.transform(F.array(value), body)[0]


#: Rows up to this number, of a few numbers each, are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def light(df: DataFrame, most: int = BROADCAST_ROWS, weight=None) -> DataFrame:
    """df, of a few numbers a row and cheap to read, marked for a broadcast if its size allows; weight: how many numbers a row has beyond these."""
    if df.count() > most or weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > most:
        return df
    return F.broadcast(df)
