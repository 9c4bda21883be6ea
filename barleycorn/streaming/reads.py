"""Reads as they come: filters need no state, tallies a count for each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequence import passes_chastity
from ..operators.reads import chaste, without_degenerate


def written_stream(reads: DataFrame, path: str, state: str) -> StreamingQuery:
    """Write the clean reads that are there, once each, as Parquet by sample."""
    clean = without_degenerate(chaste(reads))
    return clean.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).partitionBy("sample").trigger(availableNow=True).start()


def running_tallies(reads: DataFrame) -> DataFrame:
    """sample, reads, and how many passed the filter."""
    return reads.groupBy("sample").agg(F.count("*").alias("n"), F.sum(passes_chastity(F.col("header")).cast("long")).alias("passed"))
