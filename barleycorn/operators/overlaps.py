"""How many (target, barcode) samples have in common, for all pairs of samples that share one.

Samples are numbers, so that a pair is a few bytes.  The holders of a barcode are listed once; each sends its list
to its own sample, where pairs are counted.  Shuffled are lists, a number for each pair and barcode, and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Numbered samples that are broadcast at most, numbers that a task lists or pairs that it holds uncounted at once, and samples that a task counts.
BROADCAST, BLOCK, SAMPLES_A_TASK = 1_000_000, 4_000_000, 256


def numbered(tumors: DataFrame) -> tuple[DataFrame, int]:
    """(sample, number) of all samples, from 0 in their order, null first; and how many there are."""
    spark, names = tumors.sparkSession, written(tumors.select("sample").distinct(), "names")
    kind = names.schema["sample"].dataType.simpleString()
    in_order = names.orderBy(F.asc_nulls_first("sample")).rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    numbers = written(spark.createDataFrame(in_order, f"sample {kind}, number int"), "numbers")
    return numbers, numbers.count()


def by_number(tumors: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """tumors with their sample's number, a barcode's rows together."""
    known = (F.broadcast(numbers) if n <= BROADCAST else numbers).withColumnRenamed("sample", "__sample")
    return tumors.join(known, F.col("sample").eqNullSafe(F.col("__sample"))).drop("sample", "__sample").repartition("target", "barcode")


def _kind(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _lists(number: np.ndarray, asks: np.ndarray, begins: np.ndarray, later: bool, kind: type) -> Iterator[pa.RecordBatch]:
    """(a, others) of barcodes whose holders begin where begins has them: the other holders for those who ask, those of a greater number with later."""
    sizes = np.diff(np.append(begins, len(number)))
    if later:
        number = number[np.lexsort((number, np.repeat(np.arange(len(begins)), sizes)))]
    row = np.arange(len(number))
    first, last = (row + 1, np.repeat(begins + sizes, sizes)) if later else (np.repeat(begins, sizes), np.repeat(begins + sizes, sizes) - 1)
    length = np.where(asks, last - first, 0)
    if later:
        row, first, length = (x[length > 0] for x in (row, first, length))
    upto = np.cumsum(length)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
        own, size = row[at:stop], length[at:stop]
        offsets = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(first[at:stop] - offsets[:-1], size) + np.arange(offsets[-1])
        if not later:
            place += place >= np.repeat(own, size)
        data = number[place].astype(kind)
        others = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.array(number[own].astype(np.int32)), others], names=["a", "others"])
        at = stop


def listed(holders: DataFrame, n: int, later: bool) -> DataFrame:
    """(a, others) for each row of holders (number, target, barcode, asks), of which a barcode's are in one partition: the numbers of the barcode's other holders, none where it doesn't ask; with later, rows of holders with a greater number alone."""
    kind = _kind(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, asks, last = np.empty(0, np.int64), np.empty(0, bool), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column("target"), batch.column("barcode")]
            known = np.logical_and(*[np.asarray(k.is_valid()) for k in keys])
            fresh = np.ones(batch.num_rows, bool)
            for k in keys:
                codes = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                fresh[1:] = fresh[1:] & (codes[1:] == codes[:-1])
            fresh[1:] = ~(fresh[1:] & known[1:])
            ends = [(k[0].as_py(), k[-1].as_py()) for k in keys]
            fresh[0] = not known[0] or last != tuple(e[0] for e in ends)
            begins = np.concatenate([np.zeros(min(1, len(number)), np.int64), len(number) + np.flatnonzero(fresh)])
            number = np.concatenate([number, batch.column("number").to_numpy().astype(np.int64)])
            asks = np.concatenate([asks, np.asarray(batch.column("asks")) & known])
            cut, last = begins[-1], tuple(e[1] for e in ends)
            yield from _lists(number[:cut], asks[:cut], begins[:-1], later, kind)
            number, asks = number[cut:], asks[cut:]
        if len(number):
            yield from _lists(number, asks, np.zeros(1, np.int64), later, kind)

    return holders.select("number", "target", "barcode", "asks").sortWithinPartitions("target", "barcode").mapInArrow(run, "a int, others binary")


def counted(lists: DataFrame, n: int, least: int = 1, totals: bool = False) -> DataFrame:
    """(a, b, shared, barcodes, links): how often a's lists hold b, if at least so often; with totals, a row without b for each a that has how many lists it has and how many numbers they hold."""
    kind = _kind(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, links = np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs, times, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, often = np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True)
            both = np.concatenate([pairs, fresh])
            order = np.argsort(both, kind="stable")
            both, often = both[order], np.concatenate([times, often])[order]
            first = np.flatnonzero(np.diff(both, prepend=-1))
            return both[first], np.add.reduceat(often, first) if len(first) else often

        for batch in batches:
            a, others = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
            offsets = np.frombuffer(others.buffers()[1], np.int32)[others.offset : others.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
            held = np.diff(offsets) // np.dtype(kind).itemsize
            b = np.frombuffer(others.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
            if totals:
                rows += np.bincount(a, minlength=n)
                np.add.at(links, a, held)
            waiting.append((np.repeat(a, held) << 32) | b.astype(np.int64))
            size += len(b)
            if size > max(BLOCK, len(pairs)):
                pairs, times = merged()
                waiting, size = [], 0
        pairs, times = merged()
        pairs, times = pairs[times >= least], times[times >= least]
        for at in range(0, len(pairs), 1 << 17):
            p, t = pairs[at : at + (1 << 17)], times[at : at + (1 << 17)]
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array((p >> 32).astype(np.int32)), pa.array((p & 0xFFFFFFFF).astype(np.int32)), pa.array(t), none, none], names=["a", "b", "shared", "barcodes", "links"])
        seen = np.flatnonzero(rows)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.nulls(len(seen), pa.int32()), pa.nulls(len(seen), pa.int64()), pa.array(rows[seen]), pa.array(links[seen])], names=["a", "b", "shared", "barcodes", "links"])

    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(max(parts, -(-n // SAMPLES_A_TASK)), "a").mapInArrow(run, "a int, b int, shared long, barcodes long, links long")


def named(pairs: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """pairs with the names of a and b in place of their numbers; those of samples without a name go."""
    known = numbers.where("sample is not null")
    known = F.broadcast(known) if n <= BROADCAST else known
    for c in ("a", "b"):
        pairs = pairs.join(known.select(F.col("number").alias(c), F.col("sample").alias(f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
    return pairs
