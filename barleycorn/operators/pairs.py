"""Merging of paired-end reads by their overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def overlap(a: str, b: str, least: int, wrong: float) -> int:
    """The longest overlap of the end of a and the begin of b with at most a share of wrong bases; 0 if there is none."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    for n in range(min(len(x), len(y)), least - 1, -1):
        p, q = x[len(x) - n :], y[:n]
        if ((p != q) & (p != 78) & (q != 78)).sum() <= wrong * n:
            return n
    return 0


def joined(a: str, qa: str, b: str, qb: str, n: int, top: int) -> tuple[str, str]:
    """The merged read: where both agree qualities add up to top, elsewhere the better base with the difference."""
    dna, qc = [a[: len(a) - n]], [qa[: len(a) - n]]
    for x, p, y, q in zip(a[len(a) - n :], qa[len(a) - n :], b[:n], qb[:n], strict=True):
        p, q = ord(p) - 33, ord(q) - 33
        both = min(top, p + q) if x == y else abs(p - q)
        dna.append(x if y == "N" or x != "N" and p >= q else y)
        qc.append(chr(33 + both))
    return "".join(dna) + b[n:], "".join(qc) + qb[n:]


def merged_pairs(forward: DataFrame, reverse: DataFrame, least_overlap: int = 10, least_length: int = 73, wrong: float = 0.1, top: int = 40) -> DataFrame:
    """name, outcome (assembled, discarded for its length, or not assembled), dna, qc of mates with one name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, a, qa, b, qb in zip(f["name"], f["dna"], f["qc"], f["dna2"], f["qc2"], strict=True):
                b, qb = b.translate(_COMPLEMENT)[::-1], qb[::-1]
                n = overlap(a, b, least_overlap, wrong)
                dna, qc = joined(a, qa, b, qb, n, top) if n else (None, None)
                outcome = "not assembled" if not n else "assembled" if len(dna) >= least_length else "discarded"
                rows.append((name, outcome, dna if outcome == "assembled" else None, qc if outcome == "assembled" else None))
            yield pd.DataFrame(rows, columns=["name", "outcome", "dna", "qc"])

    both = forward.select("name", "dna", "qc").join(reverse.select("name", F.col("dna").alias("dna2"), F.col("qc").alias("qc2")), "name")
    return both.mapInPandas(run, "name string, outcome string, dna string, qc string")
