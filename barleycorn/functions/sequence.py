"""Column expressions on DNA and quality strings."""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Ways to place substitutions in a motif that one regular expression lists.
MOST_WILDCARDS = 256


def gc_count(dna: Column) -> Column:
    """How many G and C."""
    return F.length(dna) - F.length(F.regexp_replace(dna, "[GC]", ""))


def degenerate(dna: Column) -> Column:
    return F.contains(dna, F.lit("N"))


def passes_chastity(header: Column) -> Column:
    """Whether the sequencer's filter let the read pass: its header doesn't say :Y:."""
    return ~F.contains(header, F.lit(":Y:"))


def bases(dna: Column) -> Column:
    return F.filter(F.split(dna, ""), lambda c: c != "")


def hamming(a: Column, b: Column, length: int | None = None) -> Column:
    """Differences of two strings of one length; null for different lengths.  With a length, for strings of that length: compared place by place in generated code."""
    if length is not None:
        count = sum(((F.substring(a, k + 1, 1) != F.substring(b, k + 1, 1)).cast("int") for k in range(length)), F.lit(0))
        return F.when((F.length(a) == length) & (F.length(b) == length), count)
    count = F.aggregate(F.zip_with(bases(a), bases(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x)
    return F.when(F.length(a) == F.length(b), count)


def find_with_substitutions(dna: Column, motif: str | Column, most: int) -> Column:
    """The leftmost 0-based place where motif stands with at most so many substitutions, or -1.

    A motif that is known beforehand is one regular expression with a wildcard for each substitution.
    """
    if isinstance(motif, str) and 0 < most < len(motif) and comb(len(motif), most) <= MOST_WILDCARDS:
        ways = ["".join("." if k in free else re.escape(c) for k, c in enumerate(motif)) for free in combinations(range(len(motif)), most)]
        return F.coalesce(F.regexp_instr(dna, F.lit(f"(?s)(?:{'|'.join(ways)})")) - 1, F.lit(-1))
    motif = F.lit(motif) if isinstance(motif, str) else motif
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(dna) - F.length(motif)))
    hits = F.filter(places, lambda i: F.coalesce(hamming(dna.substr(i + 1, F.length(motif)), motif) <= most, F.lit(False)))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))


def piece(text: Column, start: Column | int, stop: Column | int) -> Column:
    """text[start:stop] with 0-based bounds inside the text."""
    start = F.lit(start) if isinstance(start, int) else start
    stop = F.lit(stop) if isinstance(stop, int) else stop
    return text.substr(start + 1, F.greatest(F.lit(0), stop - start))


def expected_errors(qc: Column) -> Column:
    """The sum of the error probabilities that Phred+33 characters stand for; an error outside of characters 33 to 75."""
    codes = F.transform(bases(qc), lambda c: F.ascii(c))
    total = F.aggregate(F.transform(codes, lambda c: F.pow(F.lit(10.0), (33 - c) / 10.0)), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.exists(codes, lambda c: (c < 33) | (c > 75)), F.raise_error(F.lit("quality outside of Phred 0 to 42")).cast("double")).otherwise(total)


def fill_from_mate(index: Column, mate: Column) -> Column:
    """index with its N bases taken from mate, base by base."""
    return F.array_join(F.zip_with(bases(index), bases(mate), lambda a, b: F.when(a == "N", F.coalesce(b, a)).otherwise(a)), "")


def longest_run(dna: Column) -> Column:
    """The length of the longest run of one base."""
    runs = F.regexp_extract_all(dna, F.lit("((.)\\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters, one byte each (? for those beyond ASCII), and where each text begins; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    starts = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if len(texts) and (data[starts[0] : starts[-1]] > 127).any():
        plain = [t.encode("ascii", "replace") for t in texts.to_pylist()]
        return np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])
    return data, starts
