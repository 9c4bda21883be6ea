"""Packing token sequences into windows: non-negative least squares on the length histogram.

Documents are tokenised once, by executors, and cut into full windows and one remainder.  The
remainders' lengths make a histogram of a fixed number of length classes, whatever the input's size.
Shallow combinations of classes that fill a window exactly (up to three pieces) get repeat counts by
non-negative least squares against the histogram; counts are rounded down, and what is left over is
packed greedily, largest class first.  Both give a plan of patterns and repeats; pieces find their
place in it by their rank within their class, so no sequence is ever built in one place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 4096
END_ID = 2
#: Lengths to FINE are classes of their own; longer ones are rounded up to a multiple of STEP.
FINE, STEP = 128, 8
#: Words whose ids a worker remembers; others are encoded each time they occur.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: White space to str.split() but ordinary text to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*#$%&|)\\]}]*)")
ASCII_SPACE = re.compile("[ \t-\r]+")
#: Pieces of one length class are ranked in so many rows at a time.
RANKED_ROWS = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: A worker's encoders by tokenizer, kept from task to task.
_ENCODERS: dict = {}


def encoder(tokenizer_path: str):
    """A function from a list of texts to the little-endian 32-bit ids of each.

    The tokenizer drops white space and never joins what white space separates, so the ids of a text are
    those of its chunks between ASCII white space.  Nor does it join a run of letters with the signs after
    it, and it ignores case.  Bounded numbers of chunks and of such words are remembered.
    """
    if tokenizer_path in _ENCODERS:
        return _ENCODERS[tokenizer_path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    model = tokenizer.model
    letters = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
    chunks: dict[str, bytes] = {}
    known: dict[str, bytes] = {"": b""}

    def whole(chunk: str) -> bytes:
        return np.asarray(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def word(low: str) -> bytes:
        plain = low if low.isascii() else low.translate(letters)
        return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(plain)])

    def remembered(part: str, make) -> bytes:
        ids = known.get(part)
        if ids is None:
            ids = make(part)
            if len(known) < CACHE_WORDS:
                known[part] = ids
        return ids

    def chunk(text: str) -> bytes:
        ids = chunks.get(text)
        if ids is None:
            m = PLAIN.fullmatch(text) if len(text) <= CACHE_CHARS else None
            ids = remembered(m[1].lower(), word) + remembered(m[2], whole) if m else whole(text)
            if len(chunks) < CACHE_WORDS and len(text) <= CACHE_CHARS:
                chunks[text] = ids
        return ids

    def encode(texts: list[str]) -> list[bytes]:
        return [b"".join([chunks.get(w) or chunk(w) for w in (ASCII_SPACE.split(t) if SEPARATORS.search(t) else t.split()) if w]) for t in texts]

    _ENCODERS[tokenizer_path] = encode
    return encode


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row for each piece of at most WINDOW ids of each document, the end id included; null text is empty."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 64):
                out: list[list] = [[], [], [], [], []]
                few = [t or "" for t in texts.slice(at, 64).to_pylist()]
                for doc_id, packed in zip(ids[at : at + 64], encode(few), strict=True):
                    packed += end
                    for start in range(0, len(packed), 4 * WINDOW):
                        piece = packed[start : start + 4 * WINDOW]
                        for column, value in zip(out, (doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(packed) // 4), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def combinations(window: int, step: int) -> np.ndarray:
    """All non-increasing triples of multiples of step, zeros at the end, with the sum window."""
    n = window // step
    rows = [(a, b, n - a - b) for a in range(-(-n // 3), n + 1) for b in range(-(-(n - a) // 2), min(a, n - a) + 1)]
    return np.array(rows, np.int64) * step


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with little ||A x - histogram||, by accelerated projected gradients; A counts a combination's classes."""
    size = len(histogram)
    flat = combos.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, np.repeat(x, combos.shape[1]), size)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate = 1 / (np.linalg.norm(back(forward(v))) * 1.05)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - rate * back(forward(y) - histogram))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, step: int = STEP) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(class, how many)]) of each pattern; together they use every piece of the histogram once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns: list[tuple[int, list[tuple[int, int]]]] = []
    if left[window]:
        patterns.append((int(left[window]), [(window, 1)]))
        left[window] = 0
    combos = combinations(window, step)
    combos = combos[(left[combos] + (combos == 0) > 0).all(1)]
    if len(combos):
        solved = np.floor(least_squares(combos, left.astype(float))).astype(np.int64)
        for k in np.argsort(-solved, kind="stable"):
            if not solved[k]:
                break
            parts = [(int(c), int((combos[k] == c).sum())) for c in sorted(set(combos[k].tolist()) - {0}, reverse=True)]
            repeats = min(int(solved[k]), *(int(left[c]) // m for c, m in parts))
            if repeats:
                patterns.append((repeats, parts))
                for c, m in parts:
                    left[c] -= m * repeats
    some = np.flatnonzero(left)
    while len(some):
        space, parts = window, []
        for c in some[::-1]:
            if m := min(space // int(c), int(left[c])):
                parts.append((int(c), m))
                space -= m * int(c)
        repeats = min(int(left[c]) // m for c, m in parts)
        patterns.append((repeats, parts))
        for c, m in parts:
            left[c] -= m * repeats
        some = some[left[some] > 0]
    return patterns


def packed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each piece of each document with its sequence and its offset there.

    docs: doc_id and text; other columns are ignored, whatever their names.  Null text is empty, and an
    empty document is its end id alone.  A doc_id that occurs twice gives two documents.  Sequences hold at
    most WINDOW ids; offsets have no gap.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path), "pieces")
    size = F.when(F.col("length") <= FINE, F.col("length")).otherwise(F.ceil(F.col("length") / STEP) * STEP).cast("int")
    histogram = {r["size"]: r["count"] for r in cut.groupBy(size.alias("size")).count().collect()}  # FINE + WINDOW / STEP classes at most
    slots, base, used = [], 0, dict.fromkeys(histogram, 0)
    for repeats, parts in plan(histogram):
        for place, (c, m) in enumerate(parts):
            slots.append((c, used[c], used[c] + m * repeats, m, base, place))
            used[c] += m * repeats
        base += repeats
    assert used == histogram
    # ranks within a class: by salt first, so that one class can hold any share of the pieces
    salts = max(16, sum(histogram.values()) // RANKED_ROWS)
    salted = cut.withColumn("size", size).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("size", "salt").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("size", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    order = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = salted.withColumn("row", F.row_number().over(order)).join(before, ["size", "salt"]).withColumn("rank", F.col("row") - 1 + F.col("before"))
    places = spark.createDataFrame(slots, "size int, low long, high long, m long, base long, place int")
    put = ranked.join(F.broadcast(places), (ranked["size"] == places["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    put = put.withColumn("sequence_id", F.col("base") + F.expr("(rank - low) div m")).withColumn("nth", nth % F.col("m"))
    sums = Window.partitionBy("sequence_id").orderBy("place", "nth").rowsBetween(Window.unboundedPreceding, 0)
    return put.withColumn("offset", F.sum("length").over(sums) - F.col("length")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
