import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barleycorn.llm import packing
from barleycorn.llm.queries import op3_packing, tokenizer_path

PATH = tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["It's don'T we'll", "a <|endoftext|> b<|startoftext|>", "x́ ́y été", " a\xa0b\x85c\x1cd\x1d e", "ΣΑΣ İ ß×ªµÿŸ", "thes*** a.. b,. c!!​", "12ab34 中文 한ᄒ", "\x00\x01", "aaa|>́"]


@pytest.mark.parametrize("text", ODD)
def test_chunks_encode_as_the_whole(text):
    want = np.asarray(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.encoder(PATH)([text]) == [want]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n.,'sStT<|>*ÀéßÏaŹ\x1f\xa0 "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_encodes_as_the_whole(text):
    want = np.asarray(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.encoder(PATH)([text]) == [want]


def held(rows, texts):
    """Every id in one piece, every piece in one place, no gap, no overflow."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = np.asarray([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return sum(r.length for r in rows) / (packing.WINDOW * len(places))


def test_documents(spark, tables):
    rows = op3_packing(spark, tables).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert set(texts) == {r.doc_id for r in rows}
    assert held(rows, texts) > 0.97


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "the " * 9000, 4: " \n", 5: "the"} | {k: "of the" for k in range(10, 60)}
    docs = spark.createDataFrame([(k, t, t, 0) for k, t in texts.items()], "doc_id long, text string, size string, salt int")
    held(packing.packed(docs, PATH).collect(), texts)
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_repeated_rows_are_two_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = packing.packed(docs, PATH).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2


def test_a_plan_uses_every_piece_once_with_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(packing.WINDOW, rng.lognormal(6.5, 1, 60_000).astype(int) + 1)
    sizes = np.where(lengths <= packing.FINE, lengths, -(-lengths // packing.STEP) * packing.STEP)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    used, sequences = defaultdict(int), 0
    for repeats, parts in packing.plan(histogram):
        assert sum(c * m for c, m in parts) <= packing.WINDOW
        sequences += repeats
        for c, m in parts:
            used[c] += repeats * m
    assert dict(used) == histogram
    assert lengths.sum() / (sequences * packing.WINDOW) > 0.99
