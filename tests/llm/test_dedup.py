import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleycorn.llm import caps, lines, minhash
from barleycorn.llm.queries import op1_line_dedup, op2_minhash, op5_embedding_caps

from . import brute


def texts(spark, tables):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}


def word_salad(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def crowd():
    """A base text with many near copies, exact copies, chains of small changes, and unrelated texts."""
    rng = random.Random(5)
    base, docs = word_salad(rng, 120), []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(10**6))
        docs.append(copy)
    docs += [list(base)] * 20
    chain = word_salad(rng, 90)
    for k in range(25):
        chain = list(chain)
        chain[(7 * k) % 90] = f"link{k}"
        docs.append(chain)
    docs += [word_salad(rng, rng.randrange(1, 150)) for _ in range(60)]
    rng.shuffle(docs)
    joined = {10 * k: " ".join(d) for k, d in enumerate(docs)}
    return joined | {-5: None, -4: "", -3: " \t\n", -2: "two Words", -1: "TWO words", 3: "é É", 4: "É É"}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, 1, 2, "x", "y") for k, t in docs.items()], "doc_id long, text string, id long, key int, n string, doc string")


@pytest.mark.parametrize("n, compared", [(4, 1 << 20), (5, 1 << 20), (5, 2)])
def test_minhash_of_a_crowd(spark, crowd, n, compared, monkeypatch):
    monkeypatch.setattr(minhash, "COMPARED", compared)
    rows = minhash.near_duplicates(frame(spark, crowd), minhash.MinHash(words=n)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(crowd, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(crowd)


def test_minhash_of_documents(spark, tables):
    rows = op2_minhash(spark, tables).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(texts(spark, tables), 4)


def test_minhash_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    rows = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def line_crowd():
    rng = random.Random(8)
    base, docs = [word_salad(rng, 25) for _ in range(6)], {}
    for k in range(70):
        own = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(base)) if rng.random() < 0.6 else word_salad(rng, rng.randrange(1, 40))
            for _ in range(rng.randrange(6)):
                line[rng.randrange(len(line))] = rng.choice(["the", "of", f"new{rng.randrange(500)}"])
            own.append(" ".join(line))
        docs[k * 3] = "\n".join(own + ["", "short line"])
    return docs | {1000: None, 1001: "", 1002: "a b c d e f", 1003: "f e d c b a a a"}


def removed(before, rows):
    out = set()
    for r in rows:
        if before[r.doc_id] is None:
            assert r.text is None
            continue
        kept, gone = r.text.split("\n") if r.n_removed < r.n_lines else [], 0
        for no, line in enumerate(before[r.doc_id].split("\n")):
            if kept and kept[0] == line:
                kept.pop(0)
            else:
                out.add((r.doc_id, no))
                gone += 1
        assert not kept and gone == r.n_removed
    return out


@pytest.mark.parametrize("crowd", [2, 200])
def test_line_matches_are_exact(spark, crowd):
    docs = line_crowd()
    late = {(r.doc, r.line) for r in lines.later_matches(lines.numbered(frame(spark, docs)), lines.Similar(crowd=crowd)).collect()}
    assert late == brute.later_lines(docs)
    assert {t for t in late if len(set(brute.words(docs[t[0]].split("\n")[t[1]]))) < 5}


def test_few_pairs_of_a_crowd_of_near_copies(spark, monkeypatch):
    rng, pairs = random.Random(3), []
    base = [f"word{k}" for k in range(70)]
    docs = {}
    for k in range(300):
        line = list(base)
        for at in rng.sample(range(70), rng.randrange(3, 9)):
            line[at] = f"other{rng.randrange(400)}"
        docs[k] = " ".join(line)
    kept = lines.written

    def counted(df, what):
        out = kept(df, what)
        pairs.extend([out.count()] if what == "pairs" else [])
        return out

    monkeypatch.setattr(lines, "written", counted)
    late = {(r.doc, r.line) for r in lines.later_matches(lines.numbered(frame(spark, docs))).collect()}
    assert late == brute.later_lines(docs)
    assert pairs[0] < 4500  # 5,333 with the earliest line of the three rarest words alone


def test_a_pair_is_found_by_its_first_common_word(spark):
    rows = [(k, 0, 0, 40, 0, None, place, token, before, False) for k in (1, 2) for place, token, before in ((0, 7 * k, None), (1, 5, 7 * k), (2, 6, 5), (3, 8, 6))]
    rows = spark.createDataFrame(rows, "doc long, twin long, line int, n int, bits long, more long, place int, token int, before int, done boolean")
    joined = rows.alias("a").join(rows.alias("b"), F.expr(f"a.token = b.token and {lines.allowed(lines.Similar(), first=True)}"))
    assert [(r.token, r.place) for r in joined.select("a.token", "a.place").collect()] == [(5, 1)]


def test_line_dedup_keeps_columns_and_rows(spark):
    docs = {1: "a b c d e f\nx", 2: "f e d c b a\ny", 3: None, 4: ""}
    rows = lines.deduplicated(frame(spark, docs)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == {1: ("a b c d e f\nx", 0), 2: ("y", 1), 3: (None, 0), 4: ("", 0)}
    assert rows[0].doc == "y" and rows[0].key == 2
    assert lines.deduplicated(frame(spark, docs).limit(0)).count() == 0
    twice = frame(spark, {5: "a b c d e f"}).union(frame(spark, {5: "a b c d e f"})).union(spark.createDataFrame([(None, "a b c d e f", 1, 2, "", "")], frame(spark, docs).schema))
    assert [r.n_removed for r in lines.deduplicated(twice).collect()] == [0, 0, 0]


def test_line_dedup_of_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 3), (5, "p q r s t u", 3), (5, "f e d c b a", 3), (5, "f e d c b a", 3), (6, "", 3), (7, "u t s r q p\n" + "w " * 30_000, 3), (8, "x" * 50_000 + "\nx\nx", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    out = lines.deduplicated(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_removed", "n_lines"])
    got = sorted((r.doc_id, r.text, r.n_removed) for r in out.collect())
    assert got == sorted([(1, "a b c d e f", 0), (5, "p q r s t u", 0), (5, "", 1), (5, "", 1), (6, "", 0), (7, "w " * 30_000, 1), (8, "x" * 50_000 + "\nx", 1)])


def test_line_dedup_of_documents(spark, tables):
    before = texts(spark, tables)
    rows = op1_line_dedup(spark, tables).collect()
    assert len(rows) == len(before)
    late = brute.later_lines(before)
    assert sum(r.n_removed for r in rows) == len(late)
    for r in rows:
        assert r.text == "\n".join(x for no, x in enumerate(before[r.doc_id].split("\n")) if (r.doc_id, no) not in late)


def test_vectors_against_all_pairs(spark, tables):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    want = brute.near_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op5_embedding_caps(spark, tables).collect()}
    assert got == want


def test_a_crowd_of_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    rows = [(k, 1, (base + 0.08 * rng.normal(size=32)).tolist()) for k in range(150)]
    rows += [(200 + k, 1, base.tolist()) for k in range(40)] + [(300 + k, 2, (2 * base).tolist()) for k in range(3)]
    rows += [(400 + k, k % 3, rng.normal(size=32).tolist()) for k in range(100)]
    rows += [(600, None, base.tolist()), (601, 1, None), (602, 1, [0.0] * 32), (603, 1, [None] + base.tolist()[1:]), (604, 1, [float("nan")] * 32), (605, 1, [float("inf")] + [1.0] * 31), (606, 1, [])]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, label int, embedding array<double>, id int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(df, caps.Caps(block=32)).collect()}
    want = brute.near_vectors([r for r in rows if r[0] < 600]) | {k: (0, k) for k in range(600, 607)}
    links = sum(w[0] for w in want.values())
    assert len(got) == len(rows) and all(got[k][0] <= want[k][0] for k in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * links
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_width_and_size(spark):
    rng = np.random.default_rng(5)
    rows = [(k, 1, rng.normal(size=4).tolist()) for k in range(60)] + [(100 + k, 1, [1.0, 2.0, 3.0]) for k in range(2)] + [(110 + k, 1, [x, 0.0, 0.0, 0.0]) for k, x in enumerate((1e200, 3e200, 1e-200, 5e-310))]
    rows += [(120, 1, [7.0]), (121, 1, [2.0]), (122, 1, [-2.0]), (120, 2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(df.where("label = 1")).collect()}
    want = {}
    for width in (4, 3, 1):  # by hand: scaled, as squares of such numbers overflow
        own = [(k, lab, [x / max(map(abs, v)) for x in v]) for k, lab, v in rows if len(v) == width and lab == 1]
        want |= brute.near_vectors(own)
    assert got == want and got[111] == (got[110][0], got[110][1]) and got[100] == (1, 100) and got[121] == (1, 120)
