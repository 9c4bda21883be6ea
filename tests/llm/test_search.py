"""Phrases, spelling variants and nearest neighbours against plain Python."""

import random

import duckdb
import numpy as np
import pytest

from barleycorn.llm import collocations, neighbours, spelling
from barleycorn.llm.queries import SQL, op11_collocations, op12_spelling_variants, op13_nearest_neighbours

from . import brute


def read(spark, tables, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{tables}/{name}.parquet").select(*columns).collect()]


# ---- phrases


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_of_documents(spark, tables):
    got = phrases(op11_collocations(spark, tables))
    assert got == brute.collocations(read(spark, tables, "documents", "lang", "text")) and got
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tables}/documents.parquet'")
    assert sorted(duck.sql(SQL["op11_collocations"]).select("lang, rank, phrase, a, l, r, n, score").fetchall()) == got


@pytest.fixture(scope="module")
def salad():
    rng = random.Random(11)
    words = [rng.choice("abcdé") + rng.choice("xyzÀ") for _ in range(25)]
    rows = [("en", " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\n", "\t", " "]) for _ in range(rng.randrange(400)))) for _ in range(30)]
    rows += [("de", "The  CAT.sat the cat\tsat; the cat sat")] * 12 + [("en", "the same words again and again")] * 15
    return rows + [(None, "und die katze und die katze und die katze")] * 10 + [("en", None), ("en", ""), (None, None), ("fr", " \t .,;"), ("en", "x" * 5000 + " " + "aa bb " * 4000)]


@pytest.mark.parametrize("size, how", [(1 << 24, {}), (300, {"bits": 15}), (1 << 24, {"shard": 40, "at_once": 2}), (1 << 24, {"longest": 4, "top": 7})])
def test_collocations_of_odd_texts(spark, salad, size, how, monkeypatch):
    monkeypatch.setattr(collocations.slices, "__defaults__", (size,))
    docs = spark.createDataFrame([(lang, text, 1, "a") for lang, text in salad], "lang string, text string, n long, phrase string")
    got = phrases(collocations.collocations(docs, collocations.Phrases(**how)))
    assert got == brute.collocations(salad, how.get("longest", 3), top=how.get("top", 2000)) and got


@pytest.fixture(scope="module")
def planted():
    """All pairs of forty words, each often enough, and phrases of words that seldom stand elsewhere."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    rows = [("en", " ".join(rng.choice(common) for _ in range(800))) for _ in range(50)]
    for lang, many in (("en", 60), ("de", 30)):
        for k in range(many):
            phrase = " ".join(f"{lang}{k}x{j}" for j in range(rng.choice((2, 3, 4, 5))))
            rows += [(lang, f"{rng.choice(common)} {phrase} {rng.choice(common)}. {phrase.split()[0]} {rng.choice(common)}")] * rng.randrange(10, 40)
    return rows + [(None, "so few of them")] * 11


@pytest.mark.parametrize("how", [{}, {"longest": 4}, {"longest": 2}, {"known": 20}, {"bits": 15}])
def test_phrases_far_below_the_first_ones_are_no_candidates(spark, planted, how, monkeypatch):
    seen, plain = [], collocations.frequent_phrases
    monkeypatch.setattr(collocations, "frequent_phrases", lambda texts, found, how: seen.append(found.count()) or plain(texts, found, how))
    docs = spark.createDataFrame(planted, "lang string, text string")
    got = phrases(collocations.collocations(docs, collocations.Phrases(top=5, every=1, **how)))
    assert got == brute.collocations(planted, how.get("longest", 3), top=5) and len(got) > 10
    assert phrases(collocations.collocations(docs, collocations.Phrases(top=5, every=1 << 40, **how))) == got
    assert len(seen) == 2 and seen[1] > 1600 and ("known" in how or "bits" in how or seen[0] < 0.6 * seen[1]), seen


@pytest.mark.parametrize("floors", [{"en": 999_999, "de": 1}, {"en": 10**6, "de": 10**6, "und": 10**6}, {"en": 2, "und": 1}])
def test_floors_that_are_too_high_are_taken_back(spark, planted, floors, monkeypatch):
    monkeypatch.setattr(collocations, "guessed_floors", lambda part, words, how: floors)
    docs = spark.createDataFrame(planted, "lang string, text string")
    assert phrases(collocations.collocations(docs, collocations.Phrases(top=50))) == brute.collocations(planted, top=50)


def test_levels_of_buckets_never_fall_short(spark):
    n = [0, 9, 10, 19, 20, 163839, 163840, 65535, 65535 * 3]
    pieces = [[0, 9, 10, 10, 20, 60000, 60000, 65535, 65535], [0, 0, 0, 9, 0, 60000, 60000, 0, 65535], [0, 0, 0, 0, 0, 43839, 43840, 0, 65535]]
    rows = [(0, np.arange(9, dtype=np.uint16).tobytes(), np.array(x, np.uint16).tobytes()) for x in pieces]
    how = collocations.Phrases(bits=15)
    levels = collocations.leveled(spark.createDataFrame(rows, "cell int, places binary, counts binary"), how)
    assert collocations.level(levels, np.arange(10)).tolist() == [0, 0, 1, 1, 2, 14, 15, 15, 15, 0]
    may = collocations.most(levels, np.arange(9), how)
    assert all(m >= k for m, k in zip(may, n, strict=True) if k >= 10) and (may[:2] == 0).all()


def test_texts_are_cut_at_the_ends_of_pieces():
    texts = ["", "ab cd. ef gh", "x" * 50, "a, b", ""]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    for size in (1, 5, 20, 100):
        found = list(collocations.slices(data, ends, size))
        assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(h in ends or chr(data[h - 1]) in ".," for _, h in found)


def test_a_double_array_accepts_its_phrases_only():
    rng = random.Random(3)
    phrases = sorted({" ".join(f"w{rng.randrange(200)}" for _ in range(rng.choice((2, 3)))) for _ in range(3000)} | {f"w0 w{k}" for k in range(200)})
    langs = [rng.choice(("en", "de")) for _ in phrases]
    made, state = collocations.trie(langs, phrases)
    assert len(set(state.tolist())) == len(phrases)
    number = {w: k for k, w in enumerate(made["words"])}
    known = dict(zip(zip(langs, phrases, strict=True), state.tolist(), strict=True))
    for lang in ("en", "de"):
        for p in phrases + [f"w{rng.randrange(200)} w{rng.randrange(200)} w{rng.randrange(200)}" for _ in range(2000)]:
            s = made["langs"].index(lang)
            for w in p.split(" "):
                for symbol in divmod(number[w], made["radix"]):
                    _, to = collocations.advanced(made, np.array([s]), np.array([symbol])) if s >= 0 else (None, [])
                    s = int(to[0]) if len(to) else -1
            assert s == known.get((lang, p), s) and ((lang, p) not in known or s >= 0)
            assert (lang, p) in known or s not in known.values()


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), ("en", "one two")], "lang string, text string")).collect() == []


# ---- spelling variants


def forms(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").orderBy("word").collect()]


def test_variants_of_documents(spark, tables):
    got = forms(op12_spelling_variants(spark, tables))
    assert got == brute.spelling_variants(read(spark, tables, "documents", "doc_id", "text")) and any(r[1] for r in got)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(6, 13))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    found = []
    for s in stems:
        found += [s] * rng.choice((2, 30, 400))
        for _ in range(12):
            k, c = rng.randrange(len(s)), rng.choice("abcdeéÿ")
            found += [rng.choice((s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + c + s[k + 1 :]))] * rng.choice((1, 2, 3, 25))
    rng.shuffle(found)
    rows = [(k, " ".join(w.title() if rng.random() < 0.2 else w for w in found[k * 20 : k * 20 + 20])) for k in range(len(found) // 20 + 1)]
    long = "z" * 3000
    return rows + [(None, "nothing NOTHING nothing"), (-1, None), (-2, ""), (-3, long + " " + long), (-4, long + "z " + long + "z"), (7, rows[7][1]), (7, rows[7][1]), (-5, "x×y÷zÀÿabc9x×y÷zÀÿabc")]


@pytest.mark.parametrize("crowd, tile", [(2048, 1 << 19), (95, 1 << 19), (2048, 64)])
def test_variants_of_odd_texts(spark, misspelt, crowd, tile, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", tile)
    docs = spark.createDataFrame([(k, t, 1, "w") for k, t in misspelt], "doc_id long, text string, n long, word string")
    assert forms(spelling.variants(docs, spelling.Spelling(crowd=crowd))) == brute.spelling_variants(misspelt)


def test_crowded_groups_are_cut(spark):
    """Words that differ in their last seven letters only: one group at first."""
    rng = random.Random(8)
    words = sorted({"prefixes" + "".join(rng.choice("abc") for _ in range(7)) for _ in range(1500)})
    docs = [(k, " ".join(words[k::10] * 2)) for k in range(10)]
    got = forms(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), spelling.Spelling(crowd=100)))
    assert got == brute.spelling_variants(docs)
    rows = spelling.placed(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), spelling.Spelling(crowd=100))
    assert rows.groupBy("g").count().where("count > 100").count() == 0


def test_variants_of_nothing(spark):
    assert forms(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []


# ---- nearest neighbours


def nearest(vectors, k=20, every=20):
    """{(query, rank): (vec_id, score)} of (vec_id, vector) rows by all inner products."""
    out = {}
    for q, v in vectors:
        if q % every == 0:
            scores = sorted((-float(np.dot(np.asarray(v), np.asarray(x))), i) for i, x in vectors if i != q and len(x) == len(v))
            out |= {(q, r): (i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def recall(got, want):
    sets = {}
    for name, found in (("got", got), ("want", want)):
        for (q, _), (i, _) in found.items():
            sets.setdefault(q, {}).setdefault(name, set()).add(i)
    return np.mean([len(s.get("got", set()) & s["want"]) / len(s["want"]) for s in sets.values() if "want" in s])


def ranks(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"cell": 100, "leaf": 8}])
def test_neighbours_of_embeddings(spark, tables, how):
    df = op13_nearest_neighbours(spark, tables) if not how else neighbours.neighbours(spark.read.parquet(f"{tables}/embeddings.parquet"), neighbours.Stable(**how))
    got, vectors = ranks(df), read(spark, tables, "embeddings", "vec_id", "embedding")
    want = nearest([(i, np.asarray(v, np.float64)) for i, v in vectors])
    assert set(got) == set(want) and recall(got, want) >= 0.95
    of = dict(vectors)
    for (q, r), (i, s) in got.items():
        assert abs(s - float(np.dot(np.asarray(of[q], np.float64), np.asarray(of[i], np.float64)))) < 1e-12
        assert i != q and (r == 1 or (-got[q, r - 1][1], got[q, r - 1][0]) < (-s, i))


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for k in range(1, 900)]
    same = rng.normal(size=8).tolist()
    rows += [(1000 + k, same) for k in range(200)] + [(2000 + k, [1e200, float(k), 1.0]) for k in range(30)]
    odd = [(20_000, None), (20_020, [0.0] * 8), (20_040, [float("nan")] * 8), (20_060, [None] * 8), (20_080, [float("inf")] + [0.0] * 7), (None, same), (20_100, []), (20_120, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in [*rows, *odd, rows[0]]], "vec_id long, embedding array<double>, rank string, id long")
    got = ranks(neighbours.neighbours(df, neighbours.Stable(cell=100)))
    want = nearest(rows)
    assert recall(got, {k: v for k, v in want.items() if k[0] < 2000}) >= 0.95
    crowd = [got[1000, r][0] for r in range(1, 21)]
    best = [want[1000, r][0] for r in range(1, 21)]
    assert crowd == best  # ties go to the smallest numbers
    assert {q for q, _ in got} == {q for q, _ in want} and all(i < 20_000 for i, _ in got.values())
    assert {r for q, r in got if q == 2000} == set(range(1, 21))


def test_neighbours_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.neighbours(spark.createDataFrame([], schema)).collect() == []
    few = neighbours.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], schema)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert neighbours.neighbours(spark.createDataFrame([(0, [1.0, 0.0])], schema)).collect() == []
