import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from barleycorn.llm import mixing, quality, toxicity
from barleycorn.llm.queries import SQL, op6_mixing, op7_toxicity

from . import brute

TABLES = ("documents", "labels")


def in_duckdb(tables, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    rel = c.sql(sql)
    return sorted(rel.columns), sorted(map(tuple, rel.select(", ".join(f'"{k}"' for k in sorted(rel.columns))).fetchall()), key=repr)


def test_mixing_against_sql(spark, tables):
    got = op6_mixing(spark, tables)
    columns, want = in_duckdb(tables, SQL["op6_mixing"])
    assert sorted(got.columns) == columns
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want


def by_hand(leaves, how):
    """Budgets of (domain, lang, source): tokens, by repeated sharing."""

    def share(budget, children):  # name: (weight, capacity)
        got, open_ = dict.fromkeys(children, 0.0), set(children)
        while open_ and budget > 1e-9:
            total = sum(children[c][0] for c in open_)
            full = {c for c in open_ if children[c][1] - got[c] <= budget * children[c][0] / total}
            if not full:
                for c in open_:
                    got[c] += budget * children[c][0] / total
                return got
            for c in full:
                budget -= children[c][1] - got[c]
                got[c] = children[c][1]
            open_ -= full
        return got

    cap = {k: v * how.epochs for k, v in leaves.items()}
    domains, out = {k[0] for k in leaves}, {}
    top = share(sum(leaves.values()) * how.budget_percent // 100, {x: (how.domains.get(x, 1), sum(c for k, c in cap.items() if k[0] == x)) for x in domains})
    for x in domains:
        langs = {k[1] for k in leaves if k[0] == x}
        middle = share(top[x], {y: (how.languages.get(y, 1), sum(c for k, c in cap.items() if k[:2] == (x, y))) for y in langs})
        for y in langs:
            out |= {(x, y, z): b for z, b in share(middle[y], {k[2]: (how.sources.get(k[2], 1), c) for k, c in cap.items() if k[:2] == (x, y)}).items()}
    return out


def test_shortages_go_to_siblings_first(spark):
    leaves = {("d0", "en", "s0"): 10, ("d0", "en", "s4"): 1000, ("d0", "de", "s0"): 500, ("d1", "en", "s1"): 30, ("d1", "fr", "s5"): 20, ("d2", "en", "s2"): 5000}
    how = mixing.Targets(budget_percent=50, epochs=1)
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, how).collect()}
    want = by_hand(leaves, how)
    assert all(abs(got[k] - want[k]) <= 3 for k in leaves)


def test_mixing_takes_each_leafs_budget(spark):
    rows = [(k, "w " * (k % 7), ["en", "de", None][k % 3], f"s{k % 5}" if k % 11 else None, 1, "z") for k in range(400)] + [(None, "a b", "en", "s1", 1, ""), (7, None, "en", "s2", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int, n_tokens string")
    how = mixing.Targets(budget_percent=60)
    used = mixing.mixed(df, how).collect()
    leaves = {(r.domain, r.lang, r.source): r.tokens for r in mixing.counted(df, how).groupBy("domain", "lang", "source").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "tokens").collect()}
    want = by_hand(leaves, how)
    for leaf, budget in want.items():
        took = sum(r.take_tokens for r in used if (r.domain, r.lang, r.source) == leaf)
        assert abs(took - budget) <= 3
    assert mixing.mixed(df.limit(0), how).count() == 0
    one = mixing.Targets(budget_percent=60, epochs=1)
    ids = {r.doc_id for r in mixing.mixed(df, one).collect()}
    kept = mixing.selected(df, one)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == ids


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    rates = np.array([[0.02, 0.6], [0.05, 0.4], [0.1, 0.3], [0.01, 0.5]])
    votes = np.stack([rng.random(4000) < np.where(y, b, a) for a, b in rates], 1).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a voter that repeats another
    post, found, weights, correlation = toxicity.fitted_votes(votes, 0.2 + 0.6 * (votes.sum(1) > 1), 100)
    assert ((post > 0.5) == y).mean() > 0.9
    assert np.abs(found[1][:4] - rates[:, 1]).max() < 0.12
    assert correlation[0, 4] > 0.9 and weights[4] < 0.7 < weights[2]


def test_toxicity_is_told_from_held_out_texts(spark):
    rng = random.Random(2)
    mild, bad = [f"mild{k}" for k in range(500)], ["awfulest", "horridly", "vilely", "nastier", "meanest"]
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 6 == 0
        words = rng.choices(mild, k=rng.randrange(5, 80)) + (rng.choices(bad, k=2) if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words).title() if k % 2 else " ".join(words), 0.5, "x"))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None, 0.0, ""), (5001, "", 0.0, "")], "doc_id long, text string, score double, terms string")
    known = spark.createDataFrame(labels + [(9, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, known.where(~toxicity.held_out("doc_id")))
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all(out[k].held_out == brute.held_out(k) and 0 <= out[k].score <= 1 and out[k].predicted == (out[k].score >= 0.5) for k in out)
    held = [(k, t) for k, _, t in labels if brute.held_out(k)]
    assert sum(out[k].predicted == t for k, t in held) >= 0.98 * len(held)
    assert out[5000].predicted == out[5001].predicted == 0
    assert toxicity.scored(docs.limit(0), toxicity.learned(docs.limit(0), known)).count() == 0


def test_toxicity_of_documents(spark, tables):
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = op7_toxicity(spark, tables).collect()
    assert len(rows) == spark.read.parquet(f"{tables}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.85 * len(held)


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], tables).persist())
    return out


def test_stages_keep_columns_and_decide(stages):
    docs, *steps = stages
    assert all(s.columns == docs.columns for s in steps[:-1])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in stages[:-1]]
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert set(texts[1]) == kept
    late = brute.later_lines(texts[1])
    for k, t in texts[1].items():
        left = [x for no, x in enumerate(t.split("\n")) if (k, no) not in late]
        if any(brute.words(x) for x in left) or len(left) == len(t.split("\n")):
            assert texts[2][k] == "\n".join(left)
        else:
            assert k not in texts[2]
    assert set(texts[3]) == {k for k, (_, c) in brute.near_duplicates(texts[2]).items() if k == c}
    assert set(texts[4]) < set(texts[3]) and all(texts[4][k] == texts[3][k] for k in texts[4])
    assert {r.doc_id for r in steps[-1].collect()} == set(texts[4])


def test_run_is_the_last_stage(spark, tables, stages):
    assert {tuple(r) for r in corpus_pipeline.run(spark, tables).collect()} == {tuple(r) for r in stages[-1].collect()}


def test_terms_are_counted_in_all_labelled_documents(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(["tree", "house", "river", "stone"], k=6)) + (" vile" if k % 10 == 0 else ""), int(k % 10 == 0)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole = toxicity.learned(df, df.select("doc_id", "toxic"))
    part = toxicity.learned(df, df.select("doc_id", "toxic"), toxicity.Supervision(most_rows=200))
    assert dict(part.terms) == dict(whole.terms) and "vile" in dict(part.terms)


def test_toxicity_on_held_out_labels(spark):
    tables = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{tables}/labels.parquet").where("quality = 1")
    held = op7_toxicity(spark, tables).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = sum(r.toxic == r.predicted == 1 for r in held)
    assert caught >= 0.95 * sum(r.toxic for r in held) > 50 and caught >= 0.95 * sum(r.predicted for r in held)


def test_a_cut_parts_labels_best():
    z, label = np.array([-3.0, -1.0, 0.2, 0.3, 2.0]), np.array([0, 0, 0, 1, 1.0])
    assert 0.2 < toxicity.cut(z, label) < 0.3
    assert toxicity.cut(np.array([-1.0, 1.0]), np.array([0, 1.0])) == 0.0
    assert np.isfinite(toxicity.cut(np.zeros(4), np.array([0, 1, 0, 1.0])))
