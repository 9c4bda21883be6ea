"""Error models and division: planted rates and clusters, plain alignments, small P-values."""

import math
import random

import numpy as np
import pytest

from barleycorn.functions import special
from barleycorn.functions.sequence import find_with_substitutions, hamming
from barleycorn.operators import annotate, denoise, errormodel
from pyspark.sql import functions as F


def test_small_p_values():
    assert math.exp(special.log_abundance_p(1, 1e-17)) == 1
    above = math.fsum(math.exp(-1) / math.factorial(k) for k in range(30, 60)) / -math.expm1(-1)
    assert math.exp(special.log_abundance_p(30, 1)) == pytest.approx(above, rel=1e-12)
    mu, a = 1e-3, 1000
    assert special.log_abundance_p(a, mu) == pytest.approx(-mu + a * math.log(mu) - math.lgamma(a + 1) + math.log1p(mu / (a + 1)) - math.log(-math.expm1(-mu)), rel=1e-12)
    got = special.log_abundance_p(np.array([2, 5, 7, 3]), np.array([1e-9, 0.0, 1000.0, 3.5]))
    want = [math.log(1e-9 / 2), -math.inf, 0.0, math.log((1 - math.exp(-3.5) * (1 + 3.5 + 3.5**2 / 2)) / (1 - math.exp(-3.5)))]
    assert got.tolist() == pytest.approx(want, rel=1e-8)
    assert denoise.abundance_p(*map(__import__("pandas").Series, ([1.0, 30.0], [1e-17, 1.0]))).tolist() == pytest.approx([1, above])
    assert special.chi2_survival(400.0, 4) == pytest.approx(math.exp(-200) * 201, rel=1e-10)
    assert special.chi2_survival(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25, rel=1e-12)


def plain_score(a, b):
    rows = [[-8 * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        rows.append([-8 * i])
        for j, y in enumerate(b, 1):
            rows[i].append(max(rows[i - 1][j - 1] + (5 if x == y else -4), rows[i - 1][j] - 8, rows[i][j - 1] - 8))
    return rows[-1][-1]


@pytest.mark.parametrize("sizes", [(20, 20), (20, 22), (21, 19)])
def test_banded_alignments_score_best(sizes):
    rng = random.Random(6)
    one, two = [], []
    while len(one) < 150:
        a = [rng.choice("ACGT") for _ in range(sizes[0])]
        b = list(a)
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice("ACGT")
        while len(b) > sizes[1]:
            del b[rng.randrange(len(b))]
        while len(b) < sizes[1]:
            b.insert(rng.randrange(len(b) + 1), rng.choice("ACGT"))
        if rng.random() < 0.4:
            del b[rng.randrange(len(b))]
            b.insert(rng.randrange(len(b) + 1), rng.choice("ACGT"))
        one.append("".join(a))
        two.append("".join(b))
    under, edits = errormodel.aligned(errormodel.codes(one), errormodel.codes(two), 6)
    for a, b, u, e in zip(one, two, under, edits, strict=True):
        under_text = ["-" if c < 0 else "ACGT"[c] for c in u]
        same, differ, alone = (sum(f(x, y) for x, y in zip(a, under_text, strict=True)) for f in (lambda x, y: x == y, lambda x, y: y != "-" and x != y, lambda x, y: y == "-"))
        skipped = len(b) - same - differ
        assert 5 * same - 4 * differ - 8 * (alone + skipped) == plain_score(a, b)
        assert e == differ + alone + skipped
        rest = iter(b)
        assert all(c in rest for c in under_text if c != "-")


QUALS = [12, 16, 20, 25, 30, 35]


@pytest.fixture(scope="module")
def training(spark):
    """One sequence, read often; a place's quality is fixed, and its rate depends on both bases and the quality."""
    rng = np.random.default_rng(1)
    true = "".join(rng.choice(list("ACGT"), 48))
    quality = [QUALS[k % 6] for k in range(48)]
    rate = {(a, b, q): 10 ** (-q / 15) * (1 + "ACGT".index(a) / 3) * (1 + "ACGT".index(b) / 4) / 40 for a in "ACGT" for b in "ACGT" if a != b for q in QUALS}
    reads = np.empty((40_000, 48), "<U1")
    for k, (a, q) in enumerate(zip(true, quality, strict=True)):
        others = [b for b in "ACGT" if b != a]
        p = [rate[a, b, q] for b in others]
        reads[:, k] = rng.choice([a, *others], size=len(reads), p=[1 - sum(p), *p])
    texts, counts = np.unique(["".join(r) for r in reads], return_counts=True)
    df = spark.createDataFrame([("s", str(t), int(n), [float(q) for q in quality]) for t, n in zip(texts, counts, strict=True)], "sample string, sequence string, abundance long, mean_q array<double>")
    return df, rate, true


def test_training_recovers_planted_rates(spark, training, tmp_path):
    df, rate, _ = training
    model, rounds = errormodel.trained(df)
    rows = {(r.mutation, r.phred): r for r in model.collect()}
    assert rounds > 1 and len(rows) == 16 * 36
    for (a, b, q), r in rate.items():
        own = rows[f"{a}2{b}", q]
        if own.n > 150:  # what is left is chance and the smoothing over qualities
            assert own.rate == pytest.approx(r, rel=0.25)
    ratio = [rows[f"{a}2{b}", q].rate / r for (a, b, q), r in rate.items() if rows[f"{a}2{b}", q].n > 150]
    assert len(ratio) > 10 and 0.9 < float(np.exp(np.mean(np.log(ratio)))) < 1.1
    for base in "ACGT":
        assert all(sum(rows[f"{base}2{b}", q].rate for b in "ACGT") == pytest.approx(1) for q in range(36))
    errormodel.saved(model, str(tmp_path / "model"))
    back = errormodel.loaded(spark, str(tmp_path / "model"))
    assert errormodel.rates_of(back) == errormodel.rates_of(model)
    wide = model.groupBy("mutation").pivot("phred").agg(F.sum("n")).orderBy("mutation")
    wide.withColumnsRenamed({str(q): f"X{q}" for q in range(36)}).coalesce(1).write.option("header", True).csv(str(tmp_path / "transitions.csv"))
    again = errormodel.rates_of(errormodel.loaded(spark, str(tmp_path / "transitions.csv")))
    assert all(again[m] == pytest.approx(v, rel=1e-9) for m, v in errormodel.rates_of(model).items())


def plain_loess(x, y, w, at, span=0.75):
    k = max(1, int(len(x) * span + 1e-5))
    at = min(max(at, min(x)), max(x))
    d = np.abs(np.array(x) - at)
    h = np.sort(d)[k - 1]
    v = np.array(w) * (1 - np.minimum(d / h, 1) ** 3) ** 3
    powers = np.vander(np.array(x) - at, 3, increasing=True)
    return np.linalg.lstsq(powers * np.sqrt(v)[:, None], np.array(y) * np.sqrt(v), rcond=None)[0][0]


def test_loess_equals_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{a}2{b}", q, int(rng.integers(1_000_000, 5_000_000)) if a == b else int(rng.poisson(1e6 * 10 ** (-q / 10)))) for a in "ACGT" for b in "ACGT" for q in range(2, 41) if q % 9]
    model = {(r.mutation, r.phred): r.rate for r in errormodel.loess_rates(spark.createDataFrame(rows, "mutation string, phred int, n long")).collect()}
    n = {(m, q): k for m, q, k in rows}
    for m in ("A2C", "T2G"):
        x = [q for q in range(41) if (m, q) in n]
        total = [sum(n[f"{m[0]}2{b}", q] for b in "ACGT") for q in x]
        y = [math.log10((n[m, q] + 1) / t) for q, t in zip(x, total, strict=True)]
        for q in range(41):
            assert model[m, q] == pytest.approx(min(0.25, max(1e-7, 10 ** plain_loess(x, y, total, q))), rel=1e-6)
    assert errormodel.loess_rates(spark.createDataFrame([], "mutation string, phred int, n long")).collect() == []


@pytest.fixture(scope="module")
def planted(spark):
    """Barcodes, with substitutions and one-base insertions and deletions of their reads, and a rare barcode two substitutions from a common one."""
    rng = random.Random(9)
    centers = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(12)]
    near = list(centers[0])
    near[7], near[20] = ("A" if near[7] != "A" else "C"), ("G" if near[20] != "G" else "T")
    centers.append("".join(near))
    counts = {}
    for sample in ("s", "t"):
        for k, c in enumerate(centers):
            n = 3000 if k < 12 else 200
            own = counts.setdefault((sample, c), 0)
            counts[sample, c] = own + n
            for _ in range(60 if k < 12 else 4):
                i = rng.randrange(30)
                x = rng.choice((c[:i] + rng.choice("ACGT") + c[i + 1 :], c[:i] + c[i + 1 :], c[:i] + rng.choice("ACGT") + c[i:]))
                counts[sample, x] = counts.get((sample, x), 0) + 1
    rows = [(s, x, n, [30.0] * len(x)) for (s, x), n in counts.items()]
    return spark.createDataFrame(rows, "sample string, sequence string, abundance long, mean_q array<double>"), set(centers)


def flat_model(rate=0.001):
    return {m: [1 - 3 * rate if m[0] == m[2] else rate] * 41 for m in errormodel.MUTATIONS}


def test_planted_clusters_are_found(spark, planted):
    df, centers = planted
    rows = errormodel.clusters(df, flat_model()).collect()
    assert {(r.sample, r.sequence) for r in rows} == {(s, c) for s in "st" for c in centers}
    assert sum(r.abundance for r in rows) == df.agg(F.sum("abundance")).first()[0]
    rare = [r for r in rows if r.abundance < 300]
    assert all(r.birth_ham == 2 and 0 <= r.birth_pval < 1e-10 for r in rare) and len(rare) == 2
    assert all(r.n0 >= 200 and r.n0 + r.n1 <= r.abundance and r.nunq > 1 and r.pval > 1e-10 for r in rows)


def test_links_are_few_and_complete(spark, planted):
    df, centers = planted
    how = errormodel.Divide()
    likely = errormodel.likely_centers(df, errormodel.pieces(df, how), how).collect()
    assert {(r.sample, r.sequence) for r in likely} >= {(r.sample, r.sequence) for r in df.where("abundance > 500").collect()}
    given = df.where(F.col("sequence").isin(*centers)).select("sample", "sequence", "abundance")
    rows = errormodel.links(df, given, how).collect()
    found = {(r.sample, r.sequence, r.parent): r.edits for r in rows}
    reads = {(r.sample, r.sequence): r.abundance for r in df.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for (s, x), n in reads.items():
        for c in centers:
            if c != x and reads[s, c] >= 2 * n and distance(x, c) <= 2:
                assert found[s, x, c] == distance(x, c)
    assert len(found) < 3 * len(reads)


def test_division_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "sample string, sequence string, abundance long, mean_q array<double>")
    assert errormodel.clusters(empty, flat_model()).collect() == []
    one = spark.createDataFrame([("s", "ACGTACGT", 5, [30.0] * 8)], "sample string, sequence string, abundance long, mean_q array<double>")
    (row,) = errormodel.clusters(one, flat_model()).collect()
    assert (row.sequence, row.abundance, row.n0, row.n1, row.nunq, row.pval, row.birth_pval, row.birth_ham) == ("ACGTACGT", 5, 5, 0, 1, 1.0, 0.0, 0)


def test_motifs_by_expression_equal_those_place_by_place(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 30))),) for _ in range(300)] + [(None,)]
    df = spark.createDataFrame(rows, "dna string")
    for motif, most in (("ACGT", 1), ("ACGTAC", 2), ("GATTACA", 3)):
        got = df.select(find_with_substitutions(F.col("dna"), motif, most).alias("a"), find_with_substitutions(F.col("dna"), F.lit(motif), most).alias("b")).collect()
        assert all(r.a == r.b for r in got) and len({r.a for r in got}) > 3
    pairs = df.select(hamming(F.substring("dna", 1, 9), F.reverse(F.substring("dna", 1, 9)), 9).alias("a"), hamming(F.substring("dna", 1, 9), F.reverse(F.substring("dna", 1, 9))).alias("b"), F.length("dna").alias("n")).collect()
    assert all(r.a == r.b for r in pairs if (r.n or 0) >= 9) and all(r.a is None for r in pairs if (r.n or 0) < 9)


@pytest.mark.parametrize("substitutions", [0, 1, 2])
def test_guides_within_windows(spark, substitutions):
    rng = random.Random(substitutions)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    guides = {text(8): f"t{k}" for k in range(60)}
    windows = [text(11) for _ in range(80)] + [text(k) + g[:3] + "A" + g[4:] + text(3 - k) for g in list(guides)[:40] for k in (0, 2)]
    got = {(r.sequence, r.gid): r.place for r in annotate.guides_within(spark.createDataFrame([(w, w) for w in windows], "sequence string, w string"), spark.createDataFrame(list(guides.items()), "id string, target string"), 8, 4, substitutions).collect()}
    want = {}
    for w in windows:
        for g in guides:
            places = [p for p in range(4) if sum(x != y for x, y in zip(w[p : p + 8], g, strict=True)) <= substitutions]
            if places:
                want[w, g] = places[0]
    assert got == want
