"""Queries and operators do the whole job: nothing is capped, cut or left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleycorn.config import Scoring
from barleycorn.functions import alignment as al
from barleycorn.operators import align, cohorts, denoise, resample
from barleycorn.operators import reads as rd
from barleycorn.plans import adapters as ad
from barleycorn.plans import registry


def test_every_overlapping_pair_gets_a_mixture(spark, tables):
    df = ad.tumors(spark, tables).groupBy("sample", "target", "barcode").agg(F.sum("cells").alias("cells"))
    t = df.collect()
    sizes = {}
    for r in t:
        sizes.setdefault(r.sample, {})[r.target, r.barcode] = r.cells
    expected = {(a, b) for a in sizes for b in sizes if a != b and any(k in sizes[b] and x / sizes[b][k] >= 0.75 for k, x in sizes[a].items())}
    got = [(r.a, r.b) for r in cohorts.ratio_mixtures(cohorts.size_ratios(df)).collect()]
    assert len(expected) > 20
    assert len(got) == len(set(got)) and set(got) == expected


def test_flagged_pairs_get_a_mixture(spark):
    """The query fits the pairs that share more large barcodes than chance brings: those planted."""
    got = {(r.a, r.b): r for r in registry.QUERIES["contamination_mixture"](spark, "/root/testdata/sf0.01").collect()}
    assert {(str(25 * k), str(25 * k + 1)) for k in range(1, 4)} <= set(got) and len(got) < 10
    assert all(got[str(25 * k), str(25 * k + 1)].contaminant for k in range(1, 4))
    assert all(abs(got[str(25 * k), str(25 * k + 1)].fraction - 1 / 11) < 0.01 for k in range(1, 4))


def test_mixtures_together_equal_mixtures_alone():
    rng = np.random.default_rng(2)
    for length in (1, 2, 5, 11):
        x = np.sort(np.array([rng.choice(300, length, replace=False) for _ in range(4)]), 1) / 64 + 0.8
        n = rng.integers(1, 3, x.shape).astype(float)
        padded = [np.pad(v, ((0, 0), (0, 2))) for v in (x, n)]
        found = cohorts.mixtures(*padded, parts=min(3, length))
        for i in range(4):
            alone = cohorts.mixture(x[i], n[i], parts=min(3, length))
            assert found[3][i] == pytest.approx(alone[3], rel=1e-6, abs=1e-6)
            assert np.sort(found[0][i]) == pytest.approx(np.sort(alone[0]), rel=1e-3)


def test_long_chains_keep_their_reads(spark):
    chain = ["C" * k + "A" * (40 - k) for k in range(41)]
    rows = [("s", c, 1) for c in chain] + [("s", "GATTACA" * 3, 5), ("t", "GATTACA" * 3, 2)]
    found = denoise.clustered(spark.createDataFrame(rows, "sample string, sequence string, abundance long"), error=0.01, fold=1.0).collect()
    assert {(r.sample, r.sequence): (r.abundance, r.nunq) for r in found} == {("s", "A" * 40): (41, 41), ("s", "GATTACA" * 3): (5, 1), ("t", "GATTACA" * 3): (2, 1)}


def test_denoising_by_quality(spark):
    whole, q = "ACGTTGCATTGACCGTAAGC", [40.0] * 20
    rows = [("s", whole, 1000, q), ("s", "C" + whole[1:], 20, [10.0] + q[1:]), ("s", whole[:-1] + "G", 20, q)]
    derep = spark.createDataFrame(rows, "sample string, sequence string, abundance long, mean_q array<double>")
    found = {r.sequence: r.abundance for r in denoise.clustered(derep, rates={10: 0.1, 40: 0.0001}).collect()}
    assert found == {whole: 1020, whole[:-1] + "G": 20}


def test_denoising_takes_whole_reads(spark, tables):
    found = registry.QUERIES["denoise_clusters"](spark, tables).agg(F.sum("abundance").alias("n"), F.min(F.length("sequence")).alias("least"), F.max("nunq").alias("most")).first()
    assert found.n == rd.without_degenerate(ad.reads(spark, tables)).count()
    assert found.least == 32 and found.most > 1


def test_scores_alone_equal_alignments():
    rng = random.Random(4)
    for scoring in (Scoring(mismatch=-2), Scoring(mismatch=-1), Scoring()):
        ref = "".join(rng.choices("ACGTN", weights=[4, 4, 4, 4, 1], k=rng.randrange(5, 30)))
        reads = ["".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=25)) for _ in range(30)]
        assert al.best_scores(np.stack([al.encode(r) for r in reads]), ref, scoring).tolist() == [f["score"] for f in al.align(reads, ref, scoring)]


def test_guides_at_the_end_of_a_read_are_found(spark):
    rng = random.Random(5)
    guides = [(f"g{k:02}", "".join(rng.choices("ACGT", k=12))) for k in range(24)]
    reads = {"".join(rng.choices("ACGT", k=20)) + s: t for t, s in guides}
    found = align.best_hits(spark.createDataFrame([(r,) for r in reads], "dna string"), spark.createDataFrame(guides, "name string, sequence string"), most_e=1e-3).collect()
    assert {r.dna: r.target for r in found} == reads and {r.score for r in found} == {24}


def test_guide_hits_takes_all_guides_and_whole_reads(spark, tables):
    found = registry.QUERIES["guide_hits"](spark, tables).collect()
    guides = [(r.target, r.id * 3) for r in ad.guides(spark, tables).collect()]
    assert len({r.target for r in found}) > 4 and {len(r.dna) for r in found} == {32}
    for r in random.Random(6).sample(sorted(found), 5):
        assert (r.score, r.target) == max((al.align([r.dna], s, Scoring(mismatch=-2))[0]["score"], t) for t, s in guides)


def cohort(spark, mice):
    """Tumours of a mouse are alike, so that what varies between trials is the mice drawn."""
    rng = np.random.default_rng(8)
    rows = [(f"m{m}", t, f"b{k}", float(np.exp(level + 0.01 * k))) for m, level in enumerate(rng.normal(8, 1, mice)) for t in ("Neo1", "Neo2", "Big") for k in range(5)]
    return spark.createDataFrame(rows, "sample string, target string, barcode string, cells double")


def test_a_cohort_has_as_many_mice_as_it_says(spark):
    t = cohort(spark, 200)
    means = resample.weighted_sums(t, ["target"], 400, 5, mouse="sample", scale=10 / 200).where("target = 'Big'").toPandas()
    assert (means.s / means.w).std() == pytest.approx(1 / 10**0.5, rel=0.35)
    blocks = resample.weighted_sums(t, ["target"], 400, 5, mouse="sample", scale=10 / 200, cells=300).where("target = 'Big'").toPandas()
    assert blocks.sort_values("rep").s.to_numpy() == pytest.approx(means.sort_values("rep").s.to_numpy())


def test_power_counts_mice_and_trials(spark):
    t = cohort(spark, 30)
    by = lambda df: sorted((r.mice, r.target, r.sensitivity) for r in df.collect())
    found = by(resample.power(t, [5], inerts=("Neo1", "Neo2")))
    assert found == by(resample.power(t, [5], 30, ("Neo1", "Neo2"), trials=9071))
    assert found != by(resample.power(t, [5], 100, ("Neo1", "Neo2"), trials=200))


def test_amplicons_have_barcodes_of_the_whole_digest(spark, tables):
    reads = registry._amplicons(spark, tables)
    assert reads.where("length(dna) <> length(qc)").isEmpty()
    # as many sequences as reads of their own, for 8 bases are too few to tell them apart
    assert reads.select("dna").distinct().count() >= 0.99 * ad.reads(spark, tables).select("dna").distinct().count()
    found = registry.QUERIES["classify_reads"](spark, tables).where("outcome = 'Clustered'").agg(F.count("*").alias("n"), F.max(F.length("cluster")).alias("longest")).first()
    assert found.n > 0 and found.longest >= 6 + 29 + 6


def test_planted_contamination_is_found(spark):
    rows = registry.QUERIES["contamination"](spark, "/root/testdata/sf0.01").collect()
    assert {(r.a, r.b) for r in rows} == {("0", "1"), ("25", "26"), ("50", "51"), ("75", "76")}
    assert all(r.observed > r.expected and r.fwer < 0.01 for r in rows)


def test_spikes_and_filters_decide(spark, tables):
    cells = registry.QUERIES["spike_scale_cells"](spark, tables).collect()
    assert sum(r.cells is not None for r in cells) > 0.99 * len(cells)
    final = registry.QUERIES["final_filter_fdr"](spark, tables).first()
    assert 0 < final.false_positives < final.passed and 0 < final.fdr < 1
