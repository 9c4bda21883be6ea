import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleycorn.config import Annotate, Classify, Scoring, Template
from barleycorn.functions import alignment as al
from barleycorn.functions import special
from barleycorn.operators import align, annotate, cohorts, denoise, design, fits, pairs, quantify, resample, tumors
from barleycorn.operators import reads as rd
from barleycorn.sources import fastq, tables


def plain_score(read, ref, s):
    """The best local score, cell by cell."""
    m = al.matrix(s)
    a, b = al.encode(read), al.encode(ref)
    h = np.zeros((len(b) + 1, len(a) + 1), int)
    e, f = np.full_like(h, -(10**6)), np.full_like(h, -(10**6))
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            e[i, j] = max(h[i - 1, j] - s.gap_open, e[i - 1, j] - s.gap_extend)
            f[i, j] = max(h[i, j - 1] - s.gap_open, f[i, j - 1] - s.gap_extend)
            h[i, j] = max(0, h[i - 1, j - 1] + m[b[i - 1], a[j - 1]], e[i, j], f[i, j])
    return h


def cigar_score(read, ref, found, s):
    i, j, total = found["ref_begin"], found["read_begin"], 0
    m = al.matrix(s)
    for op, n in al.parse_cigar(found["cigar"]):
        if op == "M":
            total += sum(int(m[al.encode(ref[i + d])[0], al.encode(read[j + d])[0]]) for d in range(n))
        else:
            total -= s.gap_open + (n - 1) * s.gap_extend
        i += 0 if op == "I" else n
        j += 0 if op == "D" else n
    assert (i - 1, j - 1) == (found["ref_end"], found["read_end"])
    return total


@pytest.mark.parametrize("scoring", [Scoring(mismatch=-2), Scoring(mismatch=-1), Scoring()])
def test_alignment_against_cells(scoring):
    rng = random.Random(1)
    for _ in range(40):
        ref = "".join(rng.choices("ACGTN", weights=[4, 4, 4, 4, 1], k=rng.randrange(5, 40)))
        reads = ["".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=rng.randrange(1, 40))) for _ in range(4)]
        for read, found in zip(reads, al.align(reads, ref, scoring), strict=True):
            h = plain_score(read, ref, scoring)
            assert found["score"] == h.max()
            if found["score"]:
                ends = [(i, j) for i in range(h.shape[0]) for j in range(h.shape[1]) if h[i, j] == h.max()]
                assert (found["ref_end"] + 1, found["read_end"] + 1) == min(ends)
                assert cigar_score(read, ref, found, scoring) == found["score"]


def test_known_alignment():
    found = al.align(["CTTG"], "CATTG", Scoring(mismatch=-2))[0]
    assert found["score"] == 6
    long = al.align(["CTGAGCCGGTAAATC"], "CAGCCTTTCTGACCCGGAAATCAAAATAGGCACAACAAA", Scoring(mismatch=-2))[0]
    assert long["score"] == plain_score("CTGAGCCGGTAAATC", "CAGCCTTTCTGACCCGGAAATCAAAATAGGCACAACAAA", Scoring(mismatch=-2)).max()
    cigar, nm = al.marked("CTGAGCCGGTAAATC", "CAGCCTTTCTGACCCGGAAATCAAAATAGGCACAACAAA", long)
    assert sum(n for op, n in al.parse_cigar(cigar) if op in "=XIS") == 15 and nm >= 1


TEMPLATE = Template("ACGTTGCA" + "N" * 8 + "CATGGACT", flank=8)
BAR = "GATTACAG"
CASES = {
    "clean": ("ACGTTGCA" + BAR + "CATGGACT", "N", "Clustered"),
    "failed": ("ACGTTGCA" + BAR + "CATGGACT", "Y", "Filtered"),
    "noise": ("TTTTTTTTTTTTTTTTTTTT", "N", "Unaligned"),
    "short": ("ACGTTGCA" + BAR[:3] + "CATGGACT", "N", "Wrong Barcode Length"),
    "four off": ("ACGTTGCA" + BAR[:4] + "CATGGACT", "N", "Clustered"),
    "flank N": ("ACGTNGCA" + BAR + "CATGGACT", "N", "Clustered"),
    "barcode N": ("ACGTTGCA" + "GATNACAG" + "CATGGACT", "N", "Residual N"),
    "no flank": ("TTGCA" + BAR + "CATGGACT", "N", "Insufficient Flank"),
}


def test_outcomes(spark):
    reads = spark.createDataFrame([(k, f"@M:1 1:{flag}:0", dna, "I" * len(dna)) for k, (dna, flag, _) in CASES.items()], "name string, header string, dna string, qc string")
    rows = {r.name: r for r in align.classified(reads, TEMPLATE, Classify(training_flank=6, cluster_flank=6), Scoring(mismatch=-1)).collect()}
    assert {k: rows[k].outcome for k in CASES} == {k: c[2] for k, c in CASES.items()}
    assert rows["clean"].training == "GTTGCACATGGA" and rows["clean"].cluster == "GTTGCA" + BAR + "CATGGA"
    assert rows["flank N"].training is None and rows["flank N"].cluster == "GTTGCA" + BAR + "CATGGA"
    assert rows["barcode N"].training == "GTTGCACATGGA"


def test_template():
    assert TEMPLATE.barcode_length == 8 and TEMPLATE.best_score(Scoring()) == 32
    long = Template("A" * 49 + "N" * 29 + "C" * 101, 22)
    assert long.trim() == (0, 127) and long.trim("none") == (0, 179) and long.trim("3,9") == (3, 9)
    with pytest.raises(ValueError):
        Template("ACGT")


def test_both_strands(spark):
    dna = "ACGTTGCAGGATTACA"
    reads = spark.createDataFrame([(1, dna), (2, dna[::-1].translate(str.maketrans("ACGT", "TGCA")))], "read_id long, dna string")
    rows = {r.read_id: r for r in align.align_both_strands(reads, dna, Scoring(mismatch=-2)).collect()}
    assert rows[1].score == rows[2].score == 32 and (rows[1].reverse, rows[2].reverse) == (False, True)


def test_special_functions():
    assert special.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert special.poisson_cdf(3, 2.5) == pytest.approx(sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4)))
    assert special.chi2_survival(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert special.poisson_interval(10) == pytest.approx((4.795389, 18.390356), abs=1e-5)
    assert special.poisson_interval(0)[0] == 0


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2"])
def test_fastq_round_trip(spark, tmp_path, suffix):
    import bz2
    import gzip

    records = [(f"@M7:1:FC:{k} 1:{'NY'[k % 2]}:0:ACG", "ACGTN"[: 1 + k % 5] * 3, "@IIII"[: 1 + k % 5] * 3) for k in range(500)]
    text = "".join(f"{h}\n{d}\n+\n{q}\n" for h, d, q in records)
    path = tmp_path / f"mouse1.fastq{suffix}"
    {"": open, ".gz": gzip.open, ".bz2": bz2.open}[suffix](path, "wt").write(text)
    got = fastq.read_fastq(spark, str(path))
    assert sorted((r.header, r.dna, r.qc) for r in got.collect()) == sorted(records)
    assert {r.sample for r in got.collect()} == {"mouse1"}
    fastq.write_fastq(got, str(tmp_path / "out"), ["sample"])
    again = fastq.read_fastq(spark, str(tmp_path / "out" / "*" / "*.gz"))
    assert sorted((r.header, r.dna, r.qc) for r in again.collect()) == sorted(records)


def test_broken_fastq_is_an_error(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@M7:1\nACGT\n+\nIIII\n@M7:2\nACGT\n+\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path / "x.fastq")).collect()


def test_sequence_source(spark, tmp_path):
    import lzma

    with lzma.open(tmp_path / "a.fa.xz", "wt") as f:
        f.write(">one first of all\nACG\nTTT\n@two\nAC\nGT\n+two\nII\nII\n>three\n")
    spark.dataSource.register(fastq.SequenceSource)
    rows = spark.read.format("sequences").option("path", str(tmp_path / "*.xz")).load().collect()
    assert [tuple(r) for r in rows] == [("one", "first of all", "ACGTTT", None), ("two", None, "ACGT", "IIII"), ("three", None, "", None)]
    with pytest.raises(ValueError):
        list(fastq.records(iter(["@x\n", "ACGT\n", "+\n", "II\n"])))
    (tmp_path / "b.fa").write_text(">one c d\nAC GT\nTT\n>two\nGG\n")
    assert [tuple(r) for r in fastq.read_fasta(spark, str(tmp_path / "b.fa")).collect()] == [("one", "c d", "ACGTTT"), ("two", None, "GG")]


def test_tables(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("sequence,abundance,n0,n1,nunq,pval,birth_pval,birth_ham,more\nACGT,10,5,2,3,0.5,0.1,4,x\n")
    assert tuple(tables.read_clusters(spark, str(tmp_path / "s1.csv")).first()) == ("s1", "ACGT", 10, 5, 2, 3, 0.5, 0.1, 4)
    (tmp_path / "g.csv").write_text("Sequence,ID,target\nAAA,acgt,Neo1\nCCC,,X\n")
    assert {(r.id, r.target) for r in tables.read_sgrnas(spark, str(tmp_path / "g.csv")).collect()} == {("ACGT", "Neo1"), ("", "X")}
    (tmp_path / "bad.csv").write_text("Sequence,ID,target\nAAA,acgt,Neo1\nCCC,acg,X\n")
    with pytest.raises(ValueError):
        tables.read_sgrnas(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "i.tsv").write_text("s1\tACGT\ns2\tTTGA\n")
    assert {tuple(r) for r in tables.read_indexes(spark, str(tmp_path / "i.tsv")).collect()} == {("s1", "ACGT"), ("s2", "TTGA")}
    (tmp_path / "sp.csv").write_text("sample,input_file,forward_spacer_length,reverse_spacer_length\nm1,a.fastq,2,3\n")
    assert [tuple(r) for r in tables.read_spacers(spark, str(tmp_path / "sp.csv")).collect()] == [("a.fastq", 2, 3, "m1")]
    letters, scores = tables.read_matrix(["# c", "A C", "A 3 -1", "C -1 3"])
    assert letters == ["A", "C"] and scores == [[3, -1], [-1, 3]]
    (tmp_path / "t.csv").write_text("a,b,30,31\nA,C,2,\nA,A,7,1\n")
    assert {tuple(r) for r in tables.read_tallies(spark, str(tmp_path / "t.csv")).collect()} == {("t", "A2C", 30, 2), ("t", "A2C", 31, 0), ("t", "A2A", 30, 7), ("t", "A2A", 31, 1)}


def test_denoising_finds_planted_clusters(spark):
    rng = random.Random(6)
    centres = ["".join(rng.choices("ACGT", k=20)) for _ in range(12)]
    rows = {}
    for n, c in enumerate(centres):
        for _ in range(400 + 50 * n):
            read = "".join(rng.choice("ACGT".replace(b, "")) if rng.random() < 0.003 else b for b in c)
            rows[read] = rows.get(read, 0) + 1
    derep = spark.createDataFrame([("s", k, v) for k, v in rows.items()], "sample string, sequence string, abundance long")
    found = denoise.clustered(derep, 20).where("abundance > 5").collect()
    assert {r.sequence for r in found} == set(centres)
    assert sum(r.abundance for r in found) >= 0.98 * sum(rows.values())


def test_pairs_are_merged(spark):
    rng = random.Random(3)
    whole = "".join(rng.choices("ACGT", k=100))
    mate = whole[30:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    a = spark.createDataFrame([("x", whole[:70], "I" * 70), ("y", "A" * 70, "I" * 70)], "name string, dna string, qc string")
    b = spark.createDataFrame([("x", mate, "I" * 70), ("y", "A" * 70, "I" * 70)], "name string, dna string, qc string")
    rows = {r.name: r for r in pairs.merged_pairs(a, b).collect()}
    assert rows["x"].dna == whole and rows["x"].outcome == "assembled" and rows["y"].outcome == "not assembled"


def test_designed_ids(spark):
    ids = [r.id for r in design.usable(design.all_kmers(spark, 4), 4, ("GATC",)).collect()]
    assert "GATC" not in ids and all(sum(c in "GC" for c in i) == 2 for i in ids)
    taken = design.far_apart(ids, 3)
    assert all(sum(x != y for x, y in zip(a, b, strict=True)) >= 3 for a in taken for b in taken if a < b) and len(taken) > 3
    assert design.all_kmers(spark, 3).distinct().count() == 64


def library(spark):
    rng = np.random.default_rng(4)
    rows = [(f"m{m}", t, f"b{k}", float(np.exp(rng.normal(8 + (t == "Big") * 0.7, 1)))) for m in range(8) for t in ("Neo1", "Neo2", "Neo3", "Big") for k in range(60)]
    return spark.createDataFrame(rows, "sample string, target string, barcode string, cells double")


def test_bootstrap_agrees_with_theory(spark):
    t = library(spark)
    boot = resample.bootstrap_ln_means(t, 400)
    ci = {r.target: r for r in resample.intervals(boot, tumors.ln_means(t)).collect()}
    logs = np.log([r.cells for r in t.where("target = 'Big'").collect()])
    error = math.sqrt(logs.var() / len(logs) + logs.var() ** 2 / 2 / len(logs))
    assert math.log(ci["Big"].high / ci["Big"].low) == pytest.approx(2 * 1.96 * error, rel=0.25)
    again = resample.bootstrap_ln_means(t.repartition(7), 400)
    assert {(r.target, r.rep, round(r.ln_mean, 6)) for r in boot.collect()} == {(r.target, r.rep, round(r.ln_mean, 6)) for r in again.collect()}


def test_p_values_and_power(spark):
    t, inerts = library(spark), ("Neo1", "Neo2", "Neo3")
    p = {r.target: r.corrected for r in resample.inert_p_values(t, inerts, 300).collect()}
    assert p["Big"] < 0.05 < p["Neo1"]
    power = {r.mice: r.sensitivity for r in resample.power(t, [2, 8], 8, inerts, trials=150).collect()}
    assert power[8] > 0.8 and power[8] >= power[2]
    assert resample.replicates_for(0.01) == 9071
    low, high = resample.bca_levels(0.5, 0.0)
    assert (low, high) == pytest.approx((0.025, 0.975), abs=1e-6)


def test_planted_contamination_and_outlier(spark):
    rng = np.random.default_rng(5)
    rows = [(f"m{m}", "T", f"b{rng.integers(10**6)}", float(np.exp(rng.normal(9, 1)))) for m in range(6) for _ in range(150)]
    rows += [("m1", "T", b, 0.03 * c) for m, _, b, c in rows if m == "m0" and c > 4000]
    df = spark.createDataFrame(rows, "sample string, target string, barcode string, cells double")
    found = {(r.a, r.b) for r in cohorts.contaminated_pairs(df, 200.0).collect()}
    assert found == {("m0", "m1")}
    ratios = cohorts.size_ratios(df, spark.createDataFrame([("m0", "m1")], "a string, b string"))
    mix = cohorts.ratio_mixtures(ratios, least=0.02).first()  # a contamination of 3 %
    assert mix.mean == pytest.approx(math.sqrt(1 / 0.03), rel=0.05)
    assert not resample.outlier_mice(library(spark), 200).where("outlier").collect()
    # the outlier moves the cohort's mean as well, so others may follow it, but none is as far
    shifted = library(spark).withColumn("cells", F.col("cells") * F.when(F.col("sample") == "m3", 4.0).otherwise(1.0))
    found = resample.outlier_mice(shifted, 200).orderBy("p").first()
    assert found.sample == "m3" and found.outlier


def test_diversity_recovers_the_library(spark):
    rng = np.random.default_rng(7)
    rows = [(f"m{m}", "T", f"b{k}", 1.0) for m in range(10) for k in np.flatnonzero(rng.random(2000) < 0.08)]
    r = cohorts.diversity(spark.createDataFrame(rows, "sample string, target string, barcode string, cells double")).first()
    assert r.observed + r.unobserved == pytest.approx(2000, rel=0.05) and 0 < r.collision < 0.1
    names, weights, shares = cohorts.target_components(library(spark).withColumn("value", F.ln("cells")))
    assert len(names) == len(weights) == 4 and shares.sum() == pytest.approx(1)


def test_fits(spark):
    rng = np.random.default_rng(8)
    rows = [("ln", float(x)) for x in rng.lognormal(8, 1, 4000)] + [("pl", float(x)) for x in 1000 * (1 - rng.random(4000)) ** (-1 / 1.5)]
    df = spark.createDataFrame(rows, "target string, cells double")
    fit = {r.target: r for r in fits.power_law_fits(df).collect()}
    assert fit["pl"].best_fit == "LN+PL" and fit["pl"].alpha == pytest.approx(2.5, rel=0.1)
    assert {r.target: r.family for r in fits.best_families(df).collect()} == {"ln": "lognormal", "pl": "pareto"}


def test_gc_fit_finds_the_slope(spark):
    x = np.arange(10.0)
    coefficients, r2 = quantify.fit_polynomial(x, 1 + 0.5 * x - 0.1 * x**2, np.ones(10), 2)
    assert coefficients == pytest.approx([1, 0.5, -0.1]) and r2 == pytest.approx(1)
    assert quantify.Quantify().order == 4


def test_template_repair(spark):
    from barleycorn.operators.reads import repaired_by_template

    cases = {"ACGTTNCAGG": "ACGTTGCAGG", "TTTTTNTTTT": "TTTTTNTTTT", "NCGT": "NCGT", "ACGTTNNAGG": "ACGTTGCAGG", "ANNNNAAAA": "ANNNNAAAA", "ACGT": "ACGT"}
    df = spark.createDataFrame([(k, k) for k in cases], "name string, dna string")
    assert {r.name: r.dna for r in repaired_by_template(df, "ACGTTGCAGGCTA").collect()} == cases


def test_reads_on_a_stream(spark, tmp_path):
    from barleycorn.streaming.reads import running_tallies, written_stream

    rows = [(f"s{k % 3}", k, f"@M:1 1:{'Y' if k % 4 == 0 else 'N'}:0", "ACGTN"[: 1 + k % 5], "IIIII"[: 1 + k % 5]) for k in range(200)]
    spark.createDataFrame(rows, "sample string, read_id long, header string, dna string, qc string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample string, read_id long, header string, dna string, qc string").parquet(str(tmp_path / "in"))
    written_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {k for _, k, h, d, _ in rows if ":Y:" not in h and "N" not in d}
    assert {r.read_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    query = running_tallies(stream).writeStream.outputMode("complete").format("memory").queryName("tallied").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.sample: r.n for r in spark.table("tallied").collect()} == {f"s{i}": sum(k % 3 == i for k in range(200)) for i in range(3)}


@pytest.mark.parametrize("share", [0.0, 0.01, 0.2, 0.4999])
def test_trimmed_means_are_those_of_sorted_groups(spark, share):
    r = np.random.default_rng(1)
    group = np.repeat(np.arange(5), [30_000, 5_000, 37, 2, 1])
    value = r.normal(size=len(group))
    value[group == 1] = np.round(value[group == 1], 1)
    value[:9_000] = 0.25  # a third of a group at one value
    df = spark.createDataFrame([*zip(group.tolist(), value.tolist()), (7, None), (0, None)], "g int, v double")
    found = {x.g: (x.trimmed, x.n) for x in quantify.trimmed_means(df, "g", "v", share).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    for k, (mean, n) in found.items():
        s = np.sort(value[group == k])
        cut = int(share * len(s))
        assert n == len(s) and abs(mean - s[cut : len(s) - cut].mean()) < 1e-9


def test_guides_without_a_limit(spark):
    clusters = spark.createDataFrame([("s", "ACGT" * 8)], "sample string, sequence string")
    many = spark.range(12_000).select(F.concat(F.lit("ACG"), F.lpad(F.translate(F.conv(F.col("id").cast("string"), 10, 4), "0123", "ACGT"), 9, "A")).alias("id"), F.col("id").cast("string").alias("target"))
    (row,) = annotate.annotated(clusters, many.unionByName(spark.createDataFrame([("ACGTACGTACGT", "own"), ("", "none")], many.schema)), Annotate(flank=4, id_length=12)).collect()
    assert (row.target, row.found, row.barcode) == ("own", "exact", "ACGTACGTACGT")


def test_slices_and_curves(spark):
    rows = [(1, "ACGTACGTAC", "0123456789", 3), (2, "ACGTANGTAC", "0123456789", 3), (3, "ACGT", "0123", 3), (4, "ACGTACGTAC", "0123456789", 0), (5, "ACGTACGTAC", "0123456789", None)]
    reads = spark.createDataFrame(rows, "read_id int, dna string, qc string, start int")
    assert [(r.read_id, r.dna, r.qc) for r in rd.cluster_slices(reads, "start", length=3, flank=2).collect()] == [(1, "CGTACGT", "1234567")]
    sizes = [10.0, 100.0, 1000.0, 10000.0]
    df = spark.createDataFrame([("t", x) for x in sizes] + [("one", 5.0)], "target string, cells double")
    tails = tumors.power_tails(df, 50.0)
    (tail,) = tails.collect()
    assert tail.share == 0.75 and abs(tail.alpha - (1 + 3 / sum(math.log(x / 50) for x in sizes[1:]))) < 1e-12
    curves = {(r.target, r.k): r for r in tumors.density_curves(df, tails, 1, 3, 4).collect()}
    logs = [math.log(x) for x in sizes]
    m = sum(logs) / 4
    d = math.sqrt(sum((v - m) ** 2 for v in logs) / 4)
    want = math.exp(-(((math.log(100) - m) / d) ** 2) / 2) / (100 * d * math.sqrt(2 * math.pi))
    assert abs(curves["t", 1].log_normal - want) < 1e-12 and curves["t", 0].power_law is None
    assert abs(curves["t", 1].power_law - tail.alpha * 50 ** (tail.alpha - 1) * 100**-tail.alpha * 0.75) < 1e-12
    # one size has no spread, and no tail where none is over x_min
    assert curves["one", 1].log_normal is None and curves["one", 1].power_law is None
    assert tumors.without_samples(spark.createDataFrame([("a",), ("b",)], "sample string"), spark.createDataFrame([("b",), ("b",)], "sample string")).collect() == [("a",)]


def test_intervals_of_errors(spark):
    rows = [("a", "A2A", 30, 990), ("a", "A2C", 30, 4), ("b", "C2T", 30, 6), ("a", "G2G", 20, 50)]
    got = {r.phred: r for r in denoise.error_intervals(spark.createDataFrame(rows, "sample string, mutation string, phred int, n long")).collect()}
    assert (got[30].n, got[30].wrong, got[30].error) == (1000, 10, 0.01) and (got[20].wrong, got[20].low) == (0, 0.0)
    at_most = lambda k, mu: sum(math.exp(-mu) * mu**i / math.factorial(i) for i in range(k + 1))
    assert abs(1 - at_most(9, 1000 * got[30].low) - 0.025) < 1e-6 and abs(at_most(10, 1000 * got[30].high) - 0.025) < 1e-6
    assert abs(at_most(0, 50 * got[20].high) - 0.025) < 1e-6


def test_conditions_lengths_and_headers(spark):
    from barleycorn.operators import reads as rd
    from barleycorn.sources.tables import sam_header

    df = spark.createDataFrame([("a", 3, "Wrong Barcode Length"), ("b", 3, "Wrong Barcode Length"), ("c", 500, "Wrong Barcode Length"), ("d", 4, "Clustered"), (None, None, "Unaligned")], "name string, length int, outcome string")
    assert [r.name for r in rd.matching(df, "length > 3 and name <> 'c'").collect()] == ["d"]
    assert [(r.length, r.n) for r in rd.wrong_lengths(df, 5).orderBy("length").collect()] == [(0, 0), (1, 0), (2, 0), (3, 2), (4, 0), (5, 0)]
    targets = spark.createDataFrame([("z", "ACGT"), ("b", "AC")], "name string, sequence string")
    assert [r.value for r in sam_header(targets).collect()] == ["@HD\tVN:1.4\tSO:queryname", "@SQ\tSN:b\tLN:2", "@SQ\tSN:z\tLN:4"]
