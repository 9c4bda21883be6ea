"""Plans and kernels that have to carry large tables."""

from collections import Counter

import pytest

from barleycorn.operators import denoise
from barleycorn.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ODD = [
    ("a", "ACGTN", "IIIII", "ACGTA"), ("a", "ACG", "I#I#I", "ACGTA"), ("b", "TTTTTTT", "!!!!!!!", "ACGTA"), (None, "acgta", "IIIII", "ACGTA"), (None, "ACGéA", "IIIII", "ACGTA"),
    ("a", None, "IIIII", "ACGTA"), ("a", "ACGTA", None, "ACGTA"), ("b", "", "", ""), ("b", "ACGTA", "I", "ANGTA"),
]


@pytest.mark.parametrize("by_sample", (True, False))
@pytest.mark.parametrize("cells", (1, 4_000_000))
def test_tallies_of_odd_reads(spark, by_sample, cells):
    reads = spark.createDataFrame(ODD, "sample string, dna string, qc string, reference string")
    fixed, own = Counter(), Counter()
    for s, dna, qc, ref in ODD:
        for k in range(min(len(dna or ""), len(ref))):
            q = ord(qc[k]) - 33 if qc is not None and k < len(qc) else None
            if dna[k] in "ACGT" and qc is not None and ref[k] in "ACGT":
                own[(s if by_sample else 0, f"{ref[k]}2{dna[k]}", q)] += 1
        for k in range(min(len(dna or ""), len(qc or ""), 5)):
            if dna[k] in "ACGT":
                fixed[(s if by_sample else 0, f"{'ACGTA'[k]}2{dna[k]}", ord(qc[k]) - 33)] += 1
    for reference, expected in (("ACGTA", fixed), (reads["reference"], own)):
        found = denoise.transitions(reads, reference, by_sample, cells)
        assert found.columns == [*(["sample"] if by_sample else []), "mutation", "phred", "n"]
        assert {(r["sample"] if by_sample else 0, r["mutation"], r["phred"]): r["n"] for r in found.collect()} == expected


def test_mutation_excess_reads_its_table_once(spark, tables):
    whole = plan(registry.QUERIES["mutation_excess"](spark, tables))
    assert whole.count("Relation") == 1 and "Generate" not in whole and "RepartitionByExpression" not in whole


@pytest.mark.parametrize("name", ("error_cohorts", "error_intervals", "transition_matrix_wide", "loess_error_rates"))
def test_tallies_of_all_samples_are_not_dealt_by_sample(spark, tables, name):
    from barleycorn.plans import adapters as ad

    tallies = denoise.transitions(ad.reads(spark, tables), "ACGT" * 8, by_sample=False)
    assert "sample" not in tallies.columns
    assert "Generate" not in plan(tallies) and "RepartitionByExpression" not in plan(tallies) and "RepartitionByExpression" not in plan(registry.QUERIES[name](spark, tables))


TEMPLATE = "ACGTTGCA" + "N" * 9 + "CATGGACT"
READS = ["ACGTTGCAACGTACGTACATGGACT", "AGTCCATGTACGTACGTTGCAACGT", "acgttgcaACGTNCGTACATGGACT", "ACGTTGCAACGTACGACATGGACT", "ACGTTNCAACGTACGTACATGGACTTT", "", "é" * 9, "GGG", None]


def test_described_reads_equal_single_ones():
    from barleycorn.config import Scoring
    from barleycorn.functions import alignment as al

    reads = [r for r in READS if r is not None] * 2
    for scoring in (Scoring(), Scoring(mismatch=-1), Scoring(mismatch=-2, gap_open=1, gap_extend=2), Scoring(match=4000, mismatch=-3000, gap_open=5000, gap_extend=100)):
        found = al.described(reads, TEMPLATE, scoring)
        for k, (read, one) in enumerate(zip(reads, al.align(reads, TEMPLATE, scoring), strict=True)):
            hit = one["score"] > 0
            expected = (*(al.marked(read, TEMPLATE, one) if hit else ("", 0)), *(al.between_degenerate(read, TEMPLATE, one) if hit else (-1, -1)), al.repaired(read, TEMPLATE, one) if hit else read)
            assert tuple(found[c][k] for c in ("cigar", "nm", "bc_start", "bc_stop", "repaired")) == expected


def test_reads_are_aligned_where_they_are(spark):
    from barleycorn.config import Scoring
    from barleycorn.operators import align

    reads = spark.createDataFrame([(k, r) for k, r in enumerate(READS * 2)], "k int, dna string")
    found = align.align_reads(reads, TEMPLATE, Scoring(mismatch=-1))
    assert not {"Join", "Aggregate"} & set(plan(found).replace("(", " ").split())
    rows = {r.k: r for r in found.collect()}
    assert found.columns[:3] == ["dna", "k", "score"] and sorted(rows) == [k for k in range(18) if k % 9 != 8]
    assert all(rows[k][2:] == rows[k + 9][2:] for k in range(8)) and rows[0].score == 32 and rows[0].cigar == "8=9X8="


def test_both_strands_keep_like_reads(spark):
    from barleycorn.config import Scoring
    from barleycorn.operators import align

    reads = spark.createDataFrame([("s", r) for r in [READS[0], READS[0], READS[1], None]], "sample string, dna string")
    found = align.align_both_strands(reads, TEMPLATE, Scoring(mismatch=-1))
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    assert sorted((r.dna, r.reverse) for r in found.collect()) == [(READS[0], False), (READS[0], False), (READS[0], True)]


def test_outcomes_classify_once(spark, tables):
    assert plan(registry.QUERIES["read_outcomes"](spark, tables)).count("Relation") == 1


def held(spark):
    """Samples with barcodes of their own and in common, one barcode that all hold, odd rows."""
    rows = [(f"s{k}", "t", f"b{(k * 7 + i * i) % 40}", 30_000.0 if (k + i) % 3 else 10.0) for k in range(30) for i in range(9)]
    rows += [(f"s{k}", "t", "hot", 30_000.0) for k in range(30)] + [(None, "t", "hot", 30_000.0), ("s1", None, "b1", 30_000.0), ("s2", None, "b1", 30_000.0), ("s3", "t", None, 5.0), ("s4", "t", None, 5.0)]
    return spark.createDataFrame(rows, "sample string, target string, barcode string, cells double"), rows


@pytest.mark.parametrize("block", (5, 4_000_000))
def test_shared_barcodes_equal_all_pairs(spark, monkeypatch, block):
    from barleycorn.operators import overlaps, tumors

    monkeypatch.setattr(overlaps, "BLOCK", block)
    monkeypatch.setattr(overlaps, "_kind", lambda n: __import__("numpy").uint32 if block == 5 else __import__("numpy").uint16)
    df, rows = held(spark)
    keys = {}
    for s, t, b, _ in rows:
        if None not in (s, t, b):
            keys.setdefault(s, set()).add((t, b))
    expected = {(a, b): len(keys[a] & keys[b]) for a in keys for b in keys if a < b and keys[a] & keys[b]}
    assert {(r.a, r.b): r.shared for r in tumors.barcode_overlaps(df).collect()} == expected


def test_contaminated_pairs_equal_the_plain_count(spark, monkeypatch):
    from barleycorn.functions.special import poisson_cdf
    from barleycorn.operators import cohorts

    df, rows = held(spark)
    sized = {}
    for s, t, b, c in rows:
        sized[s, t, b] = sized.get((s, t, b), 0) + c
    names = sorted({s for s, _, _ in sized if s is not None})
    whole = {s: {(t, b) for x, t, b in sized if x == s} for s in [*names, None]}
    large = {s: {(t, b) for (x, t, b), c in sized.items() if x == s and c > 20_000 and t and b} for s in names}
    present = {k: sum(k in w for w in whole.values()) for w in whole.values() for k in w}
    n, mean, expected = len(names), sum(map(len, whole.values())) / len(whole), {}
    for a in names:
        for b in names:
            common = len(large[a] & whole[b])
            if a != b and common:
                e = sum(present[k] - 1 for k in large[a]) / (n - 1) * len(whole[b]) / mean
                expected[a, b] = (common, round(e, 9), round(min(0.5, poisson_cdf(e, common) * n * (n - 1)), 9))
    found = {(r.a, r.b): (r.observed, round(r.expected, 9), round(r.fwer, 9)) for r in cohorts.contaminated_pairs(df, 1000.0, alpha=0.9).collect()}
    assert found == expected
    assert cohorts.fewest_shared(60_000, 0.01) == 26 and cohorts.fewest_shared(30, 0.9) == 1
    assert all(poisson_cdf(k / 2, m) * 30 * 29 >= 0.01 for m in range(cohorts.fewest_shared(30, 0.01)) for k in range(60))


def test_ratios_of_given_pairs_make_no_others(spark):
    from barleycorn.operators import cohorts

    df, _ = held(spark)
    tumors = df.where("sample is not null and barcode is not null")
    asked = spark.createDataFrame([("s1", "s2"), ("s1", "s2"), ("s5", "s5")], "a string, b string")
    found = cohorts.size_ratios(tumors, asked)
    every = cohorts.size_ratios(tumors).where("a = 's1' and b = 's2'")
    assert sorted(found.collect()) == sorted(every.collect()) and found.collect()
    assert "(a#" not in "".join(line for line in plan(found).splitlines() if "NOT" in line)


@pytest.mark.parametrize("cells", (90, 4_000_000))
def test_sums_of_many_groups_equal_those_of_few(spark, cells):
    from barleycorn.operators import resample

    df, _ = held(spark)
    named = df.where("sample is not null and target is not null")
    few, many = (resample.weighted_sums(named, ["sample", "target"], 30, 3, cells=cells, many=m).collect() for m in (False, True))
    told = lambda rows: {(r["sample"], r["target"], r["rep"]): (r["w"], round(r["s"], 6), round(r["q"], 6)) for r in rows}
    assert told(few) == told(many) and len(many) == len(told(many)) > 800
    assert {r["sample"] for r in resample.weighted_sums(df, ["sample", "target"], 30, 3, cells=cells, many=True).collect()} == {None, *(f"s{k}" for k in range(30))}
