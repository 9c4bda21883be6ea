"""Alignment by substitution matrices against plain cells."""

import random

import numpy as np
import pytest

from barleycorn.config import Scoring
from barleycorn.functions import alignment as al
from barleycorn.operators import align
from barleycorn.plans.registry import AMBIGUOUS, ambiguity_letters
from barleycorn.sources.tables import read_matrix

PROTEIN = "ARNDCQEGHILKMFPSTWYVBZX*"


def plain(read, ref, letters, gap_open, gap_extend):
    """The best cell of the affine local programme, cell by cell."""
    low = -(10**6)
    h, e, f = ([[v] * (len(read) + 1) for _ in range(len(ref) + 1)] for v in (0, low, low))
    best = 0
    for i in range(1, len(ref) + 1):
        for j in range(1, len(read) + 1):
            e[i][j] = max(h[i - 1][j] - gap_open, e[i - 1][j] - gap_extend)
            f[i][j] = max(h[i][j - 1] - gap_open, f[i][j - 1] - gap_extend)
            pair = int(letters.scores[letters.encode(ref[i - 1])[0], letters.encode(read[j - 1])[0]])
            h[i][j] = max(0, h[i - 1][j - 1] + pair, e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


@pytest.fixture(scope="module")
def proteins():
    rng = random.Random(5)
    scores = [[0] * 24 for _ in range(24)]
    for a in range(24):
        for b in range(a + 1):
            scores[a][b] = scores[b][a] = rng.randrange(4, 9) if a == b else rng.randrange(-5, 3)
    return al.Letters(list(PROTEIN), scores)


def test_scores_of_random_matrices(proteins):
    rng = random.Random(6)
    ref = "".join(rng.choice(PROTEIN[:20]) for _ in range(40))
    reads = [ref[3:30], ref[5:15] + ref[18:33], ref[2:14] + "WW" + ref[14:30], ref[::-1], "", "zzjj", ref.lower()] + ["".join(rng.choice(PROTEIN[:20]) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    found = al.align(reads, ref, Scoring(gap_open=7, gap_extend=2), letters=proteins)
    for read, hit in zip(reads, found, strict=True):
        assert hit["score"] == plain(read, ref, proteins, 7, 2)
        if hit["score"]:
            total, i, j = 0, hit["ref_begin"], hit["read_begin"]
            for op, n in al.parse_cigar(hit["cigar"]):
                if op == "M":
                    total += sum(int(proteins.scores[proteins.encode(ref[i + k])[0], proteins.encode(read[j + k])[0]]) for k in range(n))
                else:
                    total -= 7 + 2 * (n - 1)
                i, j = i + (op != "I") * n, j + (op != "D") * n
            assert (total, i - 1, j - 1) == (hit["score"], hit["ref_end"], hit["read_end"])
    same = [r for r in reads if len(r) == len(ref)]
    assert al.best_scores(np.stack([proteins.encode(r) for r in same]), ref, Scoring(gap_open=7, gap_extend=2), letters=proteins).tolist() == [plain(r, ref, proteins, 7, 2) for r in same]


def test_matrices_are_read_and_checked():
    letters, scores = read_matrix(["# comment", "  A C *", "A 5 -4 -1", "C -4 5 -1", "* -1 -1 1"])
    made = al.Letters(letters, scores)
    assert made.encode("acgT*").tolist() == [0, 1, 2, 2, 2] and made.scores[0, 1] == -4
    with pytest.raises(ValueError):
        al.Letters(["A", "C"], [[1, 0], [0, 1]])
    with pytest.raises(ValueError):
        al.Letters(["A", "*"], [[1, 0]])


def test_ambiguity_codes(spark):
    letters = ambiguity_letters()
    code = {c: int(letters.encode(c)[0]) for c in AMBIGUOUS}
    assert letters.scores[code["A"], code["A"]] == 4 and letters.scores[code["A"], code["R"]] == 0 and letters.scores[code["A"], code["Y"]] == -4
    df = spark.createDataFrame([("ACGTACGT",), ("ACGTGCGT",), ("ACGTCCGT",), (None,), ("",), ("ACGTACGT",)], "dna string")
    rows = {r.dna: r for r in align.align_by_matrix(df, "ACGTRCGT", letters, Scoring(gap_open=6, gap_extend=1)).collect()}
    assert {k: r.score for k, r in rows.items()} == {"ACGTACGT": 28, "ACGTGCGT": 28, "ACGTCCGT": 24} and rows["ACGTACGT"].cigar == "8M"
    hits = align.best_hits(df, spark.createDataFrame([("r", "ACGTRCGT"), ("y", "ACGTYCGT")], "name string, sequence string"), Scoring(gap_open=6, gap_extend=1), most_e=1e9, letters=letters).collect()
    assert {r.dna: r.target for r in hits} == {"ACGTACGT": "r", "ACGTGCGT": "r", "ACGTCCGT": "y"}
