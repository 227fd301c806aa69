import random

import numpy as np
import pytest

from seqloom.functions.substitution import ALPHABET, parse_matrix, register_matrix, substitution_matrix
from seqloom.operators.align import identities, path, similarity_nw
from seqloom.operators.matrix import mirrored, similarity_stats, threshold_edges, upper_quantile
from pyspark.sql import functions as F

F5 = ["RRAVELQTVAFP", "PPPSYETVMAAA", "TPPPSYETVMAA", "TPPASYHTVMAA"]
B62 = substitution_matrix("BLOSUM62")


def slow(a, b, m, go, ge):
    """Cell by cell."""
    neg, at = -(2**30), {c: i for i, c in enumerate(ALPHABET)}
    M, X, Y, T = {}, {}, {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                M[i, j] = 0 if i == j == 0 else neg
                X[i, j] = -go - (i - 1) * ge if i else neg
                Y[i, j] = -go - (j - 1) * ge if j else neg
                T[i, j] = "U" if i else "L"
                continue
            x = max(M[i - 1, j] - go - ge, X[i - 1, j] - ge)
            y = max(M[i, j - 1] - go - ge, Y[i, j - 1] - ge)
            d = max(M[i - 1, j - 1], X[i - 1, j - 1], Y[i - 1, j - 1]) + m[at[a[i - 1]], at[b[j - 1]]]
            X[i, j], Y[i, j] = x, y
            T[i, j], M[i, j] = ("D", d) if d >= x and d >= y else ("U", x) if x >= y else ("L", y)
    i, j, out = len(a), len(b), ""
    while i or j:
        t = T[i, j]
        out = t + out
        i, j = i - (t != "L"), j - (t != "U")
    return out


@pytest.mark.parametrize(("a", "b", "steps"), [("ACDEFG", "ACFG", "DDUUDD"), ("ACFG", "ACDEFG", "DDLLDD"), ("AC", "A", "UD"), ("A", "", "U"), ("", "A", "L"), ("CKNYW", "FPP", "UDDDU"), ("AACACA", "CCCAACAC", "LLLDDDDDU"), ("CCCAACAC", "AACACA", "DDDUDDDU")])
def test_paths(a, b, steps):
    assert path(a, b, B62) == steps == slow(a, b, B62, 10, 4)


def test_degenerate_gaps():
    assert path("AX", "AX", B62, 0, 0) == "DLU"
    assert identities(["AX"], ["AX"], B62, 0, 0)[0] == pytest.approx(1 / 3)
    assert np.isnan(identities([""], [""], B62)[0])


def test_batch_against_slow():
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(2)) for _ in range(300)]
    got = identities([a for a, _ in pairs], [b for _, b in pairs], B62, 3, 1)
    for (a, b), x in zip(pairs, got, strict=True):
        steps, i, j, same = slow(a, b, B62, 3, 1), 0, 0, 0
        for t in steps:
            same += t == "D" and a[i] == b[j]
            i, j = i + (t != "L"), j + (t != "U")
        assert (np.isnan(x) and not steps) or x == pytest.approx(same / len(steps))


def test_matrix():
    assert B62.shape == (24, 24) and (B62 == B62.T).all() and B62[0, 0] == 4 and B62[17, 17] == 11 and B62[23, 23] == 1 and B62[23, 0] == -4
    text = "# own\n   " + " ".join(ALPHABET) + "\n" + "\n".join(a + " " + " ".join("1" if a == b else "-1" for b in ALPHABET) for a in ALPHABET)
    assert parse_matrix(text)[3, 3] == 1
    register_matrix("OWN", text)
    assert substitution_matrix("OWN")[0, 1] == -1
    with pytest.raises(ValueError, match="Invalid substitution matrix name: NOPE"):
        substitution_matrix("NOPE")
    with pytest.raises(ValueError, match="register_matrix"):
        substitution_matrix("BLOSUM45")


def seqs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "seq_id long, sequence string")


def test_similarity_nw(spark):
    rows = {(r.i, r.j): r.similarity for r in similarity_nw(seqs(spark, F5)).collect()}
    want = {(1, 2): 1 / 12, (1, 3): 2 / 12, (1, 4): 2 / 12, (2, 3): 11 / 13, (2, 4): 9 / 13, (3, 4): 10 / 12}
    assert rows == pytest.approx(want | {(i, i): 1.0 for i in range(1, 5)})
    s = similarity_stats(mirrored(similarity_nw(seqs(spark, F5)), "similarity")).first()
    assert (s.mean, s.median, s.min, s.max) == pytest.approx((0.4647436, 0.4294872, 1 / 12, 11 / 13), abs=1e-6)
    assert tuple(s.most_similar) == (3, 2) and tuple(s.least_similar) == (2, 1)
    upper = similarity_nw(seqs(spark, F5), diagonal=False)
    t = upper_quantile(upper, 0.8).first()[0]
    assert t == pytest.approx(10 / 12)
    assert sorted((r.src, r.dst) for r in threshold_edges(upper, F.lit(t)).collect()) == [(2, 3), (3, 4)]


def test_nw_errors(spark):
    with pytest.raises(Exception, match="Invalid amino acid in sequence1: J"):
        similarity_nw(seqs(spark, ["YSHJ", "AAA"])).collect()
    with pytest.raises(Exception, match="null"):
        similarity_nw(seqs(spark, ["A", None])).collect()
    assert [r.similarity for r in similarity_nw(seqs(spark, ["", ""]), diagonal=False).collect()] == [None]
