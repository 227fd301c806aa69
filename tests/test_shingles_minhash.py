import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from seqloom.operators import minhash as H, shingling as S

F2 = ["ACDEGHHIKLLL", "ACDEGHHIKLMN"]
F3 = [*F2, "XXXXXYYYYYYZZ"]


def seqs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "seq_id long, sequence string")


def test_shingle():
    assert S.shingle("ABCDEF", 3) == ["ABC", "BCD", "CDE", "DEF"]
    assert S.shingle("AB", 2) == ["AB"]
    assert len(S.shingle("ABCDEF", 1)) == 6
    with pytest.raises(ValueError, match="single character string"):
        S.shingle(123, 3)
    for k in (0, 7):
        with pytest.raises(ValueError, match="between 1 and 6"):
            S.shingle("ABCDEF", k)


def test_shingle_table_of_short_and_null(spark):
    rows = S.shingle_table(seqs(spark, ["ABCD", "AB", "", None]), 3).collect()
    assert [(r.seq_id, r.pos, r.shingle) for r in rows] == [(1, 1, "ABC"), (1, 2, "BCD")]
    with pytest.raises(Exception, match="between 1 and 2"):
        S.shingle_table(seqs(spark, ["AB"]), 3, strict=True).collect()


def test_vocab(spark):
    rows = S.create_vocab(seqs(spark, F2), 3).orderBy("rank").collect()
    assert [r.shingle for r in rows] == "ACD CDE DEG EGH GHH HHI HIK IKL KLL KLM LLL LMN".split()
    assert [r["rank"] for r in rows] == list(range(1, 13))
    assert S.create_vocab(seqs(spark, F3), 3).count() == 18


def test_char_matrix(spark):
    s = seqs(spark, F3)
    v = S.create_vocab(s, 3)
    assert {r.seq_id: r["count"] for r in S.create_char_matrix(s, v, 3).groupBy("seq_id").count().collect()} == {1: 10, 2: 10, 3: 6}
    dense = S.dense_char_matrix(s, v, 3).collect()
    assert len(dense) == 54 and {r.present for r in dense} == {0, 1}
    assert len(S.wide_char_matrix(s, v, 3, [1, 2]).columns) == 3
    few = v.where("rank < 3")
    assert S.create_char_matrix(s, few, 3).count() == 4


def test_hash_params(spark):
    rows = H.create_hash_parameters(spark, 10, 100, 1).collect()
    assert len(rows) == 10 and all(1 <= r.a <= 100 and 0 <= r.b <= 100 for r in rows)
    with pytest.raises(ValueError, match="Number of hash functions"):
        H.create_hash_parameters(spark, 0, 100)
    with pytest.raises(ValueError, match="Maximum value"):
        H.create_hash_parameters(spark, 1, 1)
    assert H.apply_hash(5, 2, 3, 100) == 13


def test_signature_and_distance(spark):
    m = H.minhash(seqs(spark, F3), 3, 5, params=[(1, 0), (2, 1), (3, 2), (5, 3), (7, 4)])
    sig = {}
    for r in m.sig_matrix.orderBy("seq_id", "hash_id").collect():
        sig.setdefault(r.seq_id, []).append(r.min_hash)
    assert sig == {1: [1, 1, 2, 0, 0], 2: [1, 3, 2, 0, 0], 3: [0, 1, 2, 1, 1]}
    d = {(r.i, r.j): round(r.distance, 9) for r in m.dist_matrix.collect()}
    assert d == {(1, 2): 0.2, (1, 3): 0.6, (2, 3): 0.8}


def test_distance_of_fixed_signatures(spark):
    rows = [(s, h, v) for s, col in enumerate(([1, 2, 3], [1, 2, 4], [2, 3, 5]), 1) for h, v in enumerate(col)]
    d = {(r.i, r.j): r.distance for r in H.compute_distance_matrix(spark.createDataFrame(rows, "seq_id long, hash_id int, min_hash long"), 3).collect()}
    assert d[1, 2] == pytest.approx(1 / 3) and d[1, 3] == d[2, 3] == 1


def test_one_word_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError, match="Maximum value"):
        H.minhash(seqs(spark, ["AAA"]), 3, 5)


def test_jaccard(spark):
    rows = H.exact_jaccard(seqs(spark, F3), 3).collect()
    assert [(r.i, r.j, r.similarity) for r in rows] == [(1, 2, 8 / 12)]


@pytest.mark.parametrize(("text", "zero", "other"), [
    ("AC", 635767089, 4246042472), ("ACD", 535938593, 2354551361), ("ACDE", 2543633677, 2342538321),
    ("ACDEG", 2219470412, 1288109280), ("ACDEGHHIKLLL", 957597957, 3696481220), ("", 0, 142593372),
])
def test_murmur(text, zero, other):
    raw = np.frombuffer(text.encode(), np.uint8)[None]
    assert int(H.murmur3_32(raw, 0)[0]) == zero and int(H.murmur3_32(raw, 42)[0]) == other


def test_short_sequences_are_alike(spark):
    rows = {(r.i, r.j): r.similarity for r in H.similarity_mh(seqs(spark, ["ABC", "XY", "ABCDE"]), 4, 50, dense=True).collect()}
    assert rows == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0}


def test_mh_errors(spark):
    with pytest.raises(ValueError, match="cannot be empty"):
        H.similarity_mh(seqs(spark, []), 4)
    with pytest.raises(ValueError, match="'k' must be"):
        H.similarity_mh(seqs(spark, F3), 0)
    with pytest.raises(ValueError, match="Number of hash"):
        H.similarity_mh(seqs(spark, F3), 4, 0)
    with pytest.raises(IndexError, match="out of range"):
        H.family_hash(b"AC", [1, 2], 2)


def test_native_and_numpy_agree(spark):
    texts = seqs(spark, [*F3, "ABC", F2[0]])
    seeds = [r.h & 0xFFFFFFFF for r in spark.range(20).selectExpr("hash(cast(id as int)) h").collect()]
    a = {tuple(r) for r in H.native_signatures(texts, 4, 20).collect()}
    b = {tuple(r) for r in H.signatures(texts, 4, 20, seeds=seeds).collect()}
    assert a == b


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACDE", max_size=9), min_size=2, max_size=6))
def test_mh_against_sets(spark, texts):
    rows = H.similarity_mh(seqs(spark, texts), 2, 30, seed=3, dense=True).collect()
    seeds = H.hash_seeds(30, 3)
    least = [[min((H.family_hash(t[p : p + 2].encode(), seeds, h) for p in range(len(t) - 1)), default=2**32 - 1) for h in range(30)] for t in texts]
    assert {(r.i, r.j): r.similarity for r in rows} == {(i + 1, j + 1): sum(a == b for a, b in zip(least[i], least[j], strict=True)) / 30 for i in range(len(texts)) for j in range(i + 1, len(texts))}


def test_same_seed_same_result(spark):
    first, second = (sorted(map(tuple, H.similarity_mh(seqs(spark, F3), 3, 20, seed=9).collect())) for _ in range(2))
    assert first == second
