import itertools

import pytest
from pyspark.sql import functions as F

from seqloom.operators import analytics as A, cluster as C, consensus as N, graph as G, matrix as M


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def vertices(spark, n):
    return spark.range(1, n + 1)


BLOCKS = [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0), (1, 2, 1.0), (3, 4, 1.0)]


@pytest.mark.parametrize(("gamma", "want"), [(0.8, 0.6), (1.0, 0.5), (1.05, 0.475), (1.2, 0.4)])
def test_modularity(spark, gamma, want):
    of = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "id long, cluster int")
    assert G.modularity(edges(spark, BLOCKS), of, gamma).first()[0] == pytest.approx(want)


def test_netcluster(spark):
    cells = [(i, j, 1.0 if (i < 3) == (j < 3) else 0.0) for i in range(1, 5) for j in range(1, 5)]
    matrix = spark.createDataFrame(cells, "row long, col long, value double")
    assert [tuple(r) for r in G.netcluster(matrix).orderBy("id").collect()] == [(1, 1), (2, 1), (3, 2), (4, 2)]
    with pytest.raises(ValueError, match="square"):
        G.netcluster(matrix.where("col < 4"))
    with pytest.raises(ValueError, match="Wrong clustering output"):
        G.netcluster(matrix, lambda v, e: v.withColumn("cluster", F.lit("x")))


@pytest.mark.parametrize(("mode", "want"), [("upper", {(1, 1): 5, (1, 2): 2, (2, 3): 4}), ("lower", {(1, 1): 5, (1, 2): 1, (1, 3): 7}), ("max", {(1, 1): 5, (1, 2): 2, (2, 3): 4, (1, 3): 7}), ("min", {(1, 1): 5, (1, 2): 1}), ("plus", {(1, 1): 5, (1, 2): 3, (2, 3): 4, (1, 3): 7})])
def test_graph_modes(spark, mode, want):
    cells = {(1, 1): 5.0, (1, 2): 2.0, (2, 1): 1.0, (2, 3): 4.0, (3, 1): 7.0, (3, 3): 0.0}
    matrix = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, value double")
    assert {(r.src, r.dst): r.weight for r in G.graph_edges(matrix, mode).collect()} == want
    with pytest.raises(ValueError, match="mode"):
        G.graph_edges(matrix, "directed")


def test_weights_reach_the_clusterer(spark):
    cells = [(i, j, 1.0 if (i < 3) == (j < 3) else 0.0) for i in range(1, 5) for j in range(1, 5)]
    matrix = spark.createDataFrame(cells, "row long, col long, value double")
    seen = []

    def one(v, e):
        seen.append(e.columns)
        return v.withColumn("cluster", F.lit(1))

    G.netcluster(matrix, one)
    G.netcluster(matrix, one, cluster_weight=False)
    assert seen == [["src", "dst", "weight"], ["src", "dst"]]
    seqs = spark.createDataFrame([(i, "ABCDEFG"[: 3 + i % 3]) for i in range(6)], "seq_id long, sequence string")

    def parts(v, e, depth):
        seen.append(e.columns)
        return v.withColumn("cluster", F.lit(1))

    assert C.clusterbreak(seqs, size_max=10, size_min=3, cluster_fn=parts, cluster_wt=False).clustered.count() == 6 and "weight" not in seen[-1]
    assert G.netcluster(matrix, graph_weight=False).count() == 4


def test_uneven_clusters_have_no_majority(spark):
    rows = [(1, "AB", "x"), (2, "AC", "x"), (3, "A", "y"), (4, "ABC", "y")]
    got = {r.cluster_id: r.consensus for r in N.column_majority(spark.createDataFrame(rows, "seq_id long, pep string, c_index string")).collect()}
    assert got == {"x": "AB", "y": None}


def test_louvain_mod(spark):
    r = G.louvain_mod(vertices(spark, 4), edges(spark, BLOCKS), 1.0, 0.2, 0.1, 2).first()
    assert r.resolution == pytest.approx(0.8) and r.modularity == pytest.approx(0.4)
    assert [x.cluster for x in r.membership] == [1, 1, 2, 2]
    best = G.louvain_mod(vertices(spark, 4), edges(spark, BLOCKS), 1.0, 0.2, 0.1, 2, mode="best").first()
    assert best.resolution == pytest.approx(0.8) and best.modularity == pytest.approx(0.6)
    with pytest.raises(ValueError, match="res_step"):
        G.louvain_mod(vertices(spark, 4), edges(spark, BLOCKS), 1.0, 0.2)


def test_loops_dissolve_a_clique(spark):
    pairs = [(i, j, 1.0) for i, j in itertools.combinations(range(1, 9), 2)]
    loops = [(i, i, 1.0) for i in range(1, 9)]
    assert G.louvain_clusters(vertices(spark, 8), edges(spark, pairs + loops)).select("cluster").distinct().count() == 8
    assert G.louvain_clusters(vertices(spark, 8), edges(spark, pairs)).select("cluster").distinct().count() == 1


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW_EDGES", few)
    e = edges(spark, [(i, i + 1, 1.0) for i in range(2, 40)] + [(50, 60, 1.0)])
    got = {r.id: r.component for r in G.connected_components(vertices(spark, 60), e).collect()}
    assert got == {i: 2 if 2 <= i <= 40 else 50 if i == 60 else i for i in range(1, 61)}


def exact_blocks(spark):
    """14 items in blocks of 2, 4 and 8 with similarity 1 inside."""
    block = lambda i: 0 if i <= 2 else 1 if i <= 6 else 2

    def sim(members, depth):
        pairs = [(i, j) for i, j in itertools.combinations(range(1, 15), 2) if block(i) == block(j)]
        p = spark.createDataFrame(pairs, "i long, j long")
        left = members.select("part", F.col("seq_id").alias("i"))
        right = members.select("part", F.col("seq_id").alias("j"))
        return p.join(left, "i").join(right, ["part", "j"]).select("part", "i", "j", F.lit(1.0).alias("similarity"))

    return spark.createDataFrame([(i, f"s{i}") for i in range(1, 15)], "seq_id long, sequence string"), sim


def test_clusterbreak(spark):
    seqs, sim = exact_blocks(spark)
    r = C.clusterbreak(seqs, 0.8, 6, 3, sim_fn=sim)
    assert {x.seq_id for x in r.clustered.collect()} == {3, 4, 5, 6}
    assert {x.c_index.split(".")[0] for x in r.clustered.collect()} == {"1"}
    assert r.filtered.count() == 10
    report = r.report.first()
    assert report.converged and report.calls == 2
    short = C.clusterbreak(seqs, 0.8, 6, 3, max_itr=1, sim_fn=sim)
    assert short.filtered.count() == 2 and not short.report.first().converged
    with pytest.raises(ValueError, match="size_max must be greater"):
        C.clusterbreak(seqs, size_max=3, size_min=3)
    with pytest.raises(ValueError, match="empty input"):
        C.clusterbreak(seqs.limit(0))


def test_clusterbreak_of_one_and_of_sizes(spark):
    one = spark.createDataFrame([(1, "ACDE")], "seq_id long, sequence string")
    assert C.clusterbreak(one).filtered.count() == 1
    texts = [(i, "ACDEFGHIKLMNPQRSTVWY"[i % 3 :: 1 + i % 4] + "AC" * (i % 5)) for i in range(40)]
    r = C.clusterbreak(spark.createDataFrame(texts, "seq_id long, sequence string"), 0.7, 9, 2, self_loops=False, max_itr=100)
    sizes = [x["count"] for x in r.clustered.groupBy("c_index").count().collect()]
    assert all(2 <= n <= 9 for n in sizes)
    if r.report.first().converged:
        assert r.clustered.count() + r.filtered.count() == 40


def test_sparse_quantile(spark):
    sims = spark.createDataFrame([(0, 1, 2, 0.1), (0, 1, 3, 0.1), (0, 1, 4, 0.3), (0, 2, 3, 0.7)], "part int, i long, j long, similarity double")
    sizes = spark.createDataFrame([(0, 4), (1, 1), (2, 3)], "part int, n long")
    import numpy as np

    for p in (0.0, 0.2, 0.5, 0.8, 1.0):
        got = {r.part: r.threshold for r in M.sparse_quantile(sims, sizes, p, "part").collect()}
        assert got[0] == pytest.approx(np.quantile([0, 0, 0.1, 0.1, 0.3, 0.7], p)) and got[1] is None and got[2] == 0


def test_matrix_checks(spark, caplog):
    m = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.4), (2, 2, 1.0)], "row long, col long, value double")
    M.check_matrix(m)
    assert "not symmetric" in caplog.text
    with pytest.raises(ValueError, match="must be a matrix"):
        M.check_matrix(m.drop("value"))
    lone = M.similarity_stats(m.where("row = 1 and col = 1")).first()
    assert lone.mean is None and lone.most_similar is None


def test_heatmap_order(spark):
    m = spark.createDataFrame([(i, j, 1.0 if i % 2 == j % 2 else 0.0) for i in range(6) for j in range(6)], "row long, col long, value double")
    order = [r.row for r in M.heatmap_frame(m).where("col = 0").orderBy("row_order").collect()]
    assert {i % 2 for i in order[:3]} in ({0}, {1}) and len(order) == 6


def test_consensus(spark):
    rows = [(1, "AAAA", "1"), (2, "AAAB", "1"), (3, "AAAC", "1"), (4, "BBBB", "2"), (5, "BBBC", "2"), (6, "BBBB", "2"), (7, "CCCC", "3")]
    df = spark.createDataFrame(rows, "seq_id long, pep string, c_index string")
    assert {tuple(r) for r in N.column_majority(df).collect()} == {("1", "AAAA"), ("2", "BBBB"), ("3", "CCCC")}
    got = dict(map(tuple, N.cluster_consensus(df).collect()))
    assert got["3"] == "CCCC" and got["1"][:3] == "AAA" and got["1"][3] == "X"
    assert dict(map(tuple, N.cluster_consensus(df, ambiguity=False).collect()))["2"] == "BBBB"
    assert N.cluster_consensus(df.limit(0)).count() == 0
    nodes, links = N.consensus_network(N.column_majority(df), k_size=2, hash_size=20)
    assert nodes.count() == 3 and {"src", "dst", "weight"} == set(links.columns)


def test_alignment_rows_keep_their_letters():
    from seqloom.functions.substitution import substitution_matrix

    seqs = ["TPPPSYETVMAA", "PPPSYETVMAAA", "TPPASYHTVMAA", "PSYETVM"]
    rows = N.multiple_alignment(seqs, substitution_matrix("BLOSUM62"))
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == seqs


def test_analytics(spark):
    df = spark.createDataFrame([(1, "a|b|c|d|e"), (2, "a|b")], "id int, x string")
    assert [r.f for r in A.split_field(df, "x", "|", 3, 4, "f").orderBy("id").collect()] == ["c", ""]
    same = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, 7)], "a int, b int")
    assert A.adjusted_rand_index(same, "a", "b").first()[0] == pytest.approx(1)
    assert A.normalized_mutual_information(same, "a", "b").first()[0] == pytest.approx(1)
    one = spark.createDataFrame([(1, 1)], "a int, b int")
    assert A.adjusted_rand_index(one, "a", "b").first()[0] is None
    strata = spark.createDataFrame([(i, i % 2) for i in range(21)], "id int, g int")
    assert {r.g: r["count"] for r in A.stratified_sample(strata, "g", 0.3, F.col("id")).groupBy("g").count().collect()} == {0: 3, 1: 3}


def test_centre_beyond_200_members(spark):
    """The most central member comes after 200 others by seq_id."""
    far = ["".join("ARNDCQEGHI"[(i // 10**d) % 10] * 2 for d in range(3)) + "W" * 4 for i in range(205)]
    peps = [*far, "A" * 6 + "W" * 4 + "KL"]
    df = spark.createDataFrame([(i, p, "1") for i, p in enumerate(peps)], "seq_id long, pep string, c_index string")
    m = N.substitution_matrix("BLOSUM62")
    mean = [N.identities([p] * (len(peps) - 1), [q for q in peps if q != p], m).mean().round(12) for p in peps]
    want = peps[max(range(len(peps)), key=lambda k: (mean[k], -k))]
    assert N.centres(df, m).first().centre == want
    assert N.cluster_consensus(df).count() == 1


def test_euclid_dist_of_all_vectors(spark, tmp_path):
    from seqloom.plans.catalogue import QUERIES

    v = [[float((i * 7 + d * 3) % 11) for d in range(4)] for i in range(12)]
    spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.i, r.j): r.distance for r in QUERIES["euclid_dist_vectors"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): round(sum((a - b) ** 2 for a, b in zip(v[i], v[j])) ** 0.5, 6) for i, j in itertools.combinations(range(12), 2)}


def test_euclid_dist_by_blocks(spark, monkeypatch):
    """Pairs of blocks give what a join of the cells gives, also with gaps, nulls, repeated cells and ids of text; cells aren't joined."""
    from seqloom.operators import matrix as M

    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    cells = [(f"r{i:02}", f"c{k}", None if (i + k) % 5 == 0 else float((i * 7 + k * k) % 11)) for i in range(40) for k in range(70) if (i * k) % 3 != 1]
    cells += [("r03", "c1", 9.0), ("r07", "c0", float("nan")), ("r08", None, 1.0), (None, "c0", 1.0), ("alone", "own", 1.0), ("empty", "c1", None)]
    at = {}
    for r, c, x in cells:
        if r is not None and c is not None:
            at.setdefault(r, {}).setdefault(c, []).append(x)
    want = {}
    for i, j in itertools.combinations(sorted(at), 2):
        both = [(x, y) for c in at[i].keys() & at[j].keys() for x in at[i][c] for y in at[j][c]]
        if both:
            d = [(x - y) ** 2 for x, y in both if x is not None and y is not None]
            want[i, j] = f"{sum(d) ** 0.5:.9g}" if d else None
    df = M.euclid_dist(spark.createDataFrame(cells, "row string, col string, value double"))
    got = [((r.i, r.j), None if r.distance is None else f"{r.distance:.9g}") for r in df.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert "Join" not in df._jdf.queryExecution().toString()
    assert M.euclid_dist(spark.createDataFrame([], "row long, col long, value double")).count() == 0


def test_vector_dist_of_uneven_vectors(spark, monkeypatch):
    from seqloom.operators import matrix as M

    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    v = {1: [1.0, 2.0], 2: [4.0, 6.0, 9.0], 3: [], 4: None, 5: [None, 2.0], None: [1.0], 6: [None], **{i: [i * 0.5] * (i % 4 + 1) for i in range(10, 40)}}
    got = {(r.i, r.j): r.distance for r in M.vector_dist(spark.createDataFrame(list(v.items()), "row long, value array<double>")).collect()}
    want = {}
    for i, j in itertools.combinations(sorted(k for k in v if k is not None and v[k]), 2):
        d = [(x - y) ** 2 for x, y in zip(v[i], v[j]) if x is not None and y is not None]
        want[i, j] = pytest.approx(sum(d) ** 0.5) if d else None
    assert got == want


def test_left_join_fanout_is_dealt_by_its_result(spark, tmp_path, monkeypatch):
    """One nation with nearly all rows is spread over tasks; rows without a partner, null keys and copies stay."""
    from collections import Counter

    from seqloom.plans.catalogue import QUERIES

    sup = [(i, 7) for i in range(300)] + [(5, 7), (5, 7), (900, 1), (901, 2), (902, None), (902, None), (903, 9)]
    cust = [(i, 7, "BUILDING") for i in range(200)] + [(1, 7, "BUILDING"), (2, 7, "OTHER"), (300, 1, "BUILDING"), (301, 9, "OTHER"), (302, None, "BUILDING"), (303, 3, "BUILDING"), (304, 7, None)]
    spark.createDataFrame(sup, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(cust, "c_custkey long, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    mates = {}
    for c, n, seg in cust:
        if seg == "BUILDING" and n is not None:
            mates.setdefault(n, []).append(c)
    want = Counter((s, c) for s, n in sup for c in mates.get(n, [None]))
    for chunk, part in ((2048, 1 << 22), (16, 2000), (1, 20_000)):  # chunks of about one row may be empty
        monkeypatch.setattr(A, "CHUNK_ROWS", chunk, raising=False)
        monkeypatch.setattr(A, "PART_ROWS", part, raising=False)
        df = QUERIES["left_join_fanout"](spark, str(tmp_path))
        rows = df.withColumn("at", F.spark_partition_id()).collect()
        assert Counter((r.s_suppkey, r.c_custkey) for r in rows) == want
        if part == 2000:
            assert max(Counter(r.at for r in rows).values()) < len(rows) / 4


def test_fanout_join_without_partners(spark):
    left, none = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string"), spark.createDataFrame([], "k int, y long")
    assert sorted((r.x, r.y) for r in A.fanout_join(left, none, "k").collect()) == [("a", None), ("b", None)]
    assert A.fanout_join(none, left, "k").count() == 0
