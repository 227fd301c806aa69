"""Queries over the driver's tables by name, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analytics as A, cluster as C, consensus as N, graph as G, matrix as M, minhash as H, shingling as S
from ..operators.align import similarity_nw
from ..functions.kmers import affine
from ..sources.sequences import distinct_strings, from_column, residues
from .workspace import Workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: (a, b) of twenty affine hashes.
PARAMS = [(2 * i + 3, 7 * i + 1) for i in range(20)]
_VALUES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(PARAMS))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct part names as sequences."""
    return distinct_strings(table(spark, sf_dir, "part"), "p_name")


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein-like strings made of the part names."""
    return distinct_strings(table(spark, sf_dir, "part"), residues(F.col("p_name")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_column(table(spark, sf_dir, "benchmark"), "text", "item_id")


_SEQ = "seqs AS (SELECT row_number() OVER (ORDER BY p_name) AS seq_id, p_name AS sequence FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL))"
_SEQ_ITEMS = "seqs AS (SELECT item_id AS seq_id, text AS sequence FROM benchmark)"
_SH = lambda k: f"sh AS (SELECT seq_id, pos, substr(sequence, pos, {k}) AS shingle FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence) - {k} + 2)) AS pos FROM seqs))"
_VOCAB = "vocab AS (SELECT shingle, row_number() OVER (ORDER BY shingle) AS rank FROM (SELECT DISTINCT shingle FROM sh))"
_CHARS = "chars AS (SELECT DISTINCT seq_id, rank FROM sh JOIN vocab USING (shingle))"
_SIG = f"params(hash_id, a, b) AS (VALUES {_VALUES}), v AS (SELECT count(*) AS m FROM vocab), sig AS (SELECT seq_id, hash_id, min((a * rank + b) % m) AS min_hash FROM chars, params, v GROUP BY ALL)"
_BASE = f"WITH {_SEQ}, {_SH(3)}, {_VOCAB}, {_CHARS}, {_SIG}"
_BASE_ITEMS = f"WITH {_SEQ_ITEMS}, {_SH(4)}, {_VOCAB}, {_CHARS}, {_SIG}"
_DIST = "SELECT x.seq_id AS i, y.seq_id AS j, 1 - count(*) FILTER (x.min_hash = y.min_hash) / {n}::DOUBLE AS distance FROM sig x JOIN sig y ON x.hash_id = y.hash_id AND x.seq_id < y.seq_id GROUP BY ALL"


def _affine(seqs: DataFrame, k: int) -> H.MinHash:
    return H.minhash(seqs, k, len(PARAMS), params=PARAMS)


@query(f"{_BASE} {_DIST.format(n=20)}")
def minhash_distance_part(spark, sf_dir):
    return _affine(names(spark, sf_dir), 3).dist_matrix


@query(f"WITH {_SEQ_ITEMS}, {_SH(4)} SELECT seq_id, CAST(pos AS INTEGER) AS pos, shingle FROM sh")
def shingle(spark, sf_dir):
    return S.shingle_table(items(spark, sf_dir), 4)


@query(f"WITH {_SEQ_ITEMS}, {_SH(4)}, {_VOCAB} SELECT shingle, rank FROM vocab")
def create_vocab(spark, sf_dir):
    return S.create_vocab(items(spark, sf_dir), 4)


@query(f"WITH {_SEQ_ITEMS}, {_SH(4)}, {_VOCAB}, {_CHARS} SELECT seq_id, rank FROM chars")
def char_matrix_sparse(spark, sf_dir):
    seqs = items(spark, sf_dir)
    return S.create_char_matrix(seqs, S.create_vocab(seqs, 4), 4)


@query(f"WITH {_SEQ}, {_SH(3)}, {_VOCAB}, {_CHARS} SELECT vocab.rank, seqs.seq_id, CAST(chars.rank IS NOT NULL AS INTEGER) AS present FROM vocab CROSS JOIN seqs LEFT JOIN chars ON chars.rank = vocab.rank AND chars.seq_id = seqs.seq_id")
def char_matrix_dense(spark, sf_dir):
    seqs = names(spark, sf_dir)
    return S.dense_char_matrix(seqs, S.create_vocab(seqs, 3), 3)


_DRAW = lambda name, n: f"CAST(('0x' || substr(md5('7:{name}:' || i), 1, 15)) AS BIGINT) % {n}"


@query(f"SELECT CAST(i AS INTEGER) AS hash_id, 1 + {_DRAW('a', 1000)} AS a, {_DRAW('b', 1001)} AS b FROM range(50) t(i)")
def hash_params(spark, sf_dir):
    return H.create_hash_parameters(spark, 50, 1000, seed=7)


@query("SELECT p_partkey, ((p_size * 3 + 5) % 7 + 7) % 7 AS hash FROM (SELECT p_partkey, CAST(p_size AS BIGINT) - 25 AS p_size FROM part)")
def apply_hash(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", affine(F.col("p_size") - 25, F.lit(3), F.lit(5), 7).alias("hash"))


@query(f"{_BASE_ITEMS} SELECT seq_id, hash_id, min_hash FROM sig")
def signature_matrix(spark, sf_dir):
    return _affine(items(spark, sf_dir), 4).sig_matrix


@query(f"{_BASE_ITEMS} {_DIST.format(n=20)}")
def distance_matrix(spark, sf_dir):
    return _affine(items(spark, sf_dir), 4).dist_matrix


@query(f"""WITH {_SEQ_ITEMS}, {_SH(4)}, s AS (SELECT DISTINCT seq_id, shingle FROM sh), z AS (SELECT seq_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.seq_id AS i, y.seq_id AS j, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.seq_id < y.seq_id GROUP BY ALL)
SELECT i, j, c / (a.n + b.n - c)::DOUBLE AS similarity FROM c JOIN z a ON a.seq_id = i JOIN z b ON b.seq_id = j""")
def exact_jaccard(spark, sf_dir):
    return H.exact_jaccard(items(spark, sf_dir), 4)


_MUL = lambda x, c: f"((({x}) & 65535) * {c} + (((({x}) >> 16) * {c} & 65535) << 16)) & 4294967295"
_ROT = lambda x, r: f"((({x}) << {r}) & 4294967295) | (({x}) >> {32 - r})"


def _mix_sql(block: str, seed: str, n: int) -> list[str]:
    """Common table columns of Murmur3 for one 4-byte block."""
    k = _MUL(_ROT(_MUL(block, 3432918353), 15), 461845907)
    return [f"xor({seed}, {k})", _ROT("h0", 13), "(h1 * 5 + 3864292196) & 4294967295", f"xor(h2, {n})", f"xor(h3, h3 >> 16)", _MUL("h4", 2246822507), "xor(h5, h5 >> 13)", _MUL("h6", 3266489909), "xor(h7, h7 >> 16)"]


def _murmur(name: str, source: str, block: str, seed: str, keep: str) -> str:
    out, last = [], source
    for i, e in enumerate(_mix_sql(block, seed, 4)):
        held = keep + "".join(f", h{j}" for j in range(i))
        out.append(f"{name}{i} AS (SELECT {held}, {e} AS h{i} FROM {last})")
        last = f"{name}{i}"
    return ", ".join(out)


_BYTES4 = "(ord(substr(shingle, 1, 1)) | (ord(substr(shingle, 2, 1)) << 8) | (ord(substr(shingle, 3, 1)) << 16) | (ord(substr(shingle, 4, 1)) << 24))::BIGINT"
_MH = f"""WITH {_SEQ}, {_SH(4)}, ids AS (SELECT CAST(i AS BIGINT) AS hid FROM range(50) t(i)), {_murmur('s', 'ids', 'hid', '42', 'hid')},
d AS (SELECT DISTINCT seq_id, shingle FROM sh), b AS (SELECT seq_id, {_BYTES4} AS block FROM d), x AS (SELECT seq_id, hid, block, h8 AS seed FROM b, s8),
{_murmur('m', 'x', 'block', 'seed', 'seq_id, hid, block, seed')},
f AS (SELECT seq_id, hid, min(h8) AS mh FROM m8 GROUP BY ALL), sig AS (SELECT seqs.seq_id, ids.hid, coalesce(mh, 4294967295) AS mh FROM seqs CROSS JOIN ids LEFT JOIN f ON f.seq_id = seqs.seq_id AND f.hid = ids.hid),
n AS (SELECT x.seq_id AS i, y.seq_id AS j, count(*) FILTER (x.mh = y.mh) / 50::DOUBLE AS similarity FROM sig x JOIN sig y ON x.hid = y.hid AND x.seq_id < y.seq_id GROUP BY ALL)"""


@query(f"{_MH} SELECT i, j, similarity FROM n WHERE similarity > 0")
def similarity_mh_k4(spark, sf_dir):
    return H.similarity_mh(names(spark, sf_dir), 4, 50, native=True)


@query(f"{_MH} SELECT i, j, similarity FROM n")
def similarity_mh_dense(spark, sf_dir):
    return H.similarity_mh(names(spark, sf_dir), 4, 50, native=True, dense=True)


@query("SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, 1.0::DOUBLE AS similarity FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def similarity_mh_short_seq(spark, sf_dir):
    """Texts shorter than k are all alike."""
    return H.similarity_mh(from_column(table(spark, sf_dir, "nation"), "n_name", "n_nationkey"), 12, 10)


# Murmur3 of three bytes has no whole block: the bytes' word is mixed in, without the step after a block.
_K3 = [_MUL(_ROT(_MUL("block", 3432918353), 15), 461845907), "xor(xor(seed, h0), 3)", "xor(h1, h1 >> 16)", _MUL("h2", 2246822507), "xor(h3, h3 >> 13)", _MUL("h4", 3266489909), "xor(h5, h5 >> 16)"]
_K3_STEPS = ", ".join(f"t{i} AS (SELECT seq_id, hid, block, seed{''.join(f', h{j}' for j in range(i))}, {e} AS h{i} FROM {f't{i - 1}' if i else 'x3'})" for i, e in enumerate(_K3))
_MH3 = f"""WITH {_SEQ}, {_SH(3)}, seeds(hid, seed) AS (VALUES {', '.join(f'({i}, {x}::BIGINT)' for i, x in enumerate(H.hash_seeds(50)))}),
x3 AS (SELECT seq_id, hid, seed, (ord(substr(shingle, 1, 1)) | (ord(substr(shingle, 2, 1)) << 8) | (ord(substr(shingle, 3, 1)) << 16))::BIGINT AS block FROM (SELECT DISTINCT seq_id, shingle FROM sh), seeds), {_K3_STEPS},
f3 AS (SELECT seq_id, hid, min(h6) AS mh FROM t6 GROUP BY ALL), sig3 AS (SELECT seqs.seq_id, seeds.hid, coalesce(mh, 4294967295) AS mh FROM seqs CROSS JOIN seeds LEFT JOIN f3 ON f3.seq_id = seqs.seq_id AND f3.hid = seeds.hid),
n3 AS (SELECT x.seq_id AS i, y.seq_id AS j, count(*) FILTER (x.mh = y.mh) / 50::DOUBLE AS similarity FROM sig3 x JOIN sig3 y ON x.hid = y.hid AND x.seq_id < y.seq_id GROUP BY ALL)"""


@query(f"{_MH3} SELECT i, j, similarity FROM n3 WHERE similarity > 0")
def similarity_mh_k3(spark, sf_dir):
    return H.similarity_mh(names(spark, sf_dir), 3, 50)


_DENSE = f"{_MH}, full_ AS (SELECT i AS r, j AS c, similarity AS value FROM n UNION ALL SELECT j, i, similarity FROM n UNION ALL SELECT seq_id, seq_id, 1.0 FROM seqs)"


@query(f"""{_DENSE}, u AS (SELECT avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max FROM full_ WHERE r < c)
SELECT round(mean, 9) AS mean, round(median, 9) AS median, min, max, (SELECT arg_min(r, c * 1000000 + r) FROM full_ WHERE value = u.max) AS most_row, (SELECT arg_min(c, c * 1000000 + r) FROM full_ WHERE value = u.max) AS most_col,
(SELECT arg_min(r, c * 1000000 + r) FROM full_ WHERE value = u.min) AS least_row, (SELECT arg_min(c, c * 1000000 + r) FROM full_ WHERE value = u.min) AS least_col FROM u""")
def similarity_stats(spark, sf_dir):
    seqs = names(spark, sf_dir)
    s = M.similarity_stats(M.mirrored(H.similarity_mh(seqs, 4, 50, native=True, dense=True), "similarity", seqs))
    return s.select(F.round("mean", 9).alias("mean"), F.round("median", 9).alias("median"), "min", "max", F.col("most_similar.row").alias("most_row"), F.col("most_similar.col").alias("most_col"), F.col("least_similar.row").alias("least_row"), F.col("least_similar.col").alias("least_col"))


@query(f"{_BASE_ITEMS}, d AS ({_DIST.format(n=20)}) SELECT round(quantile_cont(1 - distance, 0.8), 9) AS threshold FROM d")
def upper_tri_quantile(spark, sf_dir):
    d = _affine(items(spark, sf_dir), 4).dist_matrix.select("i", "j", (1 - F.col("distance")).alias("similarity"))
    return M.upper_quantile(d, 0.8).select(F.round("threshold", 9).alias("threshold"))


@query(f"{_DENSE} SELECT round(quantile_cont(value, 0.8), 9) AS threshold FROM full_")
def whole_matrix_quantile(spark, sf_dir):
    seqs = names(spark, sf_dir)
    full = M.mirrored(H.similarity_mh(seqs, 4, 50, native=True, dense=True), "similarity", seqs)
    return full.agg(F.round(F.percentile("value", F.lit(0.8)), 9).alias("threshold"))


@query(f"{_MH}, q AS (SELECT quantile_cont(similarity, 0.95) AS t FROM n) SELECT i AS src, j AS dst, similarity AS weight FROM n, q WHERE similarity >= t - 1e-12 AND similarity > 0")
def threshold_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def _edges(spark, sf_dir, p: float = 0.95) -> DataFrame:
    """Edges from the quantile of the full triangle, found from the pairs that aren't zero."""
    seqs = names(spark, sf_dir)
    near = H.similarity_mh(seqs, 4, 50, native=True).withColumn("part", F.lit(0))
    limit = M.sparse_quantile(near, seqs.agg(F.lit(0).alias("part"), F.count(F.lit(1)).alias("n")), p, "part")
    return M.threshold_edges(near.join(limit, "part"), F.col("threshold") - 1e-12).select("src", "dst", "weight")


@query(f"""{_MH}, sh3 AS (SELECT DISTINCT seq_id, shingle FROM sh), z AS (SELECT seqs.seq_id, count(shingle) AS n FROM seqs LEFT JOIN sh3 USING (seq_id) GROUP BY 1),
c AS (SELECT x.seq_id AS i, y.seq_id AS j, count(*) AS c FROM sh3 x JOIN sh3 y ON x.shingle = y.shingle AND x.seq_id < y.seq_id GROUP BY ALL)
SELECT round(corr(n.similarity, c / (a.n + b.n - c)::DOUBLE), 6) AS r FROM n JOIN c USING (i, j) JOIN z a ON a.seq_id = i JOIN z b ON b.seq_id = j WHERE n.similarity > 0""")
def matrix_corr(spark, sf_dir):
    seqs = names(spark, sf_dir)
    return M.matrix_corr(H.similarity_mh(seqs, 4, 50, native=True), H.exact_jaccard(seqs, 4)).select(F.round("r", 6).alias("r"))


@query("""WITH v AS (SELECT seq, unnest(range(1, len(embedding) + 1)) AS k, embedding FROM (SELECT label AS seq, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) JOIN embeddings USING (vec_id)),
c AS (SELECT seq, k, CAST(embedding[k] AS DOUBLE) AS x FROM v)
SELECT CAST(a.seq AS BIGINT) AS i, CAST(b.seq AS BIGINT) AS j, round(sqrt(sum(power(a.x - b.x, 2))), 6) AS distance FROM c a JOIN c b ON a.k = b.k AND a.seq < b.seq GROUP BY ALL""")
def euclid_dist(spark, sf_dir):
    """Between the first vectors of each label."""
    first = A.keep_first(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    cells = first.select(F.col("label").cast("long").alias("row"), F.posexplode("embedding").alias("col", "value")).withColumn("value", F.col("value").cast("double"))
    return M.euclid_dist(cells).withColumn("distance", F.round("distance", 6))


@query()
def euclid_dist_vectors(spark, sf_dir):
    """Between all vectors; ``euclid_dist`` and its SQL take one vector a label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("row"), F.col("embedding").alias("value"))
    return M.vector_dist(rows).withColumn("distance", F.round("distance", 6))


@query()
def similarity_nw_blosum62(spark, sf_dir):
    return similarity_nw(peptides(spark, sf_dir))


@query()
def nw_mh_correlation(spark, sf_dir):
    seqs = peptides(spark, sf_dir)
    return M.matrix_corr(similarity_nw(seqs, diagonal=False), H.similarity_mh(seqs, 2, 50, dense=True))


@query(f"""{_BASE}, seqs2 AS (SELECT seq_id, sequence, length(sequence) % 3 AS cluster FROM seqs), d AS ({_DIST.format(n=20)}), e AS (SELECT i, j, 1 - distance AS w FROM d WHERE distance < 1),
m AS (SELECT sum(w) AS m FROM e), f AS (SELECT e.*, a.cluster AS ci, b.cluster AS cj FROM e JOIN seqs2 a ON a.seq_id = i JOIN seqs2 b ON b.seq_id = j),
l AS (SELECT ci AS c, sum(w) AS l FROM f WHERE ci = cj GROUP BY 1), g AS (SELECT c, sum(w) AS d FROM (SELECT ci AS c, w FROM f UNION ALL SELECT cj, w FROM f) GROUP BY 1)
SELECT round(sum(coalesce(l, 0) / m - 1.05::DOUBLE * power(d / (2 * m), 2)), 8) AS modularity FROM g LEFT JOIN l USING (c), m""")
def modularity(spark, sf_dir):
    seqs = names(spark, sf_dir)
    edges = _affine(seqs, 3).dist_matrix.where("distance < 1").select(F.col("i").alias("src"), F.col("j").alias("dst"), (1 - F.col("distance")).alias("weight"))
    of = seqs.select(F.col("seq_id").alias("id"), (F.length("sequence") % 3).alias("cluster"))
    return G.modularity(edges, of, 1.05).select(F.round("modularity", 8).alias("modularity"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def contingency(spark, sf_dir):
    return A.contingency(table(spark, sf_dir, "part"), "p_brand", "p_type")


_PAIR = "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL"


@query(f"""WITH n AS ({_PAIR}), x AS (SELECT sum(n * (n - 1) / 2.0) AS ab, sum(n) AS t FROM n), a AS (SELECT sum(m * (m - 1) / 2.0) AS a FROM (SELECT sum(n) AS m FROM n GROUP BY a)), b AS (SELECT sum(m * (m - 1) / 2.0) AS b FROM (SELECT sum(n) AS m FROM n GROUP BY b))
SELECT round(((ab - a * b / (t * (t - 1) / 2.0)) / ((a + b) / 2.0 - a * b / (t * (t - 1) / 2.0)))::DOUBLE, 12) AS ari FROM x, a, b""")
def ari(spark, sf_dir):
    return A.adjusted_rand_index(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select(F.round(F.col("ari").cast("double"), 12).alias("ari"))


@query(f"""WITH n AS ({_PAIR}), t AS (SELECT sum(n)::DOUBLE AS t FROM n), a AS (SELECT a, sum(n)::DOUBLE AS na FROM n GROUP BY a), b AS (SELECT b, sum(n)::DOUBLE AS nb FROM n GROUP BY b)
SELECT round((SELECT sum(n / t * ln(n * t / (na * nb))) FROM n JOIN a USING (a) JOIN b USING (b), t) / sqrt((SELECT -sum(na / t * ln(na / t)) FROM a, t) * (SELECT -sum(nb / t * ln(nb / t)) FROM b, t)), 10) AS nmi""")
def nmi(spark, sf_dir):
    return A.normalized_mutual_information(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("nmi", 10).alias("nmi"))


@query("""WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, n / (SELECT sum(n) FROM n)::DOUBLE * 100 AS pct FROM n)
SELECT o_orderstatus, o_orderpriority, n, round(pct, 9) AS pct FROM p UNION ALL SELECT NULL, o_orderpriority, CAST(sum(n) AS BIGINT), round(sum(pct), 9) FROM p GROUP BY o_orderpriority""")
def confusion_pct(spark, sf_dir):
    return A.confusion_percent(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").withColumn("pct", F.round("pct", 9))


@query("""WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, n / (SELECT sum(n) FROM n)::DOUBLE * 100 AS pct FROM n)
SELECT o_orderstatus, o_orderpriority, n, round(pct, 9) AS pct FROM p UNION ALL SELECT 'truth', o_orderpriority, CAST(sum(n) AS BIGINT), round(sum(pct), 9) FROM p GROUP BY o_orderpriority""")
def confusion_truth(spark, sf_dir):
    return A.confusion_percent(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "truth").withColumn("pct", F.round("pct", 9))


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT c.*, CAST(run AS INTEGER) AS run FROM customer c, range(20) t(run)),
k AS (SELECT r.*, row_number() OVER (PARTITION BY run, c_mktsegment ORDER BY md5('3:' || run || ':' || c_custkey), c_custkey) AS place_ FROM r)
SELECT run, count(*) AS rows, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd FROM k JOIN s USING (c_mktsegment) WHERE place_ <= round(0.2 * n) GROUP BY run""")
def replicate_experiment(spark, sf_dir):
    """Twenty stratified samples of customers and a statistic of each, as one job."""
    measures = {"rows": F.count(F.lit(1)), "mean": F.round(F.avg("c_acctbal"), 6), "sd": F.round(F.stddev_samp("c_acctbal"), 6)}
    return A.replicates(table(spark, sf_dir, "customer"), "c_mktsegment", 0.2, "c_custkey", 20, 3, measures)


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_round_trip(spark, sf_dir):
    """Written as CSV below the shared folder and read again."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = f"{Workspace(spark, 'csv').root}/part"
    A.write_csv(part, path)
    return spark.read.schema(part.schema).csv(path, header=True)


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('5:' || c_custkey)) AS k FROM customer) WHERE k <= round(0.1 * n)""")
def stratified_sample(spark, sf_dir):
    order = F.md5(F.concat(F.lit("5:"), F.col("c_custkey").cast("string")))
    return A.stratified_sample(table(spark, sf_dir, "customer"), "c_mktsegment", 0.1, order).select("c_custkey", "c_mktsegment")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def distinct_keep_first(spark, sf_dir):
    return A.keep_first(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_name", "p_partkey", "p_brand")


@query("SELECT p_partkey, coalesce(str_split(p_brand || '|' || p_type || '|' || p_name || '|x', '|')[3], '') AS field, coalesce(str_split(p_type, '|')[3], '') AS none FROM part")
def split_field(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("joined", F.concat_ws("|", "p_brand", "p_type", "p_name", F.lit("x")))
    return A.split_field(A.split_field(part, "joined", "|", 3, 4, "field"), "p_type", "|", 3, 4, "none").select("p_partkey", "field", "none")


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_long(spark, sf_dir):
    return A.unpivot(table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT round(avg(p_size), 9) AS p_size_mean, round(stddev_samp(p_size), 6) AS p_size_sd, round(avg(p_retailprice), 6) AS p_retailprice_mean, round(stddev_samp(p_retailprice), 6) AS p_retailprice_sd FROM part")
def mean_sd(spark, sf_dir):
    s = A.mean_sd(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return s.select(F.round("p_size_mean", 9).alias("p_size_mean"), *(F.round(c, 6).alias(c) for c in ("p_size_sd", "p_retailprice_mean", "p_retailprice_sd")))


@query("SELECT p_type, min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, max(p_retailprice) AS max FROM part GROUP BY 1")
def box_stats(spark, sf_dir):
    s = A.box_stats(table(spark, sf_dir, "part"), "p_type", "p_retailprice")
    return s.select("p_type", "min", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "max")


@query("SELECT s.s_suppkey, c.c_custkey FROM supplier s LEFT JOIN customer c ON c.c_nationkey = s.s_nationkey AND c.c_mktsegment = 'BUILDING'")
def left_join_fanout(spark, sf_dir):
    right = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey")
    return A.fanout_join(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), right, "s_nationkey").select("s_suppkey", "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def head_slice(spark, sf_dir):
    return A.head(table(spark, sf_dir, "orders"), "o_orderkey", 50).select("o_orderkey", "o_totalprice")


@query(f"WITH {_SEQ}, {_SH(3)} SELECT shingle, max(CAST(seq_id = 1 AS INTEGER)) AS in_first, max(CAST(seq_id = 2 AS INTEGER)) AS in_second FROM sh WHERE seq_id IN (1, 2) GROUP BY 1")
def shingle_union(spark, sf_dir):
    return S.shingle_union(names(spark, sf_dir), 3, 1, 2)


@query(f"""WITH {_SEQ}, {_SH(3)}, {_VOCAB}, {_CHARS}, p AS (SELECT rank, perm, row_number() OVER (PARTITION BY perm ORDER BY md5('0:' || perm || ':' || rank)) AS place FROM vocab, (SELECT unnest(range(0, 10)) AS perm))
SELECT seq_id, CAST(perm AS INTEGER) AS perm, CAST(min(place) AS INTEGER) AS first FROM chars JOIN p USING (rank) GROUP BY ALL""")
def permutation_minhash(spark, sf_dir):
    seqs = names(spark, sf_dir)
    return H.permutation_minhash(S.create_char_matrix(seqs, S.create_vocab(seqs, 3), 3), 10)


@query(f"""WITH RECURSIVE {_MH.removeprefix('WITH ')}, q AS (SELECT quantile_cont(similarity, 0.95) AS t FROM n), e AS (SELECT i, j FROM n, q WHERE similarity >= t - 1e-12 AND similarity > 0),
both_ AS (SELECT i, j FROM e UNION SELECT j, i FROM e), r AS (SELECT seq_id AS id, seq_id AS c FROM seqs UNION SELECT both_.j, r.c FROM r JOIN both_ ON both_.i = r.id)
SELECT id, min(c) AS component FROM r GROUP BY 1""")
def connected_components(spark, sf_dir):
    return G.connected_components(names(spark, sf_dir).select(F.col("seq_id").alias("id")), _edges(spark, sf_dir))


@query()
def netcluster(spark, sf_dir):
    seqs = names(spark, sf_dir)
    return G.netcluster(M.mirrored(H.similarity_mh(seqs, 4, 50, native=True, dense=True), "similarity", seqs))


@query()
def louvain_mod(spark, sf_dir):
    return G.louvain_mod(names(spark, sf_dir).select(F.col("seq_id").alias("id")), _edges(spark, sf_dir), 1.0, 0.2, 0.2, 2)


def _clusters(spark, sf_dir) -> C.ClusterResult:
    return C.clusterbreak(names(spark, sf_dir), 0.8, 12, 3, sim_fn=C.minhash_similarity(2, 50, 1), self_loops=False, max_itr=200)


@query()
def clusterbreak(spark, sf_dir):
    return _clusters(spark, sf_dir).clustered


@query()
def cluster_filtered(spark, sf_dir):
    """Of clusters of nine at least, so that some are too small."""
    return C.clusterbreak(names(spark, sf_dir), 0.95, 30, 9, sim_fn=C.minhash_similarity(4, 50, 1), self_loops=False, max_itr=200).filtered


@query(f"WITH {_SEQ} SELECT seq_id, sequence AS pep, true AS once, true AS fits FROM seqs")
def cluster_partition(spark, sf_dir):
    """Every sequence is clustered or filtered, once, and clusters keep to their sizes."""
    r = _clusters(spark, sf_dir)
    sizes = r.clustered.groupBy("c_index").agg(F.count(F.lit(1)).alias("n"))
    placed = r.clustered.join(sizes, "c_index").select("seq_id", "pep", F.col("n").between(3, 12).alias("fits"))
    both = placed.unionByName(r.filtered.withColumn("fits", F.lit(True)))
    return both.groupBy("seq_id", "pep").agg((F.count(F.lit(1)) == 1).alias("once"), F.min("fits").alias("fits"))


@query(f"WITH {_SEQ} SELECT seq_id AS id, true AS better FROM seqs")
def louvain_gain(spark, sf_dir):
    """Communities cover every vertex and have at least the modularity of single vertices."""
    vertices, edges = names(spark, sf_dir).select(F.col("seq_id").alias("id")), _edges(spark, sf_dir)
    of = Workspace(spark, "gain").save(G.louvain_clusters(vertices, edges, 1.05), "of")
    q = lambda members, name: F.broadcast(G.modularity(edges, members, 1.05).select(F.col("modularity").alias(name)))
    return of.join(q(of, "q")).join(q(of.select("id", F.col("id").alias("cluster")), "q0")).select("id", (F.col("q") >= F.col("q0")).alias("better"))


@query(f"{_DENSE}, u AS (SELECT least(r, c) AS src, greatest(r, c) AS dst, max(value) AS a, min(value) AS b, count(*) AS k, sum(value) AS s FROM full_ WHERE r <> c GROUP BY ALL) SELECT src, dst, round(s, 9) AS weight FROM u WHERE s <> 0 UNION ALL SELECT r, c, value FROM full_ WHERE r = c")
def graph_edges_plus(spark, sf_dir):
    """The graph of a matrix whose two cells of a pair are added."""
    seqs = names(spark, sf_dir)
    full = M.mirrored(H.similarity_mh(seqs, 4, 50, native=True, dense=True), "similarity", seqs)
    return G.graph_edges(full, "plus").withColumn("weight", F.round("weight", 9))


@query()
def cluster_report(spark, sf_dir):
    return _clusters(spark, sf_dir).report


def _by_length(spark, sf_dir) -> DataFrame:
    """Peptides in clusters of their length."""
    return peptides(spark, sf_dir).select("seq_id", F.col("sequence").alias("pep"), F.length("sequence").cast("string").alias("c_index"))


@query()
def clusterconsensus(spark, sf_dir):
    return N.cluster_consensus(_by_length(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT replace(replace(replace(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 'J', ''), 'O', ''), 'U', '') AS pep FROM part WHERE p_name IS NOT NULL),
l AS (SELECT length(pep) AS c, k, substr(pep, k, 1) AS letter FROM (SELECT pep, unnest(range(1, length(pep) + 1)) AS k FROM p)), g AS (SELECT c, k, letter, count(*) AS n FROM l GROUP BY ALL),
b AS (SELECT c, k, letter FROM (SELECT *, row_number() OVER (PARTITION BY c, k ORDER BY n DESC, letter) AS r FROM g) WHERE r = 1)
SELECT CAST(c AS VARCHAR) AS cluster_id, string_agg(letter, '' ORDER BY k) AS consensus FROM b GROUP BY c""")
def consensus_majority(spark, sf_dir):
    return N.column_majority(_by_length(spark, sf_dir))


@query()
def consensus_network(spark, sf_dir):
    return N.consensus_network(N.column_majority(_by_length(spark, sf_dir)))[0]


@query()
def heatmap_order(spark, sf_dir):
    seqs = names(spark, sf_dir)
    return M.heatmap_frame(M.mirrored(H.similarity_mh(seqs, 4, 50, native=True, dense=True), "similarity", seqs))


# Relabellings by digests; run 0 keeps the ids
_PERM = """ids_ AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) AS place_ FROM seqs), runs_ AS (SELECT ids_.*, run FROM ids_, range(21) t(run)),
to_ AS (SELECT run, seq_id, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN run = 0 THEN '' ELSE md5('0:' || run || ':' || seq_id) END, place_) AS new FROM runs_),
target_ AS (SELECT to_.run, to_.seq_id, ids_.seq_id AS target FROM to_ JOIN ids_ ON ids_.place_ = to_.new),
moved_ AS (SELECT x.run, least(x.target, y.target) AS i, greatest(x.target, y.target) AS j, b_.similarity AS other FROM b_ JOIN target_ x ON x.seq_id = b_.i JOIN target_ y ON y.seq_id = b_.j AND y.run = x.run)"""
_AFFINE_SIM = f"{_BASE}, d AS ({_DIST.format(n=20)}), a_ AS (SELECT i, j, 1 - distance AS similarity FROM d)"
_SHARE = "SELECT round((SELECT r FROM r_ WHERE run = 0), 9) AS r, round(avg(CAST(r >= (SELECT r FROM r_ WHERE run = 0) - 1e-9 AS INTEGER)), 9) AS p FROM r_"
_LENGTH_SIM = "(SELECT x.seq_id AS i, y.seq_id AS j, -abs(length(x.sequence) - length(y.sequence))::DOUBLE AS similarity FROM seqs x JOIN seqs y ON x.seq_id < y.seq_id)"
_VOWELS = "length(regexp_replace({}.sequence, '[^aeiou]', '', 'g'))"
_VOWEL_SIM = f"(SELECT x.seq_id AS i, y.seq_id AS j, -abs({_VOWELS.format('x')} - {_VOWELS.format('y')})::DOUBLE AS similarity FROM seqs x JOIN seqs y ON x.seq_id < y.seq_id)"


def _alike(seqs: DataFrame, measure) -> DataFrame:
    """(i, j, similarity): minus the difference of a number of each sequence."""
    of = lambda c: seqs.select(F.col("seq_id").alias(c), measure(F.col("sequence")).alias(f"m_{c}"))
    return H.all_pairs(seqs).join(of("i"), "i").join(of("j"), "j").select("i", "j", (-F.abs(F.col("m_i") - F.col("m_j"))).cast("double").alias("similarity"))


def _by_vowels(seqs: DataFrame) -> DataFrame:
    return _alike(seqs, lambda s: F.length(F.regexp_replace(s, "[^aeiou]", "")))


def _affine_similarity(seqs: DataFrame) -> DataFrame:
    return _affine(seqs, 3).dist_matrix.select("i", "j", (1 - F.col("distance")).alias("similarity"))


@query(f"{_AFFINE_SIM}, b_ AS {_LENGTH_SIM}, {_PERM}, r_ AS (SELECT run, corr(a_.similarity, other) AS r FROM a_ JOIN moved_ USING (i, j) GROUP BY run) {_SHARE}")
def mantel(spark, sf_dir):
    seqs = names(spark, sf_dir)
    return A.mantel(_affine_similarity(seqs), _alike(seqs, F.length), seqs, 20).select(F.round("r", 9).alias("r"), F.round("p", 9).alias("p"))


@query(f"""{_AFFINE_SIM}, b_ AS {_LENGTH_SIM}, c_ AS {_VOWEL_SIM}, {_PERM}, q_ AS (SELECT run, corr(a_.similarity, other) AS xy, corr(a_.similarity, c_.similarity) AS xz, corr(other, c_.similarity) AS yz FROM a_ JOIN c_ USING (i, j) JOIN moved_ USING (i, j) GROUP BY run),
r_ AS (SELECT run, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM q_) {_SHARE}""")
def partial_mantel(spark, sf_dir):
    """Similarity against length, with the number of vowels taken out."""
    seqs = names(spark, sf_dir)
    return A.partial_mantel(_affine_similarity(seqs), _alike(seqs, F.length), _by_vowels(seqs), seqs, 20).select(F.round("r", 9).alias("r"), F.round("p", 9).alias("p"))
