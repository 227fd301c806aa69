"""Maximum inner product search by score-aware (anisotropic) product quantisation.

A vector is cut into parts of ``dims`` components, each coded by one of 16 centroids: 4 bits. Codes
and centroids minimise ``|r|^2 + (eta - 1) (r . x)^2 / |x|^2`` for the residual r of a vector x, so
that errors along the vector, which change its large inner products most, weigh eta times. They are
learnt on a bounded sample by coordinate descent: codes part by part, centroids by least squares.

Codes are kept in blocks of rows with the vectors and the lengths of their residuals, queries in blocks
too. For each pair of blocks a table scan adds, for every packed byte, the query's entry of a 256-entry
table (two parts at once). The exact products of the rows that scan best give a bound that the block's
k-th best reaches; every row whose score plus the greatest error its residual allows comes up to it is
ranked by the exact product, so that the scan drops rows but never a neighbour, at any number of blocks.
Equal vectors count as one in the scan; of each, the ids that may be needed are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace, bound_batches, tidied

SAMPLE = 20_000
ROW_BLOCK = 16_384
QUERY_BLOCK = 256
#: Rows of each block whose exact products set the bound for the others.
RERANK_BLOCK = 64
ETA = 4.0


@dataclass
class Quantiser:
    """centroids[part, code]: the 16 centroids of each part."""

    centroids: np.ndarray
    eta: float

    @property
    def parts(self) -> np.ndarray:
        return np.array(self.centroids.shape)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.centroids.shape
        return np.pad(x, ((0, 0), (0, m * d - x.shape[1]))).reshape(len(x), m, d)

    def codes(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (rows, parts) by coordinate descent on the score-aware loss."""
        cut, c = self._cut(x), self.centroids
        n, m, _ = cut.shape
        # |x_m - c|^2 and (x_m - c) . x_m for every row, part and code
        dot = np.einsum("nmd,mkd->nmk", cut, c)
        size = (cut**2).sum(2)
        plain = size[:, :, None] - 2 * dot + (c**2).sum(2)[None]
        along = size[:, :, None] - dot
        code = plain.argmin(2)
        weight = (self.eta - 1) / np.maximum(size.sum(1), 1e-30)
        rows = np.arange(n)
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[rows, j, code[:, j]]
                loss = plain[:, j] + weight[:, None] * (along[:, j] + rest[:, None]) ** 2
                code[:, j] = loss.argmin(1)
                total = rest + along[rows, j, code[:, j]]
        return code.astype(np.uint8)

    def residuals(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Lengths of what the codes leave of each row."""
        near = self.centroids[np.arange(len(self.centroids))[None], code.astype(int)]
        return np.sqrt(((self._cut(x) - near) ** 2).sum((1, 2)))

    def pack(self, code: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return code[:, ::2] | code[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each packed byte adds to a query's approximate score."""
        one = np.einsum("qmd,mkd->qmk", self._cut(q), self.centroids).astype(np.float32)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, 256)


def learn(x: np.ndarray, dims: int = 2, eta: float = ETA, rounds: int = 8, seed: int = 0) -> Quantiser:
    """A quantiser from sample rows; fewer than 16 rows, or none, repeat."""
    rng = np.random.default_rng(seed)
    m = -(-x.shape[1] // dims)
    if not len(x):
        return Quantiser(np.zeros((m, 16, dims)), eta)
    cut = np.pad(x, ((0, 0), (0, m * dims - x.shape[1]))).reshape(len(x), m, dims)
    start = cut[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
    quantiser = Quantiser(start, eta)
    norm = np.maximum((x**2).sum(1), 1e-30)
    for k in range(rounds):
        quantiser.eta = 1.0 if k < 3 else eta  # plain k-means first
        weight = (quantiser.eta - 1) / norm
        code = quantiser.codes(x, sweeps=2 if k >= 3 else 0).astype(int)
        c = quantiser.centroids
        near = c[np.arange(m)[None], code]
        along = ((cut - near) * cut).sum(2)
        total = along.sum(1)
        for j in range(m):
            part, rest = cut[:, j], total - along[:, j]
            lhs = np.zeros((16, dims, dims))
            rhs = np.zeros((16, dims))
            outer = part[:, :, None] * part[:, None, :] * weight[:, None, None] + np.eye(dims)
            np.add.at(lhs, code[:, j], outer)
            np.add.at(rhs, code[:, j], part + weight[:, None] * part * ((part**2).sum(1) + rest)[:, None])
            full = np.bincount(code[:, j], minlength=16) > 0
            c[j][full] = np.linalg.solve(lhs[full], rhs[full][:, :, None])[:, :, 0]
    quantiser.eta = eta
    return quantiser


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def search(rows: DataFrame, query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", rerank_block: int = RERANK_BLOCK, dims: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows by inner product for each row where ``query`` holds.

    Ties go to the smaller vec_id; a query's own vec_id is no candidate. Vectors that are null, zero,
    or hold null or non-finite components take no part, nor do those with another number of
    components than most, or a null vec_id. Repeated vec_ids with one vector count once. An empty
    table gives an empty table.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "neighbours")
    bound_batches(spark)
    all_rows = rows.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    base = all_rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), query.alias("is_query"))
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = work.save(base.where(F.size("v") == lengths.n).withColumn("h", F.xxhash64("v")), "vectors")
    # Equal vectors are one row of the index; a query may need the k + 1 least ids of each
    w = Window.partitionBy("h", "v", "salt").orderBy("vec_id")
    near = base.select("vec_id", "v", "h").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    kept = near.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1)
    ids = kept.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))  # at most 64 (k + 1) ids each
    index = work.save(ids.withColumn("row", F.element_at("ids", 1)), "index")
    sample = index.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    x = np.array(sample.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, lengths.n) if sample.num_rows else np.zeros((0, lengths.n))
    shared = spark.sparkContext.broadcast(learn(x, dims))

    def flat(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, lengths.n)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = flat(part.column(1))
                code = q.codes(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in q.pack(code)], pa.binary()), pa.array(q.residuals(x, code)), part.column(1)], ["row", "code", "rest", "x"])

    def blocks(df: DataFrame, size: int, columns: list[str], key: str, name: str) -> tuple[DataFrame, int]:
        """Rows gathered by hash into blocks of about ``size`` rows, a bounded number each."""
        n = max(1, -(-df.count() // size))
        lists = df.withColumn(key, F.pmod(F.xxhash64(columns[0], F.lit(7)), F.lit(n)).cast("int")).groupBy(key).agg(*(F.collect_list(c).alias(f"{c}s") for c in columns))
        return work.save(lists, name), n

    coded = work.save(index.select("row", "v").mapInArrow(tidied(encode), "row long, code binary, rest double, x array<double>"), "codes")
    row_blocks, n_rows = blocks(coded, ROW_BLOCK, ["row", "code", "rest", "x"], "rb", "row-blocks")
    queries = base.where("is_query").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id", "v"])
    query_blocks, n_queries = blocks(queries, QUERY_BLOCK, ["query_id", "v"], "qb", "query-blocks")
    # Each block meets each. Few row blocks are copied, so that all tasks have work
    copies = max(1, min(n_queries, -(-spark.sparkContext.defaultParallelism // n_rows)))
    left = query_blocks.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).withColumn("copy", F.pmod("qb", F.lit(copies)))
    pairs = left.join(row_blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))), ["rb", "copy"])

    def product(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Component by component, as the last ranking adds."""
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            out += v[d] * x[:, d]
        return out

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for at in range(b.num_rows):
                t = b.slice(at, 1)
                rows_ = t.column(3).flatten().to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(t.column(4).flatten().to_pylist()), np.uint8).reshape(len(rows_), -1).T.copy()
                rest = t.column(5).flatten().to_numpy(zero_copy_only=False)
                x = t.column(6).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(rows_), -1)
                ids_ = t.column(1).flatten().to_numpy(zero_copy_only=False)
                v = t.column(2).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(ids_), -1)
                # What a score may be off: by the residual, and by the rounding of 32-bit sums
                length = np.sqrt((x**2).sum(1))
                off = rest + (codes.shape[0] * 2 + 4) * 2.0**-23 * (length + rest)
                slack = 1e-12 * length.max()  # more than the rounding of products, in any order of addition
                some, need = min(max(rerank_block, k + 1), len(rows_)), min(k + 1, len(rows_))
                for lo in range(0, len(ids_), 16):
                    tables = q.tables(v[lo : lo + 16])
                    score = np.zeros((tables.shape[0], len(rows_)), np.float32)
                    for byte in range(codes.shape[0]):
                        score += tables[:, byte].take(codes[byte], axis=1)
                    best = []
                    for one, s in zip(v[lo : lo + 16], score, strict=True):
                        size = np.sqrt((one**2).sum())
                        may = np.arange(len(rows_))
                        if np.isfinite(slack * size):  # else products may overflow, and all are ranked
                            first = x[np.argpartition(-s, some - 1)[:some]] @ one
                            bound = np.partition(first, some - need)[some - need]
                            may = np.flatnonzero(s + off * size >= bound - slack * size)
                            rough = x[may] @ one
                            may = may[rough >= np.partition(rough, len(may) - need)[len(may) - need] - 2 * slack * size]
                        exact = product(x[may], one)
                        best.append(rows_[may[np.lexsort((rows_[may], -exact))[:need]]])  # ties: the smaller ids
                    yield pa.RecordBatch.from_arrays([pa.array(ids_[lo : lo + 16], pa.int64()), pa.array(list(v[lo : lo + 16]), pa.list_(pa.float64())), pa.array(best, pa.list_(pa.int64()))], ["query_id", "q", "rows"])

    found = pairs.select("rb", "query_ids", "vs", "rows", "codes", "rests", "xs").mapInArrow(tidied(scan), "query_id long, q array<double>, rows array<long>")
    merged = found.select("query_id", "q", F.explode("rows").alias("row"))
    exact = merged.join(index, "row").select("query_id", "ids", F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p).alias("score"))
    members = exact.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    best = members.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
