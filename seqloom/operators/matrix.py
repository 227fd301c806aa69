"""Pair tables as matrices: statistics, quantiles, thresholds, distances, heatmap order."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.workspace import Workspace

log = logging.getLogger(__name__)


def mirrored(triangle: DataFrame, value: str, ids: DataFrame | None = None, diagonal: float | None = 1.0) -> DataFrame:
    """(row, col, value) of the whole symmetric matrix from its upper triangle."""
    upper = triangle.select(F.col("i").alias("row"), F.col("j").alias("col"), F.col(value).alias("value"))
    out = upper.unionByName(upper.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    if ids is not None and diagonal is not None:
        out = out.unionByName(ids.select(F.col("seq_id").alias("row"), F.col("seq_id").alias("col"), F.lit(diagonal).alias("value")))
    return out


def wide(matrix: DataFrame, ids: list[int]) -> DataFrame:
    """One column for each of the few ids named."""
    return matrix.groupBy("row").pivot("col", ids).agg(F.first("value"))


def check_matrix(matrix: DataFrame) -> None:
    """Rows (row, col, value) with each cell once; a warning if it isn't symmetric."""
    if {"row", "col", "value"} - set(matrix.columns):
        raise ValueError("Input must be a matrix")
    other = matrix.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("value").alias("other"))
    if not matrix.join(other, ["row", "col"], "left").where("not (value <=> other)").isEmpty():
        log.warning("Input matrix is not symmetric.")


def similarity_stats(matrix: DataFrame, exclude_diagonal: bool = False) -> DataFrame:
    """One row: mean, median, min and max of the strict upper triangle; most and least similar cells.

    The cells are the first by column and then row among the whole matrix, the diagonal included
    unless ``exclude_diagonal``, that hold the triangle's maximum and minimum. A matrix of one row has nulls.
    """
    upper = matrix.where("row < col").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"))
    cells = matrix.where("row <> col") if exclude_diagonal else matrix
    first = lambda bound: F.min_by(F.struct("row", "col"), F.when(F.col("value") == F.col(bound), F.struct("col", "row")))
    found = cells.join(F.broadcast(upper.select("min", "max"))).agg(first("max").alias("most_similar"), first("min").alias("least_similar"))  # one row
    return upper.join(found)


def upper_quantile(triangle: DataFrame, p: float, value: str = "similarity") -> DataFrame:
    """One row: the linearly interpolated quantile of a full triangle."""
    return triangle.agg(F.percentile(value, F.lit(p)).alias("threshold"))


def sparse_quantile(sparse: DataFrame, sizes: DataFrame, p: float, group: str, value: str = "similarity") -> DataFrame:
    """(group, threshold): the exact quantile of each group's triangle, where pairs not in ``sparse`` are zeros.

    ``sizes`` has (group, n). Values are counted first, so that windows hold distinct values only.
    Groups of one member have a null threshold.
    """
    counts = sparse.where(F.col(value) > 0).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(group).orderBy("v"))
    total = F.sum("m").over(Window.partitionBy(group))
    pairs = sizes.select(group, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    cum = counts.withColumn("upto", upto).withColumn("total", total).join(pairs, group)
    zeros = F.col("pairs") - F.col("total")
    h = (F.col("pairs") - 1) * F.lit(p)
    at = lambda k: F.min(F.when(zeros + F.col("upto") > k, F.col("v")))
    both = cum.withColumn("z", zeros).groupBy(group).agg(at(F.floor(h)).alias("lo"), at(F.ceil(h)).alias("hi"), F.first("z").alias("z"))
    out = pairs.join(both, group, "left")
    z = F.coalesce("z", "pairs")
    lo = F.when(F.floor(h) < z, 0.0).otherwise(F.col("lo"))
    hi = F.when(F.ceil(h) < z, 0.0).otherwise(F.col("hi"))
    return out.select(group, F.when(F.col("pairs") > 0, lo + (h - F.floor(h)) * (hi - lo)).alias("threshold"))


def threshold_edges(triangle: DataFrame, threshold: Column, value: str = "similarity") -> DataFrame:
    """(src, dst, weight): entries from the threshold up that aren't zero."""
    return triangle.where((F.col(value) >= threshold) & (F.col(value) > 0)).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col(value).alias("weight"))


def matrix_corr(a: DataFrame, b: DataFrame, value: str = "similarity") -> DataFrame:
    """One row: Pearson's r of two triangles over pairs where both have a value."""
    other = b.select("i", "j", F.col(value).alias("other"))
    return a.join(other, ["i", "j"]).where(F.col(value).isNotNull() & ~F.isnan(value) & F.col("other").isNotNull() & ~F.isnan("other")).agg(F.corr(value, "other").alias("r"))


#: Rows and cells of a block at most, and blocks wanted at least where there are rows enough.
BLOCK_ROWS, BLOCK_CELLS, BLOCKS = 2048, 1 << 20, 16
#: Parts that pairs of blocks are dealt to at most.
MAX_PARTS = 10_000


def euclid_dist(matrix: DataFrame) -> DataFrame:
    """(i, j, distance) with i < j of the matrix's rows, over the columns that both have; null values add nothing."""
    cells = matrix.groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("c")).select("row", "c.col", "c.value")
    return vector_dist(Workspace(matrix.sparkSession, "euclid").save(cells, "rows"))


def vector_dist(rows: DataFrame) -> DataFrame:
    """:func:`euclid_dist` of rows (row, value array), place by place, or (row, col array, value array), by equal ``col``.

    Rows are dealt to blocks by a hash, and a task takes two blocks whole and subtracts them in numpy. So components are never
    joined; memory and work of a task don't grow with the rows, only the number of tasks does.
    """
    rows = rows.withColumn("value", F.col("value").cast("array<double>")).where("row is not null and size(value) > 0")
    n, cells = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("value").cast("long")), F.lit(0))).first()
    size = max(1, min(BLOCK_ROWS, max(BLOCK_ROWS // 8, -(-n // BLOCKS)), BLOCK_CELLS * n // max(1, cells)))
    blocks = max(1, -(-n // size))
    both = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    pair = F.shiftright(hi * (hi + 1), 1) + lo
    dealt = both.select("row", *(c for c in ("col", "value") if c in rows.columns), pair.alias("pair"), (F.col("own") == hi).alias("second"), (lo == hi).alias("same"))
    parts = min(MAX_PARTS, blocks * (blocks + 1) // 2)
    kind = rows.schema["row"].dataType
    out = StructType([StructField("i", kind), StructField("j", kind), StructField("distance", DoubleType())])
    return dealt.repartitionById(parts, (F.col("pair") % parts).cast("int")).sortWithinPartitions("pair").mapInArrow(_distances, out)


def _distances(batches):
    """Distances of each pair of blocks; batches are sorted by pair."""
    held, last = [], None
    for b in batches:
        p = b.column("pair").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(p)) + 1), len(p)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and p[lo] != last:
                yield from _block_distances(pa.Table.from_batches(held))
                held = []
            if hi > lo:
                last = p[lo]
                held.append(b.slice(lo, hi - lo))
    if held:
        yield from _block_distances(pa.Table.from_batches(held))


def _block_distances(t: pa.Table):
    names, value = t.column("row").combine_chunks(), t.column("value").combine_chunks()
    ids = names.unique()
    ids = ids.take(pc.sort_indices(ids))
    length = pc.list_value_length(value).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(t)), length)
    if "col" in t.column_names:
        col = t.column("col").combine_chunks().flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        col = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    flat = value.flatten()
    x, known = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    rank = pc.index_in(names, ids).to_numpy(zero_copy_only=False).astype(np.int64)
    same, second = t.column("same")[0].as_py(), t.column("second").to_numpy()
    sides = []
    for own in [second] if same else [~second, second]:
        use = own[row] & (col >= 0)  # a null column is equal to none
        sides.append(_lines(rank[row[use]], col[use], x[use], known[use]))
    ra, rb = sides[0][0], sides[-1][0]
    square, some, shared = _squares(sides[0], sides[-1])
    for axis, r in enumerate((ra, rb)):
        if len(r) and (np.diff(r) == 0).any():  # cells of one row and column add up, as in a join
            at = np.flatnonzero(np.diff(r, prepend=-1))
            square, some, shared = np.add.reduceat(square, at, axis), np.logical_or.reduceat(some, at, axis), np.logical_or.reduceat(shared, at, axis)
    ra, rb = np.unique(ra)[:, None], np.unique(rb)
    step = max(1, (1 << 18) // max(1, len(rb)))
    for k in range(0, len(ra), step):
        r, at = ra[k : k + step], slice(k, k + step)
        keep = shared[at] & (r < rb) if same else shared[at]
        d, terms = np.sqrt(square[at][keep]), some[at][keep]
        if len(d):
            i, j = (ids.take(pa.array(f(r, rb)[keep])) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([i, j, pa.array(d, mask=None if terms.all() else ~terms)], ["i", "j", "distance"])


def _lines(rank, col, x, known):
    """Rank of each line, ascending, and the cells (line, col, x, known) by column; a line has a column once, so a row may have more."""
    order = np.lexsort((col, rank))
    rank, col, x, known = rank[order], col[order], x[order], known[order]
    at = np.arange(len(rank))
    first = np.ones(len(rank), bool)
    first[1:] = (rank[1:] != rank[:-1]) | (col[1:] != col[:-1])
    again = at - np.maximum.accumulate(np.where(first, at, 0))
    most = again.max(initial=0) + 1
    lines, line = np.unique(rank * most + again, return_inverse=True)
    order = np.argsort(col, kind="stable")
    return lines // most, line[order], col[order], x[order], known[order]


def _squares(a, b, width: int = 64, tile: tuple[int, int] = (128, 512)):
    """Sums of squared differences of lines, where there is a term, and where there is a common column."""
    shape = len(a[0]), len(b[0])
    square, some, shared = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
    cols = np.intersect1d(a[2], b[2])
    with np.errstate(all="ignore"):
        for c in range(0, len(cols), width):
            use = cols[c : c + width]
            (x, px, kx), (y, py, ky) = _dense(a, use), _dense(b, use)
            full = kx.all() and ky.all()
            for i in range(0, shape[0], tile[0]):
                for j in range(0, shape[1], tile[1]):
                    at, u, v = (slice(i, i + tile[0]), slice(j, j + tile[1])), slice(i, i + tile[0]), slice(j, j + tile[1])
                    total = square[at].copy()
                    d = np.empty_like(total)
                    for k in range(len(use)):
                        np.subtract(x[k, u, None], y[k, v], out=d)
                        d *= d
                        if full:
                            total += d
                        else:
                            term = kx[k, u, None] & ky[k, v]
                            np.add(total, d, out=total, where=term)
                            some[at] |= term
                            shared[at] |= px[k, u, None] & py[k, v]
                    square[at] = total
            if full:
                some[:] = shared[:] = True
    return square, some, shared


def _dense(side, use):
    """Values, presence and known values of the columns ``use``, (column, line) each."""
    lines, line, col, x, known = side
    lo, hi = np.searchsorted(col, use[0]), np.searchsorted(col, use[-1], "right")
    at = np.searchsorted(use, col[lo:hi])
    hit = use[at] == col[lo:hi]
    at, line = at[hit], line[lo:hi][hit]
    value, there, has = np.zeros((len(use), len(lines))), np.zeros((len(use), len(lines)), bool), np.zeros((len(use), len(lines)), bool)
    value[at, line], there[at, line], has[at, line] = x[lo:hi][hit], True, known[lo:hi][hit]
    return value, there, has


def complete_linkage_order(distance: np.ndarray) -> list[int]:
    """Leaf order of hierarchical clustering with complete linkage."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    leaves, alive = {i: [i] for i in range(n)}, list(range(n))
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        x, y = divmod(int(sub.argmin()), len(alive))
        a, b = sorted((alive[x], alive[y]))
        far = np.maximum(d[a], d[b])
        d[a], d[:, a] = far, far
        d[a, a] = np.inf
        leaves[a] = (leaves[a] + leaves[b]) if len(leaves[a]) <= len(leaves[b]) else (leaves[b] + leaves[a])
        alive.remove(b)
    return leaves[alive[0]] if alive else []


#: Rows of a matrix that may be drawn; its cells are ordered on the driver.
MAX_HEATMAP = 5000


def heatmap_frame(matrix: DataFrame, cluster: bool = True) -> DataFrame:
    """(row_order, col_order, row, col, value): raw values in drawing order."""
    check_matrix(matrix)
    spark = matrix.sparkSession
    ids = [r.row for r in matrix.select("row").distinct().orderBy("row").limit(MAX_HEATMAP + 1).collect()]
    if len(ids) > MAX_HEATMAP:
        raise ValueError(f"a heatmap of more than {MAX_HEATMAP} rows can't be drawn")
    order = list(range(len(ids)))
    if cluster and len(ids) > 1:
        at = {x: k for k, x in enumerate(ids)}
        d = np.zeros((len(ids), len(ids)))
        t = euclid_dist(matrix).toArrow()  # MAX_HEATMAP^2 / 2 rows of 24 bytes at most
        i, j = (np.array([at[x] for x in t.column(c).to_pylist()], np.int64) for c in ("i", "j"))
        d[i, j] = d[j, i] = t.column("distance").to_numpy()
        order = complete_linkage_order(d)
    place = spark.createDataFrame([(ids[k], n) for n, k in enumerate(order)], "id long, place int")
    row, col = place.select(F.col("id").alias("row"), F.col("place").alias("row_order")), place.select(F.col("id").alias("col"), F.col("place").alias("col_order"))
    return matrix.join(F.broadcast(row), "row").join(F.broadcast(col), "col").select("row_order", "col_order", "row", "col", "value")
