"""Relational steps around clusterings: sampling, contingency, agreement, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.workspace import Workspace
from ..sources.sequences import ranked


def split_field(df: DataFrame, column: str, sep: str, field: int, parts: int, name: str) -> DataFrame:
    """The ``field``-th (from 1) of ``parts`` pieces at a literal separator; an empty text where there is none."""
    return df.withColumn(name, F.coalesce(F.get(F.split(column, F.lit("\\Q" + sep + "\\E"), parts), F.lit(field - 1)), F.lit("")))


def keep_first(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row of each key by a total order."""
    keys, by = ([x] if isinstance(x, str) else x for x in (key, order))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def stratified_sample(df: DataFrame, group: str, fraction: float, order: Column) -> DataFrame:
    """round(fraction * n) rows of each group, the first by ``order`` (such as a seeded hash of the key)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_n", n).withColumn("_at", at).where(F.col("_at") <= F.round(F.lit(fraction) * F.col("_n"))).drop("_n", "_at")


#: Rows of one key in a chunk, about, and rows of the result for each part.
CHUNK_ROWS, PART_ROWS = 2048, 1 << 22
#: Parts of a join at most.
MAX_PARTS = 10_000


def fanout_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The left join by ``key`` where many rows meet many: tasks are dealt by rows of the result, not by key or bytes.

    Each key's rows are cut into chunks on both sides, by their places in the inputs, which should be read from files; every
    chunk meets every chunk of the other side. So a task makes about ``PART_ROWS`` rows, and their number grows with the result.
    """
    count = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    sizes = Workspace(left.sparkSession, "fanout").save(count(left, "_l").join(count(right, "_r"), key), "sizes")
    made = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    parts = int(min(MAX_PARTS, max(1, -(-made // PART_ROWS), left.count() // PART_ROWS)))
    chunks = lambda n: F.ceil(F.col(n) / CHUNK_ROWS)
    of = sizes.select(F.col(key).alias("_key"), chunks("_l").alias("_nl"), chunks("_r").alias("_nr"))

    def dealt(df, how, own, n_own, other, n_other):
        df = df.withColumn("_row", F.monotonically_increasing_id()).join(of, F.col(key) == F.col("_key"), how)
        at = F.coalesce(F.pmod(F.xxhash64("_row"), F.col(n_own)), F.lit(0))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n_other), F.lit(1)) - 1))
        return df.withColumn(own, at).withColumn(other, every)

    a = dealt(left, "left", "_cl", "_nl", "_cr", "_nr").withColumn("_alone", F.col("_key").isNull()).drop("_key", "_nl", "_nr")
    # rows without a partner are spread by their places
    a = a.withColumn("_cl", F.when(F.col("_alone"), F.col("_row")).otherwise(F.col("_cl"))).drop("_row")
    b = dealt(right, "inner", "_cr", "_nr", "_cl", "_nl").drop("_key", "_nl", "_nr", "_row").withColumn("_met", F.lit(True))
    on = [key, "_cl", "_cr"]
    if parts > 1:  # a number given is kept, where inputs of few bytes would be put into one task
        a, b = a.repartition(parts, *on), b.repartition(parts, *on)
    both = a.join(b.hint("shuffle_hash"), on, "left")
    return both.where("_alone or _met").drop("_cl", "_cr", "_alone", "_met")  # a chunk may be empty


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def percent_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """``pct`` of the grand total, which is one row."""
    return counts.join(F.broadcast(counts.agg(F.sum(n).alias("_all")))).withColumn("pct", F.col(n) / F.col("_all") * 100).drop("_all")


def choose2(x: Column) -> Column:
    return x * (x - 1) / 2


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari``; null where it is undefined."""
    n = contingency(df, a, b)
    both = n.agg(F.sum(choose2(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    side = lambda c, name: n.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(choose2(F.col("m"))).alias(name))
    t = both.join(side(a, "a")).join(side(b, "b"))  # one row each
    expected = F.try_divide(F.col("a") * F.col("b"), choose2(F.col("n")))
    return t.select(F.try_divide(F.col("ab") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("ari"))


def normalized_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``nmi``: I / sqrt(H H), in nats."""
    n = contingency(df, a, b)
    total = F.broadcast(n.agg(F.sum("n").alias("t")))
    na, nb = n.groupBy(a).agg(F.sum("n").alias("na")), n.groupBy(b).agg(F.sum("n").alias("nb"))
    info = n.join(na, a).join(nb, b).join(total).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("i"))
    entropy = lambda x, c, name: x.join(total).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(name))
    t = info.join(entropy(na, "na", "ha")).join(entropy(nb, "nb", "hb"))
    return t.select(F.try_divide(F.col("i"), F.sqrt(F.col("ha") * F.col("hb"))).alias("nmi"))


def confusion_percent(df: DataFrame, a: str, b: str, truth: str | None = None) -> DataFrame:
    """(a, b, n, pct) by pair, and by ``b`` alone with ``truth`` (or null) in ``a``: the second is the first's roll-up."""
    cells = percent_of_total(contingency(df, a, b))
    rolled = cells.groupBy(b).agg(F.sum("n").alias("n"), F.sum("pct").alias("pct")).withColumn(a, F.lit(truth).cast(df.schema[a].dataType))
    return cells.unionByName(rolled)


def replicates(df: DataFrame, group: str, fraction: float, key: str, n: int, seed: int, measures: dict[str, Column]) -> DataFrame:
    """(run, measures ...) of ``n`` stratified samples, all in one job.

    Each run keeps round(fraction * size) rows of each group, the first by a digest of seed, run and key.
    """
    runs = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "run", key))
    at = F.row_number().over(Window.partitionBy("run", group).orderBy(order, key))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    kept = runs.withColumn("_at", at).join(F.broadcast(sizes), group).where(F.col("_at") <= F.round(F.lit(fraction) * F.col("_n")))
    return kept.groupBy("run").agg(*(c.alias(name) for name, c in measures.items()))


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def mean_sd(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and ends of each group, ready to be drawn."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(group).agg(F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(value).alias("max"))


def _relabelled(b: DataFrame, ids: DataFrame, n_perm: int, seed: int, value: str) -> DataFrame:
    """(run, i, j, other): ``b`` as it is (run 0) and under seeded relabellings of its ids."""
    numbered = ranked(ids.select("seq_id"), "seq_id", "at")
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))
    new = F.row_number().over(Window.partitionBy("run").orderBy(F.when(F.col("run") == 0, F.lit("")).otherwise(F.md5(F.concat_ws(":", F.lit(str(seed)), "run", "seq_id"))), "at"))
    to = runs.withColumn("new", new).join(numbered.select(F.col("at").alias("new"), F.col("seq_id").alias("target")), "new").select("run", F.col("seq_id"), "target")
    side = lambda c: to.select("run", F.col("seq_id").alias(c), F.col("target").alias(f"t_{c}"))
    return b.join(side("i"), "i").join(side("j"), ["run", "j"]).select("run", F.least("t_i", "t_j").alias("i"), F.greatest("t_i", "t_j").alias("j"), F.col(value).alias("other"))


def _share(r: DataFrame) -> DataFrame:
    """One row (r, p) of (run, r)."""
    first = F.broadcast(r.where("run = 0").select(F.col("r").alias("r0")))
    return r.join(first).agg(F.first("r0").alias("r"), F.avg((F.col("r") >= F.col("r0") - 1e-12).cast("double")).alias("p"))


def mantel(a: DataFrame, b: DataFrame, ids: DataFrame, n_perm: int = 99, seed: int = 0, value: str = "similarity") -> DataFrame:
    """One row (r, p): the share of seeded relabellings of ``b`` whose correlation with ``a`` is as large at least."""
    moved = _relabelled(b, ids, n_perm, seed, value)
    return _share(a.join(moved, ["i", "j"]).groupBy("run").agg(F.corr(value, "other").alias("r")))


def partial_mantel(a: DataFrame, b: DataFrame, c: DataFrame, ids: DataFrame, n_perm: int = 99, seed: int = 0, value: str = "similarity") -> DataFrame:
    """One row (r, p): like :func:`mantel`, for the correlation of ``a`` and ``b`` with that of both to ``c`` taken out."""
    moved = _relabelled(b, ids, n_perm, seed, value)
    t = a.select("i", "j", F.col(value).alias("x")).join(c.select("i", "j", F.col(value).alias("z")), ["i", "j"]).join(moved, ["i", "j"])
    r = t.groupBy("run").agg(F.corr("x", "other").alias("xy"), F.corr("x", "z").alias("xz"), F.corr("other", "z").alias("yz"))
    return _share(r.select("run", ((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("r")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
