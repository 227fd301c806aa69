"""Recursive clustering to a range of sizes, level by level.

All parts of one depth are handled together: similarity within each part, its own quantile threshold,
communities, and one routing by size. Calls are numbered afterwards in depth-first order, which is
what cluster names and the budget of calls refer to.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.workspace import Workspace
from .graph import louvain_clusters
from .matrix import sparse_quantile
from .minhash import matches, signatures

log = logging.getLogger(__name__)
#: Depth at which a part that never gets smaller is given up.
MAX_DEPTH = 200


@dataclass
class ClusterResult:
    """clustered: (seq_id, pep, c_index); filtered: (seq_id, pep); report: one row."""

    clustered: DataFrame
    filtered: DataFrame
    report: DataFrame


def minhash_similarity(k: int = 2, n_hash: int = 50, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """A similarity for :func:`clusterbreak`: (part, i, j, similarity) of members (part, seq_id, sequence) at a depth, pairs of zero left out."""

    def of(members: DataFrame, depth: int) -> DataFrame:
        sig = signatures(members, k, n_hash, seed + depth)
        return matches(sig, ("part",)).select("part", "i", "j", (F.col("n") / F.lit(n_hash)).alias("similarity"))

    return of


def clusterbreak(seqs: DataFrame, thresh_p: float = 0.8, size_max: int = 10, size_min: int = 3, max_itr: int = 10000, sim_fn: Callable[[DataFrame, int], DataFrame] | None = None, cluster_fn: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, self_loops: bool = True, gamma: float = 1.05, seed: int = 0, cluster_wt: bool = True) -> ClusterResult:
    """Splits (seq_id, sequence) into clusters of size_min to size_max.

    Smaller ones are filtered, larger ones split again by their own similarities. A cluster's c_index is
    ``<call>.<cluster>``. Parts whose call number exceeds ``max_itr`` are lost from both results, and the
    report says so. A part that stays whole down to a depth of 200 is reported as unsplittable and lost.
    ``cluster_fn(vertices, edges, depth)`` gives (part, id, cluster); without ``cluster_wt`` its edges have no
    weight column. The default clusterer takes weights either way. Each depth is logged.
    """
    if size_max <= size_min:
        raise ValueError("size_max must be greater than size_min")
    if seqs.isEmpty():
        raise ValueError("empty input sequence vector")
    spark, work = seqs.sparkSession, Workspace(seqs.sparkSession, "clusterbreak")
    sim_fn = sim_fn or minhash_similarity(seed=seed)
    frontier = work.save(seqs.select(F.lit(0).cast("long").alias("part"), "seq_id", "sequence"), "level-0")
    children: dict[int, list[int]] = {0: []}
    parts, emitted, dropped, stuck = 1, [], [], 0
    for depth in range(MAX_DEPTH):
        sizes = frontier.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        sims = work.save(sim_fn(frontier, depth), f"pairs-{depth}")
        limit = sparse_quantile(sims, sizes, thresh_p, "part")
        edges = sims.join(limit, "part").where("similarity >= threshold and similarity > 0").select("part", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("similarity").alias("weight"))
        vertices = frontier.select("part", F.col("seq_id").alias("id"))
        if self_loops:
            edges = edges.unionByName(vertices.select("part", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))
        edges = work.save(edges, f"edges-{depth}")
        of = cluster_fn(vertices, edges if cluster_wt else edges.drop("weight"), depth) if cluster_fn else louvain_clusters(vertices, edges, gamma, seed + depth, group="part")
        placed = of.withColumnRenamed("id", "seq_id").join(frontier.select("part", "seq_id", "sequence"), ["part", "seq_id"])
        count = placed.groupBy("part", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("seq_id").alias("first"))
        placed = work.save(placed.join(count, ["part", "cluster"]), f"placed-{depth}")
        emitted.append(placed.where((F.col("n") >= size_min) & (F.col("n") <= size_max)).select("part", "seq_id", F.col("sequence").alias("pep"), "cluster"))
        dropped.append(placed.where(F.col("n") < size_min).select("part", "seq_id", F.col("sequence").alias("pep")))
        again = placed.where(F.col("n") > size_max).select("part", "cluster", "first").distinct().orderBy("part", "first").limit(max(0, max_itr) + 1).collect()  # one row a call, within the budget
        log.info("depth %d: %d parts so far, %d clusters are split again", depth, parts, len(again))
        if not again:
            break
        numbers = []
        for r in again:
            children[r.part].append(parts)
            children[parts] = []
            numbers.append((r.part, r.cluster, parts))
            parts += 1
        named = spark.createDataFrame(numbers, "part long, cluster int, child long")
        frontier = work.save(placed.where(F.col("n") > size_max).withColumn("cluster", F.col("cluster").cast("int")).join(F.broadcast(named), ["part", "cluster"]).select(F.col("child").alias("part"), "seq_id", "sequence"), f"level-{depth + 1}")
    else:
        stuck = len(again)
    call, stack = {}, [0]
    while stack:  # depth first, children in order of appearance
        part = stack.pop()
        call[part] = len(call) + 1
        stack += reversed(children[part])
    ran = [(p, c) for p, c in call.items() if c <= max_itr]
    calls = F.broadcast(spark.createDataFrame(ran, "part long, call int")) if ran else spark.createDataFrame([], "part long, call int")
    if len(ran) < len(call):
        log.warning("the budget of %d calls is used up", max_itr)

    def joined(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.join(calls, "part")

    clustered = joined(emitted).select("seq_id", "pep", F.concat_ws(".", F.col("call").cast("string"), F.col("cluster").cast("int").cast("string")).alias("c_index"))
    filtered = joined(dropped).select("seq_id", "pep")
    report = spark.createDataFrame([(len(ran) == len(call) and not stuck, len(ran), stuck)], "converged boolean, calls int, unsplittable int")
    return ClusterResult(clustered, filtered, report)
