"""Graphs of similarities: components, modularity, Louvain communities.

Edges are (src, dst, weight) with src <= dst, each once; loops count twice in a degree. Communities
never join components, so Louvain runs for each component by itself, with the whole graph's weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.workspace import Workspace
from ..sources.sequences import ranked


#: Edges up to which one task finds all components; more are contracted round by round.
FEW_EDGES = 200_000


def _least_reached(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, reached) of the ends of edges (src, dst), by union-find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s, d = top(up.setdefault(s, s)), top(up.setdefault(d, d))
            up[max(s, d)] = min(s, d)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["id", "reached"])


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reached.

    Up to 200,000 different edges one task joins them. Beyond that least neighbours become parents,
    parents are followed by doubling, and components contract.
    """
    work = Workspace(vertices.sparkSession, "components")
    label = vertices.select("id", F.col("id").alias("component"))
    live, k = work.save(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "edges"), 0
    if live.count() <= FEW_EDGES:
        of = live.coalesce(1).mapInArrow(_least_reached, "id long, reached long")
        return label.join(of, "id", "left").select("id", F.coalesce("reached", "component").alias("component"))
    while not live.isEmpty():
        both = live.union(live.select("dst", "src"))
        up = work.save(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("up")), f"up-{k}-0")
        j = 0
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            j += 1
            next_ = work.save(up.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), f"up-{k}-{j}")
            up = next_.select("id", "up")
            if next_.where("moved").isEmpty():
                break
        label = work.save(label.join(up.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), f"label-{k}")
        end = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"new_{c}"))
        live = work.save(live.join(end("src"), "src").join(end("dst"), "dst").where("new_src <> new_dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst")).distinct(), f"edges-{k}")
        k += 1
    return label


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: sum over clusters of L/m - gamma (d/2m)^2 for membership (id, cluster)."""
    of = lambda c: membership.select(F.col("id").alias(c), F.col("cluster").alias(f"c_{c}"))
    e = edges.join(of("src"), "src").join(of("dst"), "dst")
    inside = e.where("c_src = c_dst").groupBy(F.col("c_src").alias("c")).agg(F.sum("weight").alias("l"))
    ends = e.select(F.col("c_src").alias("c"), "weight").unionByName(e.select(F.col("c_dst").alias("c"), "weight"))
    degree = ends.groupBy("c").agg(F.sum("weight").alias("d"))
    m = edges.agg(F.sum("weight").alias("m"))
    parts = degree.join(inside, "c", "left").join(F.broadcast(m))  # one row
    return parts.agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - gamma * F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def louvain(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, gamma: float, seed: int, m: float | None = None) -> np.ndarray:
    """Communities 0.. of nodes 0..n-1 by local moves and aggregation; node order from ``seed``."""
    rng = np.random.default_rng(seed)
    total = float(weight.sum()) if m is None else m
    final = np.arange(n)
    if total <= 0:
        return final
    links: list[dict[int, float]] = [{} for _ in range(n)]
    loops = np.zeros(n)
    for s, d, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        if s == d:
            loops[s] += w
        else:
            links[s][d] = links[s].get(d, 0.0) + w
            links[d][s] = links[d].get(s, 0.0) + w
    while True:
        size = len(links)
        degree = np.array([sum(x.values()) for x in links]) + 2 * loops
        of, sums, moved_once, moved = list(range(size)), degree.tolist(), False, True
        while moved:
            moved = False
            for v in rng.permutation(size).tolist():
                home, near = of[v], {}
                for u, w in links[v].items():
                    near[of[u]] = near.get(of[u], 0.0) + w
                sums[home] -= degree[v]
                best, best_gain = home, near.get(home, 0.0) - gamma * degree[v] * sums[home] / (2 * total)
                for c, w in near.items():
                    gain = w - gamma * degree[v] * sums[c] / (2 * total)
                    if gain > best_gain + 1e-12:
                        best, best_gain = c, gain
                sums[best] += degree[v]
                if best != home:
                    of[v], moved, moved_once = best, True, True
        if not moved_once:
            return np.unique(final, return_inverse=True)[1]
        number = {c: k for k, c in enumerate(dict.fromkeys(of))}
        of_new = np.array([number[c] for c in of])
        final = of_new[final]
        next_links: list[dict[int, float]] = [{} for _ in number]
        next_loops = np.zeros(len(number))
        np.add.at(next_loops, of_new, loops)
        for v, x in enumerate(links):
            for u, w in x.items():
                a, b = of_new[v], of_new[u]
                if a == b:
                    next_loops[a] += w / 2
                else:
                    next_links[a][b] = next_links[a].get(b, 0.0) + w
        links, loops = next_links, next_loops


def louvain_clusters(vertices: DataFrame, edges: DataFrame, gamma: float = 1.05, seed: int = 0, group: str | None = None, weighted: bool = True) -> DataFrame:
    """(id, cluster) with clusters 1.. in order of first appearance (least id); with ``group``, (group, id, cluster) by group.

    A task holds one component. Vertices without edges are clusters of their own.
    """
    keys = [group] if group else []
    e = edges if weighted else edges.withColumn("weight", F.lit(1.0))
    component = connected_components(vertices, edges).withColumnRenamed("id", "src")
    joined = e.join(component, "src")
    if group:
        totals = e.groupBy(group).agg(F.sum("weight").alias("m"))
        joined = joined.join(totals, group)
    else:
        joined = joined.join(F.broadcast(e.agg(F.sum("weight").alias("m"))))  # one row

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((f["src"], f["dst"])))
        of = louvain(len(ids), np.searchsorted(ids, f["src"]), np.searchsorted(ids, f["dst"]), f["weight"].to_numpy(float), gamma, seed, float(f["m"].iloc[0]))
        first = pd.Series(ids).groupby(of).transform("min")
        return pd.DataFrame({"id": ids, "head": first.to_numpy()})

    found = joined.groupBy("component").applyInPandas(run, "id long, head long")
    all_ = vertices.select("id", *keys).join(found, "id", "left").withColumn("head", F.coalesce("head", "id"))
    heads = all_.select(*keys, "head").distinct()
    if group:
        numbered = heads.withColumn("cluster", F.row_number().over(Window.partitionBy(group).orderBy("head")))  # a row for each cluster of a group
    else:
        numbered = ranked(heads, "head", "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return all_.join(numbered, [*keys, "head"]).select(*keys, "id", "cluster")


def graph_edges(matrix: DataFrame, mode: str = "upper") -> DataFrame:
    """(src, dst, weight), src <= dst, of a square matrix (row, col, value); cells of zero are no edges.

    ``upper`` and ``lower`` read one triangle with the diagonal, ``max`` (or ``undirected``), ``min`` and
    ``plus`` join both cells of a pair; a cell that is missing is zero.
    """
    cells = matrix.select(F.least("row", "col").alias("src"), F.greatest("row", "col").alias("dst"), F.col("value").cast("double").alias("weight"), (F.col("row") <= F.col("col")).alias("upper"))
    if mode in ("upper", "lower"):
        cells = cells.where(F.col("upper") if mode == "upper" else ~F.col("upper") | (F.col("src") == F.col("dst")))
    elif mode in ("max", "undirected", "min", "plus"):
        one = F.max(F.when(F.col("upper"), F.col("weight"))), F.max(F.when(~F.col("upper"), F.col("weight")))
        a, b = F.coalesce(one[0], F.lit(0.0)), F.coalesce(one[1], F.lit(0.0))
        both = {"min": F.least(a, b), "plus": a + b}.get(mode, F.greatest(a, b))
        cells = cells.groupBy("src", "dst").agg(F.when(F.col("src") == F.col("dst"), a).otherwise(both).alias("weight"))
    else:
        raise ValueError(f"mode must be upper, lower, max, undirected, min or plus, not {mode}; communities need undirected graphs")
    return cells.where("weight <> 0").select("src", "dst", "weight")


def netcluster(matrix: DataFrame, cluster_fn: Callable[[DataFrame, DataFrame], DataFrame] | None = None, mode: str = "upper", graph_weight: bool = True, cluster_weight: bool = True, gamma: float = 1.05, seed: int = 0) -> DataFrame:
    """(id, cluster) of a square matrix (row, col, value); ``mode`` as of :func:`graph_edges`, diagonal cells as loops.

    Without ``graph_weight`` all edges weigh 1. Without ``cluster_weight`` a ``cluster_fn`` gets edges that
    have no weight column; the default clusterer takes the graph's weights either way.
    """
    rows, cols = matrix.select("row").distinct(), matrix.select(F.col("col").alias("row")).distinct()
    if not rows.exceptAll(cols).isEmpty() or not cols.exceptAll(rows).isEmpty():
        raise ValueError("Input must be a square pairwise similarity matrix")
    vertices = rows.select(F.col("row").alias("id"))
    edges = graph_edges(matrix, mode)
    if not graph_weight:
        edges = edges.withColumn("weight", F.lit(1.0))
    out = cluster_fn(vertices, edges if cluster_weight else edges.drop("weight")) if cluster_fn else louvain_clusters(vertices, edges, gamma, seed)
    kinds = dict(out.dtypes)
    if set(kinds) != {"id", "cluster"} or kinds["cluster"] not in ("int", "bigint", "smallint", "tinyint", "double", "float"):
        raise ValueError("Wrong clustering output format. A numeric cluster for each id is needed")
    return out


def grid_modularity(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, modularity) for (run, gamma, id, cluster)."""
    of = lambda c: runs.select("run", F.col("id").alias(c), F.col("cluster").alias(f"c_{c}"))
    e = edges.join(of("src"), "src").join(of("dst"), ["run", "dst"])
    inside = e.where("c_src = c_dst").groupBy("run", F.col("c_src").alias("c")).agg(F.sum("weight").alias("l"))
    ends = e.select("run", F.col("c_src").alias("c"), "weight").unionByName(e.select("run", F.col("c_dst").alias("c"), "weight"))
    degree = ends.groupBy("run", "c").agg(F.sum("weight").alias("d"))
    m = F.broadcast(edges.agg(F.sum("weight").alias("m")))  # one row
    gamma = runs.groupBy("run").agg(F.first("gamma").alias("gamma"))
    parts = degree.join(inside, ["run", "c"], "left").join(F.broadcast(gamma), "run").join(m)
    return parts.groupBy("run").agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.col("gamma") * F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def louvain_mod(vertices: DataFrame, edges: DataFrame, res: float, res_range_perc: float = 0.0, res_step: float = 0.0, itr: int = 3, seed: int = 0, mode: str = "reference") -> DataFrame:
    """One row (resolution, modularity, membership array of (id, cluster)) from a grid of resolutions and restarts.

    ``mode="reference"``: the best restart of the last resolution, with the last resolution at which a
    later restart was strictly better than those before, else the first. ``mode="best"``: the best of all.
    All runs of the grid are one job, a task for each component and run.
    """
    if res_range_perc and res_step <= 0:
        raise ValueError("res_step must be positive if there is a range")
    steps = int(np.floor(2 * res * res_range_perc / res_step + 1e-10)) + 1 if res_range_perc else 1
    grid = [(j * itr + i, res * (1 - res_range_perc) + j * res_step) for j in range(steps) for i in range(itr)]
    runs = F.explode(F.array(*(F.struct(F.lit(r).alias("run"), F.lit(float(g)).alias("gamma")) for r, g in grid))).alias("x")
    component = connected_components(vertices, edges).withColumnRenamed("id", "src")
    total = F.broadcast(edges.agg(F.sum("weight").alias("m")))  # one row
    jobs = edges.join(component, "src").join(total).select("*", runs).select("component", "src", "dst", "weight", "m", "x.run", "x.gamma")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((f["src"], f["dst"])))
        run = int(f["run"].iloc[0])
        of = louvain(len(ids), np.searchsorted(ids, f["src"]), np.searchsorted(ids, f["dst"]), f["weight"].to_numpy(float), float(f["gamma"].iloc[0]), seed + run, float(f["m"].iloc[0]))
        return pd.DataFrame({"run": run, "id": ids, "cluster": pd.Series(ids).groupby(of).transform("min").to_numpy()})

    found = jobs.groupBy("component", "run").applyInPandas(one, "run int, id long, cluster long")
    all_ = vertices.select("id", runs).select("id", "x.run", "x.gamma").join(found, ["run", "id"], "left").withColumn("cluster", F.coalesce("cluster", "id"))
    all_ = Workspace(vertices.sparkSession, "louvain").save(all_, "runs")
    q = {r.run: r.modularity for r in grid_modularity(edges, all_).collect()}
    if mode == "best":
        run = max(q, key=lambda r: (q[r], -r))
        gamma = grid[run][1]
    else:
        gamma, run = grid[0][1], 0
        for r, g in grid:
            if r % itr == 0 or q[r] > q[run]:
                gamma = g if r % itr else gamma
                run = r
    heads = all_.where(F.col("run") == run)
    number = ranked(heads.select("cluster").distinct(), "cluster", "number").withColumn("number", F.col("number").cast("int"))
    members = heads.join(number, "cluster").agg(F.array_sort(F.collect_list(F.struct("id", F.col("number").alias("cluster")))).alias("membership"))
    return members.select(F.lit(float(gamma)).alias("resolution"), F.lit(q.get(run)).cast("double").alias("modularity"), "membership")
