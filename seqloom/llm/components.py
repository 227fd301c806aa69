"""Connected components of a link table by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Workspace


def connected(links: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(id, root) for every id in ``links`` (a, b); root is the least id that links reach.

    Each round gives every component the least neighbour as its parent, follows parents to their
    roots by pointer doubling and contracts; a round at least halves the components that still have
    links. Nulls and loops are ignored; an empty table gives an empty table.
    """
    ends = links.where("a is not null and b is not null").select("a", "b")
    edges = work.save(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    label = work.save(ends.select("a").union(ends.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("root")), f"{name}-label-0")
    k = 0
    while not edges.isEmpty():
        k += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = work.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("up")), f"{name}-up-{k}-0")
        j = 0
        while True:
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            jumped = work.save(parent.join(above, "up").select("id", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")), f"{name}-up-{k}-{j + 1}")
            work.drop(f"{name}-up-{k}-{j}")
            moved, parent, j = not jumped.where("moved").isEmpty(), jumped.select("id", "up"), j + 1
            if not moved:
                break
        up = parent.select(F.col("id").alias("root"), "up")
        new = label.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        label = work.save(new, f"{name}-label-{k}")
        at = lambda side: parent.select(F.col("id").alias(side), F.col("up").alias(f"new_{side}"))
        left = edges.join(at("a"), "a").join(at("b"), "b").where("new_a <> new_b")
        edges = work.save(left.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), f"{name}-edges-{k}")
        work.drop(f"{name}-label-{k - 1}", f"{name}-edges-{k - 1}", f"{name}-up-{k}-{j}")
    return label
