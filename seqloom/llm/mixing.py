"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources. Documents with one set of sources (a pattern) are alike
for the flow, so the corpus is first summed by pattern. A network routes capacity from patterns to
the quotas of their sources; the k-th repetition of a pattern is an arc of its own, dearer than the
one before (convex costs), so that nothing is repeated while fresh words remain. The flow says how
many words each pattern gives; whole rounds go to all its documents, and the rest of a round goes to
documents in the order of a seeded hash until their words reach it.

Sums by pattern and by hash bucket are all that leaves the executors.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, Workspace

#: Plans of up to this many patterns are broadcast, longer ones are joined by a shuffle.
BROADCAST_PATTERNS = 20_000
#: The first hex digits of the seeded hash are its bucket: 4096 for each pattern.
BUCKET_DIGITS = 3
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """``share`` of all sizes by weight; no target above ``repeats`` times its size, the excess reshared."""
    caps = [float(repeats * s) for s in sizes]
    total, full = min(share * sum(sizes), sum(caps)), [s == 0 for s in sizes]
    while True:
        rest = total - sum(c for c, f in zip(caps, full, strict=True) if f)
        weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        out = [c if f else rest * w / weight for c, w, f in zip(caps, weights, full, strict=True)]
        over = [not f and o >= c for o, c, f in zip(out, caps, full, strict=True)]
        if not any(over):
            return out
        full = [f or o for f, o in zip(full, over, strict=True)]


@dataclass
class _Arc:
    to: int
    left: float
    cost: float
    back: int


def min_cost_flow(patterns: list[tuple[frozenset[int], int]], quotas: list[float], repeats: int = REPEATS) -> list[dict[int, float]]:
    """For each pattern (its sources, its words) the words that each of its sources takes.

    A source whose documents have no other source stands alone and gets its quota at once, so that the
    network holds only what overlaps.

    Successive shortest paths with potentials: source -> pattern (one arc for each repetition, cost
    rising by one) -> source quota -> sink. It fills the quotas as far as the patterns reach, at
    the least total repetition.
    """
    uses = Counter(s for sources, _ in patterns for s in sources)
    alone = [len(x) == 1 and uses[next(iter(x))] == 1 for x, _ in patterns]
    if any(alone):
        rest = iter(min_cost_flow([p for p, a in zip(patterns, alone, strict=True) if not a], quotas, repeats))
        own = lambda s, words: {s: min(quotas[s], float(repeats * words))} if words and quotas[s] else {}
        return [own(next(iter(x)), words) if a else next(rest) for (x, words), a in zip(patterns, alone, strict=True)]
    if not patterns:
        return []
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[_Arc]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: float, cost: float) -> None:
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0.0, -cost, len(graph[a]) - 1))

    for i, (sources, words) in enumerate(patterns):
        for k in range(repeats):
            arc(start, i, float(words), float(k))
        for s in sorted(sources):
            arc(i, n + s, float(repeats * words), 0.0)
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota, 0.0)
    eps = 1e-9 * max([1.0, *quotas])
    height = [0.0] * (n + m + 2)
    while True:
        far, via = [float("inf")] * (n + m + 2), [(-1, -1)] * (n + m + 2)
        far[start], heap = 0.0, [(0.0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for j, e in enumerate(graph[a]):
                if e.left > eps and (x := d + e.cost + height[a] - height[e.to]) < far[e.to] - 1e-12:
                    far[e.to], via[e.to] = x, (a, j)
                    heapq.heappush(heap, (x, e.to))
        if far[end] == float("inf"):
            break
        height = [h + min(f, far[end]) for h, f in zip(height, far, strict=True)]
        path, at = [], end
        while at != start:
            a, j = via[at]
            path.append(graph[a][j])
            at = a
        push = min(e.left for e in path)
        for e in path:
            e.left -= push
            graph[e.to][e.back].left += push
    return [{e.to - n: graph[e.to][e.back].left for e in graph[i] if n <= e.to < n + m and graph[e.to][e.back].left > eps} for i in range(n)]


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0, doc_id: str = "doc_id", text: str = "text", sources: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row, with the columns of ``keep``.

    ``sources`` is an array of source names (default: the column ``source``, one for each document);
    a null or empty array means the null source, which comes last. Sources are sorted by code point
    and weigh as ``weights``, repeating. source_size and target belong to a document's first source. A
    null text has no words and is never taken; sources without words have a target of 0. Rows that are
    alike in every column that counts are told apart by nothing, so which of them is taken is free. Rows
    without a doc_id are ordered by their texts. Columns of ``keep`` must have other names than the
    result's. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    names = F.array_sort(F.array_distinct(F.coalesce(sources if sources is not None else F.array(F.col("source")), F.array(F.lit(None).cast("string")))))
    names = F.when(F.size(names) == 0, F.array(F.lit(None).cast("string"))).otherwise(names)
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null "), F.xxhash64(F.col(text)).cast("string")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), own))
    rows = work.save(docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("size"), names.alias("_names"), order.alias("_order"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("_tie"), *(F.col(c).alias(f"_keep_{c}") for c in keep)), "sizes")
    bucket = F.substring("_order", 1, BUCKET_DIGITS)
    sums = rows.groupBy("_names").agg(F.sum("size").alias("size")).collect()  # a row for each pattern
    found = sorted({x for r in sums for x in r._names}, key=lambda x: (x is None, (x or "").encode()))
    number = {x: i for i, x in enumerate(found)}
    sums.sort(key=lambda r: [number[x] for x in r._names])
    sizes = [0] * len(found)
    for r in sums:
        for x in r._names:
            sizes[number[x]] += r["size"]
    total = sum(r["size"] for r in sums)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * total / max(1, sum(sizes)), repeats)
    flow = min_cost_flow([(frozenset(number[x] for x in r._names), r["size"]) for r in sums], goal, repeats)
    plan = []
    for r, f in zip(sums, flow, strict=True):
        words, first = sum(f.values()), number[r._names[0]]
        whole = min(repeats, int(words // r["size"])) if r["size"] else 0
        plan.append((list(r._names), whole, float(words - whole * r["size"]), sizes[first], float(goal[first])))
    planned = spark.createDataFrame(plan, "_names array<string>, whole long, rest double, source_size long, target double")
    key = F.to_json(F.struct("_names"))  # nulls in the array join as values
    few = (lambda df: F.broadcast(df)) if len(plan) <= BROADCAST_PATTERNS else (lambda df: df)
    planned = few(planned.withColumn("_key", key).drop("_names"))
    # The bucket in which a pattern's rest runs out: sums of 4096 buckets for each pattern
    by_bucket = rows.groupBy(key.alias("_key"), bucket.alias("_bucket")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("_key").orderBy("_bucket")) - F.col("words")
    cut = by_bucket.withColumn("before", before).join(planned, "_key").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    cut = cut.groupBy("_key").agg(F.min_by(F.struct("_bucket", "before"), "_bucket").alias("_cut"))
    rows = rows.withColumn("_key", key).join(planned, "_key").join(few(cut), "_key", "left")
    # Only the cut bucket's documents are put in order; a document counts if at least half of it fits
    inside = F.col("_cut._bucket") == bucket
    in_cut = rows.where(inside).withColumn("_sum", F.sum("size").over(Window.partitionBy("_key").orderBy("_order", "size", "_tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    taken_in = in_cut.withColumn("_more", (F.col("_cut.before") + F.col("_sum") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("_sum")
    out = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("_more", F.coalesce(bucket < F.col("_cut._bucket"), F.lit(False)).cast("long"))
    copies = F.col("whole") + F.col("_more")
    return out.unionByName(taken_in).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"), *(F.col(f"_keep_{c}").alias(c) for c in keep))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


_CYCLE = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END"
OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, crc32t, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, size FROM (
    SELECT doc_id, source, 0 AS crc32t, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents)),
s AS (SELECT source, sum(size) AS size, {_CYCLE} AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0 * size / w AS ratio, sum(size) OVER () AS total FROM s),
c AS (SELECT *, coalesce(sum(2 * size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(w) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST) AS w_from FROM r),
k AS (SELECT *, 1.5::DOUBLE * total - cap_before AS rest, (1.5::DOUBLE * total - cap_before) * w / w_from < 2 * size AS free FROM c),
f AS (SELECT CAST(min(rest) FILTER (free) AS DOUBLE) AS any_rest, arg_min(rest, ratio) FILTER (free) AS rest, arg_min(w_from, ratio) FILTER (free) AS w_from, min(ratio) FILTER (free) AS ratio FROM k),
t AS (SELECT k.source, k.size AS source_size, CASE WHEN k.ratio >= f.ratio THEN CAST(f.rest AS DOUBLE) * k.w / f.w_from ELSE CAST(2 * k.size AS DOUBLE) END AS target FROM k, f),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, floor(target / source_size)) END AS whole FROM t),
o AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
