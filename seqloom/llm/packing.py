"""Best-fit packing of token sequences, bulk-synchronous.

Documents and the gaps of open sequences are tables. In each round both are range-sorted by size
together, a document before a gap of its size. A sweep over each range matches documents with the gaps that
follow them, like brackets: each gap takes the greatest document below it that no smaller gap has
taken, which is what best fit gives if documents come longest first. What a range leaves over, gaps
without a document and above them documents without a gap, is matched over the ranges by the same
rule; only the number of both in each range goes to the driver, and ranks within a range settle which
document gets which gap. Then gaps shrink and the next round begins, until nothing fits. The longest
documents left open new sequences, as many as the tokens left need at least, and rounds go on. The few
that find no gap then are packed among themselves, block by block. Documents come in bands of lengths,
long ones first, as in best-fit decreasing.

Short documents enter a round in bundles, so that the rounds don't grow with the number of documents in
a sequence; bundles that find no gap are dissolved into smaller ones, at last into single documents.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from .common import Workspace, bound_batches, partitions, tidied
from .tokens import default_path, encoder

TOKENIZER = "word_bpe_49k.json"
#: Rows of one range at most; smaller tables are cut finer.
RANGE_ROWS = 500_000
#: Documents that a task packs among themselves at the end of a band.
CLOSING_ROWS = 20_000
_LISTS = "ats array<long>, ns array<long>, rel array<long>"


def cut_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty; with an ``end_id`` every document has an id at least. Without one an
    empty document has no piece. Repeated and null doc_ids stay rows of their own.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in (batch.slice(lo, 250) for batch in batches for lo in range(0, batch.num_rows, 250)):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, raw in zip(ids, coder.encode([t or "" for t in texts]), strict=True):
                raw += tail
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, x in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def brackets(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order, documents (true) and gaps: matched pairs, each gap with the last document before it that is free."""
    height = np.cumsum(np.where(doc, 1, -1))
    low = np.minimum(np.minimum.accumulate(height), 0) if len(doc) else height
    free = ~doc & (low < np.concatenate(([0], low[:-1])))  # gaps without a document
    level = height - low + ~doc
    at = np.flatnonzero(~free)
    at = at[np.argsort(level[at], kind="stable")]  # in each level documents and gaps take turns
    pair = doc[at[:-1]] & ~doc[at[1:]] & (level[at[:-1]] == level[at[1:]])
    return at[:-1][pair], at[1:][pair]


def across(docs: list[int], gaps: list[int]) -> list[tuple[int, bool, int, int, int, int]]:
    """The brackets between ranges, from the documents and gaps that each has left: runs (range, whether of documents, first and end index, number of the first match, step)."""
    runs, stack, number = [], [], 0
    for p, (d, g) in enumerate(zip(docs, gaps, strict=True)):
        lo = 0
        while lo < g and stack:
            q, left = stack.pop()
            n = min(left, g - lo)
            runs.append((q, True, left - n, left, number + n - 1, -1))
            runs.append((p, False, lo, lo + n, number, 1))
            lo, number = lo + n, number + n
            if left > n:
                stack.append((q, left - n))
        if d:
            stack.append((p, d))
    return runs


def bundled(docs: DataFrame, most: int) -> DataFrame:
    """Of rows (at, n): bundles (id, size, ats, ns, rel) of about ``most`` tokens of documents of half that at most, all others alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(n, kind="stable")
            at, n = at[order], n[order]
            small = int(np.searchsorted(n, most // 2, side="right"))
            group = np.concatenate((np.cumsum(n[:small]) // max(1, most), np.arange(len(n) - small) + (1 << 62)))
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(n) else np.empty(0, np.int64)
            ends = np.append(first, len(n)).astype(np.int32)
            size = np.add.reduceat(n, first) if len(n) else n
            rel = np.cumsum(n) - n
            rel -= np.repeat(rel[first], np.diff(ends))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at, n, rel)]
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(size), *lists], ["id", "size", "ats", "ns", "rel"])

    return docs.select("at", "n").mapInArrow(tidied(run), f"id long, size long, {_LISTS}")


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (size, gap, id, ats, ns, rel, part) of one range, sorted: state 0 a match, 1 a gap left, 2 a document left; idx counts what is left."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    size, ids = t.column("size").to_numpy(), t.column("id").to_numpy()
    doc = ~t.column("gap").to_numpy().astype(bool)
    d, g = brackets(doc)
    free = np.ones(len(doc), bool)
    free[d] = free[g] = False
    gaps, docs = np.flatnonzero(free & ~doc), np.flatnonzero(free & doc)
    part = t.column("part")[0].as_py()
    for state, room, rows in ((0, size[g], d), (1, size[gaps], gaps), (2, size[docs], docs)):
        for lo in range(0, len(rows), 20_000):
            at = rows[lo : lo + 20_000]
            one = lambda x, kind: pa.array(np.full(len(at), x), kind)  # noqa: B023, E731
            seq = ids[g[lo : lo + 20_000]] if state == 0 else ids[at]
            lists = [t.column(c).take(pa.array(at)).combine_chunks() for c in ("ats", "ns", "rel")]
            yield pa.RecordBatch.from_arrays([one(state, pa.int32()), one(part, pa.int32()), pa.array(np.arange(lo, lo + len(at))), pa.array(seq), pa.array(room[lo : lo + 20_000]), pa.array(size[at]), *lists], ["state", "part", "idx", "id", "room", "size", "ats", "ns", "rel"])


def _best_fit(capacity: int):
    """Best-fit decreasing of the documents (at, n) of one task, as sequences of their own; the gap of a sequence stands in one of its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        at, n = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in (0, 1))
        order = np.lexsort((at, -n))
        gaps: list[tuple[int, int, int]] = []  # gap, sequence, its last row
        seq, start, room = ([0] * len(at) for _ in range(3))
        for row, (x, size) in enumerate(zip(at[order].tolist(), n[order].tolist())):
            i = bisect.bisect_left(gaps, (size, -1, -1))
            gap, seq[row], last = gaps.pop(i) if i < len(gaps) else (capacity, x, -1)
            if last >= 0:
                room[last] = 0
            start[row], room[row] = capacity - gap, gap - size
            if gap > size:
                bisect.insort(gaps, (gap - size, seq[row], row))
        ones = pa.array(np.arange(len(at) + 1, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ones, pa.array(x)) for x in (at[order], np.zeros(len(at), np.int64))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (seq, start, room)), *lists], ["sequence_id", "start", "room", "ats", "rel"])

    return run


def _placed(rows: DataFrame, capacity: int) -> DataFrame:
    """Matches (id, room, size) as sequence_id, start, what is left, and the documents' lists."""
    return rows.select(F.col("id").alias("sequence_id"), (F.lit(capacity) - F.col("room")).alias("start"), (F.col("room") - F.col("size")).alias("room"), "ats", "rel")


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def placements(docs: DataFrame, capacity: int, work: Workspace) -> DataFrame:
    """at, sequence_id, offset of documents (at, n), where at is a key and n is 1 to ``capacity``."""
    spark = docs.sparkSession
    full = docs.where(F.col("n") == capacity).select("at", F.col("at").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    gaps: DataFrame | None = None
    placed: list[DataFrame] = [full]
    n_gaps = k = 0
    high = capacity - 1
    while high:
        low = (high + 1) // 4 if high > capacity // 64 else 0
        band = docs.where(F.col("n").between(low + 1, high))
        gaps, n_gaps, k = _place_band(band, low, gaps, n_gaps, placed, capacity, work, k)
        high = low
    out = placed[0]
    for h in placed[1:]:
        members = h.select("sequence_id", "start", F.explode(F.arrays_zip("ats", "rel")).alias("x"))
        out = out.unionByName(members.select(F.col("x.ats").alias("at"), "sequence_id", (F.col("start") + F.col("x.rel")).alias("offset")))
    return out


def _place_band(docs: DataFrame, low: int, gaps: DataFrame | None, n_gaps: int, placed: list[DataFrame], capacity: int, work: Workspace, k: int) -> tuple[DataFrame | None, int, int]:
    """Rounds until all documents of a band of lengths over ``low`` have their places, which are added to ``placed``; the gaps, their number, and the number of rounds so far."""
    spark = docs.sparkSession
    widest = capacity // 2 if low < capacity // 4 else 1
    bundle = widest
    left = work.save(bundled(docs, bundle), f"band-{low}")
    rows = left.count()
    idle: list[DataFrame] = []  # gaps too small for this band
    least, opening, opened_once = low + 1, gaps is None, False
    keys = ["size", "gap", "id"]
    while rows:
        k += 1
        if opening and opened_once:  # what found no gap again: packed among itself
            single = left.select(F.explode(F.arrays_zip("ats", "ns")).alias("x")).select(F.col("x.ats").alias("at"), F.col("x.ns").alias("n"))
            few = single.repartition(max(1, rows // CLOSING_ROWS)).mapInArrow(tidied(_best_fit(capacity)), "sequence_id long, start long, room long, ats array<long>, rel array<long>")
            last = work.save(few, f"closed-{k}")
            placed.append(last)
            free = last.select("sequence_id", "room")
            gaps = free if gaps is None else gaps.unionByName(free)
            break
        both = left.select("size", F.lit(False).alias("gap"), "id", "ats", "ns", "rel")
        if not opening:
            none = [F.lit(None).cast("array<long>").alias(c) for c in ("ats", "ns", "rel")]
            idle.append(gaps.where(F.col("room").between(1, least - 1)))
            both = both.unionByName(gaps.where(F.col("room") >= least).select(F.col("room").alias("size"), F.lit(True).alias("gap"), F.col("sequence_id").alias("id"), *none))
        ranges = max(min(partitions(spark), -(-(rows + n_gaps) // (RANGE_ROWS // 5))), -(-(rows + n_gaps) // RANGE_ROWS))
        dealt = both.repartitionByRange(ranges, *keys) if ranges > 1 else both.coalesce(1)
        sorted_ = dealt.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
        swept = sorted_.mapInArrow(tidied(_sweep), f"state int, part int, idx long, id long, room long, size long, {_LISTS}")
        files = max(ranges, spark.sparkContext.defaultParallelism)
        swept = work.save(swept.coalesce(files), f"swept-{k}")
        found = swept.groupBy("part", "state").agg(F.count(F.lit(1)).alias("m"), F.min(F.array_min("ns")).alias("least"), F.sum("size").alias("sum"), F.max(F.when(F.col("state") == 0, F.col("room") - F.col("size")).otherwise(F.col("room"))).alias("room")).collect()  # three rows a range
        counts = [[0, 0, 0] for _ in range(max(r.part for r in found) + 1)]
        for r in found:
            counts[r.part][r.state] = r.m
        rest = swept.where("state = 2")
        least = min((r.least for r in found if r.state == 2), default=capacity)
        before = bundle
        if opening:  # the longest, as many as the tokens need at least
            needed, opened_once = max(1, sum(r["sum"] for r in found) // capacity), True
            above, table = 0, []
            for p in range(len(counts) - 1, -1, -1):
                above += counts[p][2]
                table.append((p, above - 1))
            ranked = rest.join(_small(spark, table, "part int, top long"), "part").withColumn("rank", F.col("top") - F.col("idx"))
            now = [_placed(ranked.where(F.col("rank") < needed).withColumn("room", F.lit(capacity).cast("long")), capacity)]
            rest, free = ranked.where(F.col("rank") >= needed), gaps
            opened = min(needed, rows)
            rows, n_gaps, opening, bundle = rows - opened, n_gaps + opened, False, widest
        else:
            runs = across([c[2] for c in counts], [c[1] for c in counts])
            taken: dict[tuple[int, int], int] = {}
            for p, is_doc, lo, hi, _, _ in runs:
                taken[p, 2 if is_doc else 1] = taken.get((p, 2 if is_doc else 1), 0) + hi - lo
            crossed = sum(n for (_, state), n in taken.items() if state == 2)
            now = [_placed(swept.where("state = 0"), capacity)]
            spare = swept.where("state = 1")
            if crossed:
                r = _small(spark, [(p, 2 if is_doc else 1, *x) for p, is_doc, *x in runs], "run_part int, run_state int, lo long, hi long, first long, step long")
                of = swept.join(r, (F.col("part") == F.col("run_part")) & (F.col("state") == F.col("run_state")) & (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
                of = of.withColumn("number", F.col("first") + F.col("step") * (F.col("idx") - F.col("lo")))
                cross = of.where("state = 2").select("number", "size", "ats", "ns", "rel").join(of.where("state = 1").select("number", "id", "room"), "number")
                now.append(_placed(work.save(cross.select("id", "room", "size", "ats", "ns", "rel").coalesce(files), f"cross-{k}"), capacity))
                # Runs take the greatest documents of a range and its smallest gaps
                ends = _small(spark, [(p, state, n if state == 1 else counts[p][2] - n) for (p, state), n in taken.items()], "part int, state int, end long")
                alone = swept.where("state > 0").join(ends, ["part", "state"], "left")
                rest = alone.where("state = 2 and (end is null or idx < end)")
                spare = alone.where("state = 1 and (end is null or idx >= end)")
            hits = sum(c[0] for c in counts) + crossed
            free = spare.select(F.col("id").alias("sequence_id"), "room")
            rows, n_gaps = sum(c[2] for c in counts) - crossed, sum(c[0] + c[1] for c in counts)
            if max((r.room for r in found if r.state < 2), default=0) < least:
                opening = True
            elif hits * 2 < rows:
                if bundle > 1:
                    bundle = bundle // 4 if bundle // 8 > low else bundle // 2 if bundle // 4 > low else 1
                else:
                    opening = True
        placed += now
        for h in now:
            h = h.select("sequence_id", "room")
            free = h if free is None else free.unionByName(h)
        gaps = free
        left = rest.select("id", "size", "ats", "ns", "rel")
        if bundle != before and rows:
            single = left.select(F.explode(F.arrays_zip("ats", "ns")).alias("x")).select(F.col("x.ats").alias("at"), F.col("x.ns").alias("n"))
            left = work.save(bundled(single, bundle), f"bundles-{k}")
            rows = left.count()
    if gaps is not None:
        for h in idle:
            gaps = gaps.unionByName(h)
        gaps = work.save(gaps.where("room > 0"), f"gaps-{low}")
        n_gaps = gaps.count()
    return gaps, n_gaps, k


def best_fit_pack(pieces: DataFrame, capacity: int, work: Workspace, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset; lengths are 1 to ``capacity``, else (null, too) a ValueError is raised.

    Repeated rows are rows of their own; which of two pieces of one length comes first is free. Columns
    sequence_id and offset of ``pieces`` are replaced. An empty table gives an empty table.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keyed = work.save(pieces.select(*kept, F.monotonically_increasing_id().alias("_at")), "keyed")
    if not keyed.where(F.coalesce(~F.col(length).between(1, capacity), F.lit(True))).isEmpty():
        raise ValueError(f"a length doesn't fit a capacity of {capacity}")
    found = placements(keyed.select(F.col("_at").alias("at"), F.col(length).cast("long").alias("n")), capacity, work)
    return keyed.join(found.withColumnRenamed("at", "_at"), "_at").select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """Tokenizes, cuts and packs documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    work = Workspace(docs.sparkSession, "packing")
    return best_fit_pack(cut_documents(docs, path or default_path(TOKENIZER), capacity, end_id), capacity, work)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
