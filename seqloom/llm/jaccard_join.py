"""Jaccard join of word shingles by parity sketches.

A document is the set of its distinct shingles, hashed to 64 bits. Its sketch deals the shingles to p
blocks and keeps the XOR of the hashes of each block: a shingle in one set and not in the other
changes one block, so that the number of differing blocks, like the Hamming distance of a 512-bit
parity sketch, is at most the symmetric difference of the sets. Sets of a <= b shingles with a
similarity of t or more differ in at most a (1 - t) / t shingles. In a size band with that bound T, a
sketch of p = T + s blocks has s blocks at least in common with any partner. By the prefix principle,
it is enough to join on the T + 1 blocks that come first in an order all documents share; the order
puts blocks of many shingles first, so that empty blocks and those of one frequent shingle drop out
and no link is lost.

Equal sets are one class from the start. A key that several classes share belongs to its least class.
First each class is verified against the least class it meets most often, which contracts groups of near
copies with one pair a class. What is left are keys whose classes lie in different components. Their
classes are gathered, once for each least class, with their whole sets; there each pair of different
components is tested, first by the Hamming distance of parity sketches whose width fits the band, then
on the whole sets, and only links that join two components leave the task: fewer than it has classes. So
every pair that shares a key is linked, known to be connected, or refuted, and components are exact.
Large gatherings are dealt out: the component of the greatest part in blocks that each meet all others.

Sets are compared by 64-bit hashes of shingles; words aren't compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, bound_batches, partitions, release, tidied
from .components import connected

#: Ids up to this many are broadcast (16 bytes each), more are shuffled.
BROADCAST_ROWS = 500_000
#: Hashes of the sets that one side of a gathering may hold; larger ones are dealt out by pairs of blocks.
BLOCK_HASHES = 2_000_000
#: What a member counts besides its hashes.
ROW_HASHES = 256
#: Members up to which a gathering's pairs are verified without sketches.
FEW = 4

_M = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: a polynomial over its bytes, from prefix sums."""
    raw = np.frombuffer(data, np.uint8)
    if not raw.size:
        return np.empty(0, np.uint64)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    up, down = _powers(raw.size + 1)
    total = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up[: raw.size], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def shingle_set(data: bytes, k: int, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the shingles of k words; of all words, if there are fewer than k."""
    words = word_hashes(data)
    if not words.size:
        return words
    k = min(k, words.size)
    out = np.full(words.size - k + 1, mix(np.array([seed * 64 + k], np.uint64))[0], np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_BASE) + words[j : j + len(out)])
    return np.unique(out)


def bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, bound T) of the size bands in which a set of n meets partners of num/den at least.

    Band i starts at the size starts[i]; in it the smaller set's size lies below starts[i + 1].
    """
    least = -(-n * num // den)
    out, lo, i = [], 1, 0
    while lo <= n:
        hi = max(lo + 1, lo * den // num)
        if least < hi:
            out.append((i, (hi - 1) * (den - num) // num))
        lo, i = hi, i + 1
    return out


def block_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The join keys of a set: for each band the T + 1 first of its sketch's blocks."""
    out = []
    for band, bound in bands(len(shingles), num, den):
        if not bound:  # only equal sets link, and these are one class
            continue
        blocks = bound + 2 + bound // 4
        at = ((mix(shingles) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=blocks)
        xor = np.zeros(blocks, np.uint64)
        full = np.flatnonzero(count)
        xor[full] = np.bitwise_xor.reduceat(shingles[order], (np.cumsum(count) - count)[full])
        key = mix(xor + np.uint64(band * _BASE & _M) ^ mix(np.arange(1, blocks + 1, dtype=np.uint64) + np.uint64(blocks << 32)))
        out.append(key[np.lexsort((key, -count))[: bound + 1]])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def parity(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """(sets, bits / 64): bit b of a set's sketch is the parity of its hashes that fall on b."""
    out = np.empty((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.uint64)
    return out


def class_id(shingles: np.ndarray) -> int:
    """A 63-bit hash of a set."""
    x = int(np.bitwise_xor.reduce(shingles)) ^ int(shingles.sum(dtype=np.uint64)) * _BASE
    return int(mix(np.array([(x + len(shingles)) & _M], np.uint64))[0]) >> 1


def check_id(shingles: np.ndarray) -> int:
    return int(mix(shingles).sum(dtype=np.uint64) & np.uint64(_M >> 1))


def sketches(docs: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """doc_id, n, cid, sum, keys; a task gives the keys of a class once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                out: tuple[list, ...] = ([], [], [], [])
                for data in part.column(1).to_pylist():
                    s = shingle_set(data or b"", k, seed)
                    if not len(s):
                        row = (0, None, None, None)
                    else:
                        c = class_id(s)
                        new = c not in seen
                        row = (len(s), c, check_id(s), block_keys(s, num, den).view(np.int64) if new else None)
                        seen.add(c)
                        if len(seen) > 300_000:
                            seen.clear()
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["doc_id", "n", "cid", "sum", "keys"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, cid long, sum long, keys array<long>")


def sets_of(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """cid, n, items (the sorted 64-bit hashes) of documents with shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                sets = [s for data in b.slice(lo, 500).column(1).to_pylist() if len(s := shingle_set(data or b"", k, seed))]
                yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "n", "items"])

    return docs.mapInArrow(tidied(run), "cid long, n long, items binary")


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, cid) sorted by both: key, cid, least cid of the key, for keys of two classes or more."""
    last_key, first, last, told = None, 0, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        key, cid = b.column(0).to_numpy(), b.column(1).to_numpy()
        new_key = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([last_key is None or cid[0] != last], cid[1:] != cid[:-1]))
        start = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), -1))
        least = np.where(start >= 0, cid[np.maximum(start, 0)], first)
        more = new & ~new_key  # a further class of its key
        head = np.zeros(len(key), bool)
        head[start[more & (start >= 0)]] = True
        carried = bool((more & (start < 0)).any()) and not told
        k, c, m = key[more | head], cid[more | head], least[more | head]
        if carried:
            k, c, m = np.append(last_key, k), np.append(first, c), np.append(first, m)
        told = (told or carried) if start[-1] < 0 else bool(head[start[-1]])
        last_key, last, first = key[-1], cid[-1], least[-1]
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(m, pa.int64())], ["key", "cid", "least"])


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity num/den."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(both) - common)


def spanning(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of components that links join, one less for each component joined.

    If ``side`` has two values, only pairs across are tested, else all.
    """
    n = np.array([len(s) for s in sets], np.int64)
    label, cross = comp.copy(), bool((side != side[0]).any())
    values, count = np.unique(label, return_counts=True)
    if len(values) < 2:
        return []
    odd = np.flatnonzero(label != values[count.argmax()]) if not cross else np.flatnonzero(side == side.max())
    place = np.full(len(sets), len(sets))  # pairs of two odd rows are tested once
    place[odd] = np.arange(len(odd))
    sketch = None
    if len(sets) > FEW:
        bits = 512
        while bits < 8 * n.max() * (den - num) // num:
            bits *= 2
        sketch = parity(sets, bits)
    out = []
    for at in odd.tolist():
        ok = (place > place[at]) & (label != label[at]) & (np.minimum(n, n[at]) * den >= np.maximum(n, n[at]) * num)
        if cross:
            ok &= side != side[at]
        may = np.flatnonzero(ok)
        if sketch is not None and len(may):  # Hamming distance <= symmetric difference <= what a link allows
            far = np.bitwise_count(sketch[may] ^ sketch[at]).sum(1, dtype=np.int64)
            near = far * (num + den) <= (n[may] + n[at]) * (den - num)
            may = may[near][far[near].argsort(kind="stable")]
        for other in may.tolist():
            if label[other] != label[at] and linked(sets[at], sets[other], num, den):
                out.append((int(comp[at]), int(comp[other])))
                label[label == label[other]] = label[at]
    return out


def _gathered(num: int, den: int):
    """Of rows (least, gi, gj, side, comp, items) sorted by the first three: pairs (a, b) of components that links join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        sets: list[np.ndarray] = []
        comp: list[int] = []
        side: list[int] = []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(sets) > 1:
                found.extend(spanning(sets, np.array(comp), np.array(side), num, den))
            sets.clear(), comp.clear(), side.clear()

        for b in batches:
            for *key, s, c, x in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5), strict=True):
                if key != last:
                    close()
                    last = key
                sets.append(np.frombuffer(x.as_py(), np.uint64))
                comp.append(c)
                side.append(s)
            if found:
                a, c = zip(*found, strict=True)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])
        close()
        if found:
            a, c = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def gather(shared: DataFrame, root: DataFrame, classes: DataFrame, work: Workspace) -> DataFrame:
    """least, gi, gj, side, comp, cid: the classes of keys that lie in different components, dealt out in blocks."""
    comp = root.select(F.col("id").alias("cid"), "root")
    rows = shared.join(comp, "cid", "left").withColumn("comp", F.coalesce("root", "cid")).select("key", "cid", "least", "comp")
    odd = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    members = work.save(rows.join(odd, "key", "left_semi").select("least", "cid", "comp").distinct().join(classes.select("cid", "n"), "cid"), "members")
    parts = members.groupBy("least", "comp").agg(F.sum(F.col("n") + ROW_HASHES).alias("w")).groupBy("least").agg(F.max_by("comp", F.struct("w", "comp")).alias("major"), F.max("w").alias("wm"), F.sum("w").alias("all"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / BLOCK_HASHES)).cast("int")
    parts = parts.where(F.col("all") > BLOCK_HASHES).select("least", "major", blocks(F.col("wm")).alias("mb"), blocks(F.col("all") - F.col("wm")).alias("sb"))
    large = members.join(parts, "least")
    block = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    major = large.where("comp = major").withColumn("gi", block("mb")).withColumn("gj", F.explode(F.sequence(F.lit(0), F.col("sb") - 1))).withColumn("side", F.lit(0))
    others = large.where("comp <> major").withColumn("j", block("sb")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("mb") + F.col("sb") - 1)))
    pair = F.col("x") - F.col("mb")
    meets = F.col("x") < F.col("mb")
    others = others.withColumn("gi", F.when(meets, F.col("x")).otherwise(F.col("mb") + F.least(pair, "j"))).withColumn("gj", F.when(meets, F.col("j")).otherwise(F.greatest(pair, "j")))
    others = others.withColumn("side", F.when(meets, F.lit(1)).otherwise(F.col("j")))
    small = members.join(parts, "least", "left_anti").select("least", F.lit(0).alias("gi"), F.lit(0).alias("gj"), F.lit(0).alias("side"), "comp", "cid")
    cols = ["least", "gi", "gj", "side", "comp", "cid"]
    return small.unionByName(major.select(*cols)).unionByName(others.select(*cols))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach num/den, on whole sets of 64-bit hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(t.column(2), t.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sets.select(F.col("cid").alias(s), F.col("items").alias(f"items_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(tidied(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Two documents link when den * |common shingles| >= num * |all shingles|; component_id is the least
    doc_id that links reach. Words are runs without blanks, A-Z lower-cased; a text of fewer than
    ``words`` words has one shingle, its whole sequence. Null and empty texts have no shingle, link with
    nothing and keep their own doc_id. A null doc_id takes part but names no component unless all of
    its members are null. Repeated rows are copies. An empty table gives an empty table.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "jaccard")
    bound_batches(spark, 16)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("data"))
    for seed in range(9):  # classes are told apart by 63 bits; two of one hash are found by a second one
        rows = work.save(sketches(source, words, num, den, seed), f"sketches-{seed}")
        classes = work.save(rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sum").alias("lo"), F.max("sum").alias("hi")), f"classes-{seed}")
        if classes.where("lo <> hi").isEmpty():
            break
    else:
        raise RuntimeError("classes of different sets share a hash under nine seeds")
    classes = classes.drop("lo", "hi")
    keys = rows.where("keys is not null").select(F.explode("keys").alias("key"), "cid")
    shared = work.save(keys.repartition(partitions(spark, rows), "key").sortWithinPartitions("key", "cid").mapInArrow(tidied(_shared), "key long, cid long, least long"), "shared")
    rows = work.save(rows.select("doc_id", "n", "cid"), "rows")
    work.drop(f"sketches-{seed}")
    release(spark)
    met = work.save(shared.groupBy("cid").agg(F.lit(1).alias("one")).select("cid").join(classes.select("cid", "doc_id"), "cid"), "met")
    few = met.count() <= BROADCAST_ROWS
    wanted = met.select(F.col("doc_id").alias("_id"))
    texts = source.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = sets_of(texts, words, seed)
    ids = met.select("cid")
    sets = work.save(found.join(F.broadcast(ids) if few else ids, "cid", "left_semi").dropDuplicates(["cid"]), "sets")
    hub = shared.where("cid <> least").groupBy("cid", "least").count().groupBy("cid").agg(F.max_by("least", F.struct("count", -F.col("least"))).alias("a"))
    links = work.save(verified(hub.select("a", F.col("cid").alias("b")), sets, num, den), "links-0")
    root = connected(links, work, "cc-0")
    release(spark)
    dealt = gather(shared, root, classes, work).join(sets.select("cid", "items"), "cid").select("least", "gi", "gj", "side", "comp", "items")
    dealt = dealt.repartition(partitions(spark), "least", "gi", "gj").sortWithinPartitions("least", "gi", "gj")
    joined = connected(work.save(dealt.mapInArrow(tidied(_gathered(num, den)), "a long, b long"), "joined"), work, "cc-1")
    work.drop("shared", "met", "sets", "links-0", "members", "joined")
    named = classes.select("cid", "doc_id").join(root.select(F.col("id").alias("cid"), F.col("root").alias("first")), "cid", "left").withColumn("first", F.coalesce("first", "cid"))
    named = named.join(joined.select(F.col("id").alias("first"), "root"), "first", "left").withColumn("root", F.coalesce("root", "first"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("cid", "component_id")
    out = rows.select("doc_id", "n", "cid").join(of_class, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, num=85, den=100)
