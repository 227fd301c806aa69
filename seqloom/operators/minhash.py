"""MinHash signatures and similarities, affine over a vocabulary or Murmur3 over k-mers.

Pairs are kept as the upper triangle (i < j). Signatures meet in an equi-join on the hash number and
value, so only pairs with a common value are made; what is missing has similarity 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.kmers import affine, seeded_murmur, shingles
from ..plans.workspace import Workspace
from .shingling import create_char_matrix, create_vocab, shingle_table

_MAX = 0xFFFFFFFF


def create_hash_parameters(spark: SparkSession, n_hash: int, max_val: int, seed: int = 0) -> DataFrame:
    """(hash_id, a from 1..max_val, b from 0..max_val), drawn from digests of the seed."""
    if n_hash < 1:
        raise ValueError("Number of hash functions must be positive")
    if max_val < 2:
        raise ValueError("Maximum value must be at least 2")
    draw = lambda name, i, n: int(hashlib.md5(f"{seed}:{name}:{i}".encode()).hexdigest()[:15], 16) % n
    return spark.createDataFrame([(i, 1 + draw("a", i, max_val), draw("b", i, max_val + 1)) for i in range(n_hash)], "hash_id int, a long, b long")


def apply_hash(x, a, b, m):
    """Of columns, or of whole numbers."""
    return (a * x + b) % m if isinstance(x, int) else affine(x, a, b, m)


def compute_signature_matrix(char_matrix: DataFrame, params: list[tuple[int, int]], max_val: int) -> DataFrame:
    """(seq_id, hash_id, min_hash): least (a rank + b) mod max_val of each sequence.

    A sequence's ranks are gathered once (as many as it has shingles); the hashes are array operations.
    Sequences without shingles have no row.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("h"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(params)))
    ranks = char_matrix.groupBy("seq_id").agg(F.collect_set("rank").alias("ranks"))
    least = F.transform(pairs, lambda p: F.struct(p["h"].alias("hash_id"), F.array_min(F.transform("ranks", lambda r: affine(r, p["a"], p["b"], max_val))).alias("min_hash")))
    return ranks.select("seq_id", F.inline(least))


def matches(signatures: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, n) with i < j: in how many hashes two signatures agree, if in any; only inside the groups of ``within``.

    Equal signatures, such as those of texts that are too short, meet as one class and are told apart
    at the end, so that a value which many share isn't joined once for each hash and pair.
    """
    values = signatures.groupBy(*within, "seq_id").agg(F.array_sort(F.collect_list(F.struct("hash_id", "min_hash"))).alias("sig"))
    heads = values.groupBy(*within, "sig").agg(F.min("seq_id").alias("head"))
    members = values.join(heads, [*within, "sig"]).select(*within, "head", "seq_id", F.size("sig").cast("long").alias("n"))
    each = heads.select(*within, "head", F.inline("sig"))
    keys = [*within, "hash_id", "min_hash"]
    left, right = each.withColumnRenamed("head", "a"), each.withColumnRenamed("head", "b")
    near = left.join(right, keys).where("a < b").groupBy(*within, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    of = lambda head, c: members.select(*within, F.col("head").alias(head), F.col("seq_id").alias(c))
    met = near.join(of("a", "x"), [*within, "a"]).join(of("b", "y"), [*within, "b"]).select(*within, "x", "y", "n")
    alike = members.withColumnRenamed("seq_id", "x").join(of("head", "y"), [*within, "head"]).where("x < y").select(*within, "x", "y", "n")
    return met.unionByName(alike).select(*within, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "n")


def all_pairs(ids: DataFrame, diagonal: bool = False) -> DataFrame:
    """(i, j) for every two ids: a matrix's upper triangle, as large as it sounds."""
    i, j = ids.select(F.col("seq_id").alias("i")), ids.select(F.col("seq_id").alias("j"))
    return i.join(j, F.col("i") <= F.col("j") if diagonal else F.col("i") < F.col("j"))


def complete(sparse: DataFrame, ids: DataFrame, value: str, missing: float) -> DataFrame:
    """The triangle with ``missing`` where ``sparse`` has no pair."""
    return all_pairs(ids).join(sparse, ["i", "j"], "left").select("i", "j", F.coalesce(value, F.lit(missing)).alias(value))


def compute_distance_matrix(signatures: DataFrame, n_hash: int, dense: bool = True) -> DataFrame:
    """(i, j, distance): the share of hashes that differ; pairs at distance 1 only if ``dense``."""
    near = matches(signatures).select("i", "j", (1 - F.col("n") / F.lit(n_hash)).alias("distance"))
    return complete(near, signatures.select("seq_id").distinct(), "distance", 1.0) if dense else near


@dataclass
class MinHash:
    """The four results of :func:`minhash`."""

    vocab: DataFrame
    char_matrix: DataFrame
    sig_matrix: DataFrame
    dist_matrix: DataFrame


def minhash(seqs: DataFrame, k: int, n_hash: int, seed: int = 0, params: list[tuple[int, int]] | None = None, modulus: int | None = None) -> MinHash:
    """The affine pipeline. The modulus is the vocabulary's size unless another (a prime) is named."""
    vocab = Workspace(seqs.sparkSession, "minhash").save(create_vocab(seqs, k), "vocab")  # counted and joined: made once
    v = vocab.count()
    m = modulus or v
    if params is None:
        params = [(r.a, r.b) for r in create_hash_parameters(seqs.sparkSession, n_hash, m, seed).orderBy("hash_id").collect()]
    elif m < 2:
        raise ValueError("Maximum value must be at least 2")
    chars = create_char_matrix(seqs, vocab, k)
    signatures = compute_signature_matrix(chars, params, m)
    return MinHash(vocab, chars, signatures, compute_distance_matrix(signatures, len(params)))


def exact_jaccard(seqs: DataFrame, k: int) -> DataFrame:
    """(i, j, similarity) of pairs with a common shingle."""
    sets = shingle_table(seqs, k).select("seq_id", "shingle").distinct()
    sizes = sets.groupBy("seq_id").count()
    left, right = sets.select("shingle", F.col("seq_id").alias("i")), sets.select("shingle", F.col("seq_id").alias("j"))
    common = left.join(right, "shingle").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
    size = lambda s: sizes.select(F.col("seq_id").alias(s), F.col("count").alias(f"n_{s}"))
    return common.join(size("i"), "i").join(size("j"), "j").select("i", "j", (F.col("c") / (F.col("n_i") + F.col("n_j") - F.col("c"))).alias("similarity"))


def murmur3_32(data: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Murmur3 (x86, 32 bits) of each row of an (n, k) array of bytes."""
    mul = lambda x, c: x * np.uint32(c)
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    data = np.ascontiguousarray(data, np.uint8)
    n, k = data.shape
    h = np.broadcast_to(np.asarray(seed, np.uint32), (n,)).copy() if np.ndim(seed) == 0 else np.asarray(seed, np.uint32).copy()
    whole = k // 4 * 4
    for at in range(0, whole, 4):
        block = np.ascontiguousarray(data[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint32)
        h ^= mul(rot(mul(block, 0xCC9E2D51), 15), 0x1B873593)
        h = mul(rot(h, 13), 5) + np.uint32(0xE6546B64)
    if k > whole:
        tail = np.zeros(n, np.uint32)
        for at in range(k - 1, whole - 1, -1):
            tail = (tail << np.uint32(8)) | data[:, at]
        h ^= mul(rot(mul(tail, 0xCC9E2D51), 15), 0x1B873593)
    h ^= np.uint32(k)
    h = mul(h ^ (h >> np.uint32(16)), 0x85EBCA6B)
    h = mul(h ^ (h >> np.uint32(13)), 0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def hash_seeds(n_hash: int, seed: int = 0) -> list[int]:
    """A seeded family of 32-bit seeds."""
    return np.random.default_rng(seed).integers(0, 1 << 32, n_hash, dtype=np.uint64).tolist()


def family_hash(data: bytes, seeds: list[int], index: int) -> int:
    if not 0 <= index < len(seeds):
        raise IndexError("Hash function index out of range")
    return int(murmur3_32(np.frombuffer(data, np.uint8)[None], seeds[index])[0])


def check_mh(k: int, n_hash: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("'k' must be a positive integer")
    if n_hash < 1:
        raise ValueError("Number of hash functions must be positive")


def native_signatures(seqs: DataFrame, k: int, n_hash: int, first: int = 0) -> DataFrame:
    """(seq_id, hash_id, min_hash) without Python, for ASCII texts and k divisible by 4; the i-th seed is ``hash(first + i)``."""
    check_mh(k, n_hash)
    if k % 4:
        raise ValueError("native hashes need a k divisible by 4")
    words = F.array_distinct(shingles(F.col("sequence"), k))
    ids = F.sequence(F.lit(0), F.lit(n_hash - 1))
    least = F.transform(ids, lambda i: F.struct(i.alias("hash_id"), F.coalesce(F.array_min(F.transform(F.col("w"), lambda s: seeded_murmur(s, i + first))), F.lit(_MAX)).alias("min_hash")))
    return seqs.select(*(c for c in seqs.columns if c != "sequence"), words.alias("w")).select(*(c for c in seqs.columns if c != "sequence"), F.inline(least))


def signatures(seqs: DataFrame, k: int, n_hash: int, seed: int = 0, seeds: list[int] | None = None) -> DataFrame:
    """(seq_id, hash_id, min_hash) on byte k-mers for any k; texts shorter than k have the largest value throughout. Columns beside sequence stay."""
    check_mh(k, n_hash)
    family = np.array(seeds if seeds is not None else hash_seeds(n_hash, seed), dtype=np.uint64).astype(np.uint32)
    keep = [c for c in seqs.columns if c != "sequence"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.full((len(f), len(family)), _MAX, np.int64)
            windows = []
            for text in f["sequence"]:
                raw = np.frombuffer((text or "").encode(), np.uint8)
                windows.append(np.lib.stride_tricks.sliding_window_view(raw, k) if len(raw) >= k else np.empty((0, k), np.uint8))
            size = np.array([len(w) for w in windows], np.int64)
            full = np.flatnonzero(size)
            if len(full):  # all sequences of the batch together, hash by hash
                words, start = np.concatenate(windows), (np.cumsum(size) - size)[full]
                for h, s in enumerate(family):
                    out[full, h] = np.minimum.reduceat(murmur3_32(words, int(s)), start)
            yield f[keep].assign(sig=list(out))

    from pyspark.sql.types import ArrayType, LongType, StructType

    schema = StructType([seqs.schema[c] for c in keep]).add("sig", ArrayType(LongType()))
    return seqs.mapInPandas(run, schema).select(*keep, F.posexplode("sig").alias("hash_id", "min_hash"))


def similarity_mh(seqs: DataFrame, k: int = 4, n_hash: int = 50, seed: int = 0, dense: bool = False, native: bool = False) -> DataFrame:
    """(i, j, similarity): the share of equal minima; pairs of similarity 0 only if ``dense``."""
    check_mh(k, n_hash)
    if seqs.isEmpty():
        raise ValueError("Input sequences vector cannot be empty")
    sig = native_signatures(seqs, k, n_hash, seed) if native else signatures(seqs, k, n_hash, seed)
    near = matches(sig).select("i", "j", (F.col("n") / F.lit(n_hash)).alias("similarity"))
    return complete(near, seqs.select("seq_id"), "similarity", 0.0) if dense else near


def permutation_minhash(char_matrix: DataFrame, n_perm: int, seed: int = 0) -> DataFrame:
    """(seq_id, perm, first): the place of the first row a sequence has, in seeded random orders of the vocabulary's rows."""
    perms = char_matrix.select("rank").distinct().select("rank", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    places = perms.withColumn("place", F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "perm", "rank")))))
    return char_matrix.join(places, "rank").groupBy("seq_id", "perm").agg(F.min("place").alias("first"))
