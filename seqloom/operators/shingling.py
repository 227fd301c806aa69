"""Shingles, vocabulary and characteristic matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.kmers import shingles
from ..sources.sequences import ranked


def shingle(x: str, k: int) -> list[str]:
    """The shingles of one string."""
    if not isinstance(x, str):
        raise ValueError("Input 'x' must be a single character string")
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= len(x):
        raise ValueError(f"'k' must be a positive integer between 1 and {len(x)}")
    return [x[i : i + k] for i in range(len(x) - k + 1)]


def check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("'k' must be a positive integer")


def shingle_table(seqs: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """(seq_id, pos from 1, shingle)."""
    check_k(k)
    return seqs.select("seq_id", F.posexplode(shingles(F.col("sequence"), k, strict)).alias("pos", "shingle")).withColumn("pos", F.col("pos") + 1)


def create_vocab(seqs: DataFrame, k: int) -> DataFrame:
    """(shingle, rank from 1): the distinct shingles in binary order."""
    return ranked(shingle_table(seqs, k).select("shingle").distinct(), "shingle", "rank").select("shingle", F.col("rank").cast("long").alias("rank"))


def create_char_matrix(seqs: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(seq_id, rank) where a sequence has a shingle; shingles outside the vocabulary are left out."""
    return shingle_table(seqs, k).select("seq_id", "shingle").distinct().join(vocab, "shingle").select("seq_id", "rank")


def dense_char_matrix(seqs: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(rank, seq_id, present): a 0 or 1 for each word of the vocabulary and sequence. As large as it sounds."""
    cells = vocab.select("rank").crossJoin(seqs.select("seq_id"))
    ones = create_char_matrix(seqs, vocab, k).withColumn("present", F.lit(1))
    return cells.join(ones, ["rank", "seq_id"], "left").select("rank", "seq_id", F.coalesce("present", F.lit(0)).alias("present"))


def wide_char_matrix(seqs: DataFrame, vocab: DataFrame, k: int, ids: list[int]) -> DataFrame:
    """One column for each of the few sequences named."""
    return dense_char_matrix(seqs.where(F.col("seq_id").isin(ids)), vocab, k).groupBy("rank").pivot("seq_id", ids).agg(F.max("present"))


def shingle_union(seqs: DataFrame, k: int, first: int, second: int) -> DataFrame:
    """(shingle, in_first, in_second): the sorted union of two sequences' shingles, one-hot."""
    both = shingle_table(seqs.where(F.col("seq_id").isin([first, second])), k)
    has = lambda i: F.max((F.col("seq_id") == i).cast("int"))
    return both.groupBy("shingle").agg(has(first).alias("in_first"), has(second).alias("in_second"))
