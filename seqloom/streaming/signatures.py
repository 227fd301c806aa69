"""Signatures of sequences as they arrive: stateless, so the batch operators run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.minhash import native_signatures, signatures


def stream_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (seq_id, sequence) from Parquet files that appear in a folder."""
    return spark.readStream.schema("seq_id long, sequence string").parquet(folder)


def stream_signatures(stream: DataFrame, k: int = 4, n_hash: int = 50, seed: int = 0) -> DataFrame:
    """(seq_id, hash_id, min_hash) of a stream; without Python where k is divisible by 4."""
    return native_signatures(stream, k, n_hash, seed) if k % 4 == 0 else signatures(stream, k, n_hash, seed)
