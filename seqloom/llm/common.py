"""Shared-folder tables, batch limits and small helpers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words: blank and the five ASCII control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (as in tests) may go without that setting and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as pyarrow reads it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def bound_batches(spark: SparkSession, mb: int = 8) -> None:
    """Limits the bytes of one Arrow batch sent to Python, unless the session limits them already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) <= mb << 20:
            return
    except Exception:  # an unset or textual value
        pass
    spark.conf.set(key, str(mb << 20))


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back when it ends: workers live on, and free lists of many stages would add up."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return task


class Workspace:
    """Tables of one run below the shared folder. A saved table cuts the lineage and outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(df, name)

    def load(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets shuffle files of plans that nothing refers to any more go; Spark drops them when the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of a stored table for each partition of a shuffle.
PARTITION_BYTES = 256 << 20


def partitions(spark: SparkSession, table: DataFrame | None = None) -> int:
    """spark.sql.shuffle.partitions, or as many as the bytes of a stored table need if these are more."""
    out = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if table is None or not table.inputFiles():
        return out
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(out, -(-size // PARTITION_BYTES)) if size < 1 << 60 else out  # more: not known
