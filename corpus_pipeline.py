"""A corpus from documents: no toxic ones, one of each near-duplicate group, sources mixed, sequences packed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.common import Workspace, shared_dir
from seqloom.llm.jaccard_join import BROADCAST_ROWS, near_duplicates
from seqloom.llm.mixing import mix
from seqloom.llm.packing import pack_documents
from seqloom.llm.toxicity import THRESHOLD, score_texts, train


def _free(docs: DataFrame, name: str) -> str:
    """The name, or one like it that is no column yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.7 or more, by a model of all labels.

    Null and empty texts are scored like any other; null doc_ids have no label; repeated rows fare alike.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score = _free(docs, "score")
    return score_texts(docs, model, score).where(F.col(score) < THRESHOLD).select(*_columns(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by 0.8 of five-word shingles: the least doc_id's, nulls last; of several, any.

    Rows are told apart by a key of their own, so that repeated, shared and null doc_ids do no harm. Rows
    without shingles (null and blank texts) stay.
    """
    row = _free(docs, "row_key")
    keyed = Workspace(spark, "pipeline-rows").save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(keyed, doc_id=row).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    ids = keyed.select(row, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("first"))
    kept = groups.join(ids, row).groupBy("component_id").agg(F.min("first")["row"].alias(row)).select(row)
    gone = Workspace(spark, "pipeline-gone").save(groups.select(row).join(kept, row, "left_anti"), "gone")
    small = gone.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and blank texts have no words and aren't taken."""
    mixed = mix(docs.select("doc_id", "text", "source", F.struct(*_columns(docs)).alias("document")), keep=("document",))
    times = mixed.where("copies > 0").select("document", F.explode(F.sequence(F.lit(1), "copies")).alias("time"))
    return times.select(*(F.col(f"document.`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; each copy of a document is packed for itself."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate), ("mixing", mixing), ("packing", packing)]
#: SQL can't express the learnt classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
