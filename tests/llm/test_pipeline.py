"""The stages of the corpus pipeline, each against a plain computation."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .test_text_operators import slow_groups


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    rows, toxic = [], []
    for i in range(240):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(8, 80))]
        if i % 6 == 0:
            words[3] = "blarg"
        if i % 10 == 7:
            words = rows[-1][1].split() + ["again"]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        toxic.append((i, 1, int("blarg" in words)))
    rows.append((900, None, None, None, None))
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def test_stages(spark, corpus):
    root, rows = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    clean = P.toxicity(spark, docs, root)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {r[0] for r in rows if "blarg" not in (r[1] or "")}
    single = P.near_duplicate(spark, clean, root)
    left = [r for r in rows if r[0] in kept]
    groups = slow_groups([r[1] for r in left], 5, 80, 100)[1]
    assert sorted(r.doc_id for r in single.collect()) == [r[0] for i, r in enumerate(left) if groups[i] == i]
    mixed = P.mixing(spark, single, root)
    assert mixed.columns == docs.columns and {r["count"] for r in mixed.groupBy("doc_id").count().collect()} <= {1, 2}
    packed = P.packing(spark, mixed, root)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert P.run(spark, root).count() == packed.count()


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows, null doc_ids and a doc_id that two texts share."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(7, text("a")), (7, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (3, text("c")), (5, text("c")), (5, text("d")), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in P.near_duplicate(spark, docs, str(tmp_path)).collect()]
    want = [(7, text("a")), (None, text("b")), (3, text("c")), (5, text("d")), (9, None), (9, None), (None, "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_columns_with_clashing_names_stay(spark, corpus):
    root, _ = corpus
    names = ["score", "size", "source_size", "target", "taken", "copies", "document", "time", "row_key", "first", "component_id", "n_shingles", "sequence_id", "a.b"]
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(60)
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, root)
        first = docs.first()
        assert docs.columns[-len(names) :] == names and [first[n] for n in names] == names
    assert P.packing(spark, docs, root).count() > 0


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"] and P.ORACLE_SQL is None


def test_empty_corpus(spark, corpus, tmp_path):
    root, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, root)
    assert docs.count() == 0
