"""Queries against DuckDB where the driver's tables are at hand."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
OWN = {k for k in entry.queries() if k in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(canonical(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rest_stands_alone():
    """Nothing outside the llm folders imports them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/seqloom/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "llm" not in open(path).read(), path


def test_fasta(spark, tmp_path):
    from seqloom.sources.sequences import read_fasta

    (tmp_path / "b.fa").write_text(">a\nGGG\n>a\nACD\n>a\nACD\n")  # records of one name stay
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path / "b.fa")).orderBy("seq_id").collect()] == [(1, "a", "ACD"), (2, "a", "ACD"), (3, "a", "GGG")]
    (tmp_path / "a.fa").write_text(">one x\nACD\nEF\n>two\nGG\n")
    assert [tuple(r) for r in read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_id").collect()] == [(1, "one x", "ACDEF"), (2, "two", "GG")]


def test_ranked(spark):
    from seqloom.sources.sequences import ranked

    rows = [(None,), ("b",), ("a",), ("b",), ("",), ("ab",)]
    got = ranked(spark.createDataFrame(rows, "x string"), "x", "n").orderBy("n").collect()
    assert [(r.x, r.n) for r in got] == [(None, 1), ("", 2), ("a", 3), ("ab", 4), ("b", 5), ("b", 6)]
    assert ranked(spark.createDataFrame([], "x string"), "x", "n").count() == 0
