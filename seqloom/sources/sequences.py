"""Sequences from tables and FASTA text: (seq_id, sequence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.workspace import Workspace


def from_column(df: DataFrame, sequence: str | Column, seq_id: str | Column) -> DataFrame:
    """(seq_id, sequence) by a real key; ids decide the order of pairs and of first appearance."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(seq_id).cast("long").alias("seq_id"), as_col(sequence).cast("string").alias("sequence"))


def distinct_strings(df: DataFrame, sequence: str | Column) -> DataFrame:
    """The distinct non-null strings, numbered from 1 in binary order."""
    col = F.col(sequence) if isinstance(sequence, str) else sequence
    return ranked(df.select(col.cast("string").alias("sequence")).where("sequence is not null").distinct(), "sequence", "seq_id").select("seq_id", "sequence")


def ranked(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """``name``: 1, 2, ... in the order of ``key``, nulls first; rows that are equal there in any order.

    Rows are range-partitioned and numbered within their ranges; sizes of ranges, one number each, shift
    the numbers. Equal rows are told apart by a number, so that no range need hold them all.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    order = [*keys, "_row"]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = Workspace(spark, "ranked").save(rows.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "rows")  # partition << 33 | row
    part = F.shiftright("_at", 33)
    before, shift = 0, []
    for r in sorted(rows.groupBy(part.alias("p")).count().collect(), key=lambda r: r.p):  # a row for each range
        shift.append((r.p, before))
        before += r["count"]
    shifts = F.broadcast(spark.createDataFrame(shift, "_part long, _shift long"))
    at = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_shift") + 1
    return rows.join(shifts, part == F.col("_part")).withColumn(name, at).drop("_at", "_part", "_shift")


def read_parquet(spark: SparkSession, path: str, sequence: str, seq_id: str) -> DataFrame:
    return from_column(spark.read.parquet(path), sequence, seq_id)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, name, sequence) of FASTA files, numbered by name and sequence; records of one name stay apart.

    A record is read as one line, so records of any number split well.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    line = F.regexp_replace(F.col("value"), "^>", "")
    name = F.trim(F.substring_index(line, "\n", 1))
    body = F.regexp_replace(F.when(F.instr(line, "\n") > 0, F.substr(line, F.instr(line, "\n") + 1)).otherwise(""), r"\s", "")
    out = records.select(name.alias("name"), body.alias("sequence")).where("name <> '' or sequence <> ''")
    return ranked(out, ["name", "sequence"], "seq_id").select("seq_id", "name", "sequence")


def residues(text: Column) -> Column:
    """A protein-like string: letters in upper case without J, O and U, which no substitution matrix has."""
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "[JOU]", "")
