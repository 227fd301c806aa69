"""Column functions: shingles, affine and Murmur3 hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def shingles(text: Column, k: int, strict: bool = False) -> Column:
    """Overlapping substrings of k characters in order, repeats kept; none where the text is shorter.

    ``strict`` raises an error instead, as :func:`seqloom.operators.shingling.shingle` does.
    """
    out = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)
    if strict:
        message = F.concat(F.lit("'k' must be a positive integer between 1 and "), F.length(text).cast("string"))
        out = F.when(F.length(text) < k, F.raise_error(message).cast("array<string>")).otherwise(out)
    return out


def affine(x: Column, a: Column, b: Column, m: Column | int) -> Column:
    """(a x + b) mod m with the sign of m, in 64 bits."""
    return F.pmod(a.cast("long") * x.cast("long") + b.cast("long"), F.lit(m).cast("long") if isinstance(m, int) else m.cast("long"))


def unsigned(x: Column) -> Column:
    return x.cast("long").bitwiseAND(0xFFFFFFFF)


def seeded_murmur(text: Column, index: Column) -> Column:
    """Unsigned Murmur3 of a text whose UTF-8 length is a multiple of 4, with the seed ``hash(index)``."""
    return unsigned(F.hash(index.cast("int"), text))
