"""Identity of affine-gap global alignments for pairs of sequences.

The recurrence keeps one traceback sign for each cell: diagonal before up before left on ties, and
where a gap wins, the cell's score becomes the gap's. A leading gap of n costs open + (n - 1) ext, an
inner one open + n ext. The path follows the cells' signs, so it isn't always that of the best score
and may depend on the order of the two; pairs are aligned with the lower id first. A batch of pairs
goes through the table together: loops run over cells, numpy over pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.substitution import ALPHABET, substitution_matrix
from .minhash import all_pairs

_NEG = -(1 << 30)
#: Cells of all tables of one batch.
CELLS = 40_000_000
_INDEX = np.full(256, -1, np.int64)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _coded(texts: list[str], which: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    out, size = np.zeros((len(texts), width), np.int64), np.array([len(t) for t in texts], np.int64)
    for at, t in enumerate(texts):
        raw = t.encode("utf-8")
        code = _INDEX[np.frombuffer(raw, np.uint8)]
        if (code < 0).any():
            raise ValueError(f"Invalid amino acid in sequence{which}: {t[int(np.argmax(_INDEX[np.frombuffer(t.encode('utf-32-le'), '<u4').clip(0, 255)] < 0))]}")
        out[at, : len(raw)] = code
    return out, size


def signs(first: list[str], second: list[str], matrix: np.ndarray, gap_open: int, gap_ext: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Traceback signs (pair, i, j): 0 diagonal, 1 up, 2 left; and both sequences' lengths."""
    a, m = _coded(first, 1, max(map(len, first), default=0))
    b, n = _coded(second, 2, max(map(len, second), default=0))
    size, rows, cols = len(first), a.shape[1], b.shape[1]
    sign = np.zeros((size, rows + 1, cols + 1), np.uint8)
    sign[:, 1:, 0], sign[:, 0, 1:] = 1, 2
    best, up = np.full((cols + 1, size), _NEG, np.int64), np.full((cols + 1, size), _NEG, np.int64)
    left0 = np.full((cols + 1, size), _NEG, np.int64)
    best[0] = 0
    left0[1:] = (-gap_open - np.arange(cols) * gap_ext)[:, None]
    left_above = left0
    for i in range(1, rows + 1):
        row, row_up, row_left = np.full_like(best, _NEG), np.full_like(up, _NEG), np.full_like(up, _NEG)
        row_up[0] = -gap_open - (i - 1) * gap_ext
        for j in range(1, cols + 1):
            x = np.maximum(best[j] - (gap_open + gap_ext), up[j] - gap_ext)
            y = np.maximum(row[j - 1] - (gap_open + gap_ext), row_left[j - 1] - gap_ext)
            d = np.maximum(np.maximum(best[j - 1], up[j - 1]), left_above[j - 1]) + matrix[a[:, i - 1], b[:, j - 1]]
            gap = np.maximum(x, y)
            diagonal = d >= gap
            sign[:, i, j] = np.where(diagonal, 0, np.where(x >= y, 1, 2))
            row[j], row_up[j], row_left[j] = np.where(diagonal, d, gap), x, y
        best, up, left_above = row, row_up, row_left
    return sign, m, n


def identities(first: list[str], second: list[str], matrix: np.ndarray, gap_open: int = 10, gap_ext: int = 4) -> np.ndarray:
    """Equal columns by alignment length, NaN for two empty sequences."""
    out = np.full(len(first), np.nan)
    order = sorted(range(len(first)), key=lambda k: (len(first[k]), len(second[k])))
    lo = 0
    while lo < len(order):
        hi, cells = lo, 0
        while hi < len(order):
            k = order[hi]
            wide = max(cells, (len(first[k]) + 1) * (max(len(second[q]) for q in order[lo : hi + 1]) + 1)) if hi - lo < 64 or hi % 64 == 0 else cells
            if hi > lo and wide * (hi - lo + 1) > CELLS:
                break
            cells, hi = wide, hi + 1
        part = order[lo:hi]
        s1, s2 = [first[k] for k in part], [second[k] for k in part]
        sign, i, j = signs(s1, s2, matrix, gap_open, gap_ext)
        a, b = _coded(s1, 1, sign.shape[1] - 1)[0], _coded(s2, 2, sign.shape[2] - 1)[0]
        same, length, all_ = np.zeros(len(part)), np.zeros(len(part)), np.arange(len(part))
        live = all_[(i > 0) | (j > 0)]
        while len(live):
            t = sign[live, i[live], j[live]]
            diagonal = live[t == 0]
            same[diagonal] += a[diagonal, i[diagonal] - 1] == b[diagonal, j[diagonal] - 1]
            i[live] -= t != 2
            j[live] -= t != 1
            length[live] += 1
            live = live[(i[live] > 0) | (j[live] > 0)]
        with np.errstate(invalid="ignore"):
            out[part] = same / length
        lo = hi
    return out


def path(first: str, second: str, matrix: np.ndarray, gap_open: int = 10, gap_ext: int = 4) -> str:
    """The alignment from start to end: D, U (gap in the second) and L (gap in the first)."""
    sign, _, _ = signs([first], [second], matrix, gap_open, gap_ext)
    i, j, out = len(first), len(second), []
    while i or j:
        t = sign[0, i, j]
        out.append("DUL"[t])
        i, j = i - (t != 2), j - (t != 1)
    return "".join(reversed(out))


def align_pairs(pairs: DataFrame, matrix_name: str = "BLOSUM62", gap_open: int = 10, gap_ext: int = 4) -> DataFrame:
    """pairs (i, j, first, second) to (i, j, similarity); null for two empty sequences."""
    matrix = substitution_matrix(matrix_name)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = identities(f["first"].tolist(), f["second"].tolist(), matrix, gap_open, gap_ext)
            yield pd.DataFrame({"i": f["i"], "j": f["j"], "similarity": pd.Series(s, index=f.index).astype(object).where(~np.isnan(s), None)})

    return pairs.select("i", "j", "first", "second").mapInPandas(run, "i long, j long, similarity double")


def similarity_nw(seqs: DataFrame, matrix_name: str = "BLOSUM62", gap_open: int = 10, gap_ext: int = 4, diagonal: bool = True) -> DataFrame:
    """(i, j, similarity) of all i <= j, the diagonal computed too. Each different pair of strings is aligned once.

    Null sequences are rejected, as are letters outside the alphabet.
    """
    substitution_matrix(matrix_name)
    checked = seqs.select("seq_id", F.when(F.col("sequence").isNull(), F.raise_error(F.lit("a sequence is null")).cast("string")).otherwise(F.col("sequence")).alias("sequence"))
    left = checked.select(F.col("seq_id").alias("i"), F.col("sequence").alias("first"))
    right = checked.select(F.col("seq_id").alias("j"), F.col("sequence").alias("second"))
    pairs = all_pairs(seqs, diagonal).join(left, "i").join(right, "j")
    strings = pairs.select("first", "second").distinct().select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "first", "second")
    matrix = substitution_matrix(matrix_name)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = identities(f["first"].tolist(), f["second"].tolist(), matrix, gap_open, gap_ext)
            yield f[["first", "second"]].assign(similarity=pd.Series(s, index=f.index).astype(object).where(~np.isnan(s), None))

    scored = strings.mapInPandas(run, "first string, second string, similarity double")
    return pairs.join(scored, ["first", "second"]).select("i", "j", "similarity")
