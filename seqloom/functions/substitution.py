"""Residue substitution scores. BLOSUM62 is built in; others are given as text in NCBI's matrix format."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# The alphabet, and the published BLOSUM62 scores of the twenty residues (lower triangle),
# of the codes B, Z and X against all before and themselves, and of the stop sign.
ALPHABET = "ARNDCQEGHILKMFPSTWYVBZX*"
_RESIDUES = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
_CODES = """
B -2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
Z -1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
X  0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1
"""
_STOP = (-4, 1)

_NAMES = ("BLOSUM62", "BLOSUM50", "BLOSUM45", "BLOSUM80", "BLOSUM90", "BLOSUM100")
_GIVEN: dict[str, np.ndarray] = {}


def _blosum62() -> np.ndarray:
    out = np.full((24, 24), _STOP[0])
    for i, line in enumerate(x for x in (_RESIDUES + _CODES).splitlines() if x):
        out[i, : i + 1] = out[: i + 1, i] = [int(x) for x in line[1:].split()]
    out[23, 23] = _STOP[1]
    return out


def parse_matrix(text: str) -> np.ndarray:
    """A 24 x 24 matrix from NCBI's format: ``#`` comments, a line of column letters, a line for each row letter."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    columns = lines[0]
    score = {(row[0], c): int(x) for row in lines[1:] for c, x in zip(columns, row[1:], strict=True)}
    lacking = [a + b for a in ALPHABET for b in ALPHABET if (a, b) not in score]
    if lacking:
        raise ValueError(f"the matrix lacks scores: {' '.join(lacking[:5])}")
    return np.array([[score[a, b] for b in ALPHABET] for a in ALPHABET])


def register_matrix(name: str, text: str) -> None:
    """Makes a matrix in NCBI's format known by name, such as BLOSUM45, BLOSUM80 or one of your own."""
    _GIVEN[name] = parse_matrix(text)


def substitution_matrix(name: str) -> np.ndarray:
    if name in _GIVEN:
        return _GIVEN[name]
    if name == "BLOSUM62":
        return _blosum62()
    if name in _NAMES:
        raise ValueError(f"{name} isn't built in; give its NCBI text to register_matrix first")
    raise ValueError(f"Invalid substitution matrix name: {name}")


def substitution_table(spark: SparkSession, name: str = "BLOSUM62") -> DataFrame:
    """(name, aa1, aa2, score)."""
    m = substitution_matrix(name)
    return spark.createDataFrame([(name, a, b, int(m[i, j])) for i, a in enumerate(ALPHABET) for j, b in enumerate(ALPHABET)], "name string, aa1 string, aa2 string, score int")
