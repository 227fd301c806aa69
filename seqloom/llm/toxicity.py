"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of any kind, labelled or not, are the
unlabelled set. A linear classifier with logistic loss l minimises

    prior * mean_P l(f) + max(0, mean_U l(-f) - prior * mean_P l(-f)) + l1 * |w|

in numpy: full-batch Adam with soft thresholds, and again without most of the penalty on the features it left; where the second term falls below zero, its gradient
is reversed. Features are a document's distinct words and their beginnings of 4 and 5 letters,
hashed. The classifier is fitted on a bounded sample (``max_positive`` and ``max_unlabelled`` rows,
the first by a hash of doc_id); every whole text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bound_batches, tidied

MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
HASH_BITS = 20
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[int]:
    mask = (1 << HASH_BITS) - 1
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) & mask]
    for n in (4, 5):
        if len(word) > n:
            out.append(zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "replace")) & mask)
    return out


def features(text: str) -> np.ndarray:
    """Hashed features of the distinct words; a beginning counts once for each word that has it."""
    out: list[int] = []
    for w in set(_WORDS(text.lower())):
        out += word_features(w)
    return np.array(out, dtype=np.int32)


@dataclass
class Model:
    """Weights of hashed features that aren't zero, and the intercept."""

    weight: dict[int, float]
    bias: float

    def scorer(self):
        known: dict[str, float] = {}
        get = self.weight.get

        def score(text: str) -> float:
            total = self.bias
            if len(known) > 200_000:
                known.clear()
            for w in set(_WORDS(text.lower())):
                x = known.get(w)
                if x is None:
                    x = known[w] = sum(get(f, 0.0) for f in word_features(w))
                total += x
            return float(1 / (1 + np.exp(-min(max(total, -60.0), 60.0))))

        return score


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk_gradient(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of scores of positives and unlabelled rows: both terms of the risk, and what descent follows.

    That is the gradient of their sum while the second term isn't negative, else minus the second term's.
    """
    first = prior * np.logaddexp(0, -f_p).mean()
    second = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    sign = 1.0 if second >= 0 else -1.0
    g_p = prior * ((_sig(f_p) - 1) * (sign > 0) - sign * _sig(f_p)) / len(f_p)
    return float(first), float(second), g_p, sign * _sig(f_u) / len(f_u)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, l1: float = 1e-3, rounds: int = 250, rate: float = 0.08, least_docs: int = 3) -> Model:
    """nnPU training. Features of fewer than ``least_docs`` positives have no weight.

    Without positives the prior alone decides; without unlabelled rows the positives' own risk does.
    """
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    base = float(np.log(prior / (1 - prior)))
    if not positive:
        return Model({}, base)
    seen, count = np.unique(np.concatenate([np.unique(x) for x in positive]), return_counts=True)
    used = seen[count >= least_docs]
    if not len(used):
        return Model({}, base)

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Column and row of every entry."""
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate(rows) if rows else np.empty(0, np.int32)
        at = np.searchsorted(used, col).clip(0, len(used) - 1)
        ok = used[at] == col
        return at[ok], row[ok]

    (pc, pr), (uc, ur) = matrix(positive), matrix(unlabelled)
    n_p, n_u = len(positive), max(1, len(unlabelled))
    # words that nearly all documents share say nothing and would slow the descent: scale by rarity
    share = (np.bincount(uc, minlength=len(used)) + 1) / (n_u + 1)
    scale = 1 / np.sqrt(1 + 20 * share)

    def descend(w: np.ndarray, b: float, open_: np.ndarray, l1: float) -> tuple[np.ndarray, float]:
        m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for t in range(1, rounds + 1):
            f_p = b + np.bincount(pr, (w * scale)[pc], minlength=n_p)
            f_u = b + np.bincount(ur, (w * scale)[uc], minlength=n_u)
            _, _, g_p, g_u = risk_gradient(f_p, f_u, prior)
            grad = np.append(open_ * scale * (np.bincount(pc, g_p[pr], minlength=len(used)) + np.bincount(uc, g_u[ur], minlength=len(used))), g_p.sum() + g_u.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            pace = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            step = pace * m / (1 - 0.9**t)
            w = w - step[:-1]
            w = open_ * np.sign(w) * np.maximum(np.abs(w) - pace[:-1] * l1, 0)
            b -= step[-1]
        return w, b

    # the penalty chooses features and shrinks them; those chosen are fitted again with little of it
    w, b = descend(np.zeros(len(used)), base, np.ones(len(used)), l1)
    w, b = descend(w, b, (w != 0).astype(float), l1 / 30)
    final = w * scale
    return Model({int(used[i]): float(final[i]) for i in np.flatnonzero(final)}, float(b))


def _sampled(docs: DataFrame, ids: DataFrame, n: int) -> list[np.ndarray]:
    """Features of the texts of at most n of the ids, the first by hash."""
    chosen = ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "x"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, x binary").collect()  # at most n ids
    return [np.frombuffer(r.x, np.int32) for r in sorted(rows, key=lambda r: (r.doc_id, r.x))]


def train(docs: DataFrame, labels: DataFrame, learn: Column, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from rows of doc_id where ``learn`` holds. The prior defaults to the share of toxic labels there.

    A document with several labels is toxic if one says so; null labels and doc_ids are left out. The
    fit sees at most ``max_positive`` confirmed positives and ``max_unlabelled`` rows without regard to
    labels, the first by a hash of doc_id: at every size the same sample size, whose features are all that
    leaves the executors.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null").where(learn)
    per_doc = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = per_doc.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    positive = _sampled(texts, per_doc.where("toxic > 0").select("doc_id"), max_positive)
    unlabelled = _sampled(texts, texts.select("doc_id").where(learn), max_unlabelled)
    return fit(positive, unlabelled, prior)


def score_texts(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a score (0 to 1) for every whole text; null and empty ones have the intercept's.

    Equal texts have equal scores; repeated rows and null doc_ids are rows of their own. An existing
    column of the score's name is replaced, all others are kept. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != score]
    at = keep.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([rate(t or "") for t in b.column(at).to_pylist()], pa.float64())], names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    # Columns go by number to Python and back, as mapInArrow can't take names with dots
    names = [f"c{i}" for i in range(len(keep) + 1)]
    schema = StructType([StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)]).add(names[-1], DoubleType())
    return docs.select(*(F.col(f"`{c}`") for c in keep)).toDF(*names[:-1]).mapInArrow(tidied(run), schema).toDF(*keep, score)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, fold(F.col("doc_id"), 3) != 1)
    scored = score_texts(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
