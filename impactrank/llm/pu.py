"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text alone train the score: with pi the share of positives in
the unlabelled text, the negative risk is that of the unlabelled text as negatives less pi times
that of the positives as negatives, held at zero or more (the non-negative estimator). pi is
estimated by the tail ratio of a positive-against-unlabelled classifier on folds it has not seen.

The sample that the fit sees is bounded by two parameters, whatever the corpus holds; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import fold, id_text, keep_rows, lean, slices, text_bytes, words

#: Most trusted positives and most unlabelled texts that the fit sees.
POSITIVES, UNLABELLED = 1500, 3000


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def descend(x: np.ndarray, slope, steps: int, rate: float, decay: float = 1e-4) -> np.ndarray:
    """Weights after ``steps`` of adaptive gradient descent; slope(scores) is the risk's slope by score."""
    weights, first, second = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for k in range(1, steps + 1):
        grad = x.T @ slope(x @ weights).astype(np.float32) + decay * weights
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        weights = weights - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return weights


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 60) -> float:
    """The share of positives among the unlabelled, from the tail of unseen folds in which negatives are rarest.

    The tail ratio bounds the share from above, so its lower confidence bound is taken: a prior that
    is too high hides negatives, one that is a little low costs few positives.
    """
    held: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for k in (0, 1):
        p, u = positive[k::2], unlabelled[k::2]
        x = np.vstack([p, u])
        y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
        share = np.where(y == 1, 0.5 / max(1, len(p)), 0.5 / max(1, len(u)))
        weights = descend(x, lambda z, y=y, share=share: (sigmoid(z) - y) * share, steps, 0.05)
        held[True].append(positive[1 - k :: 2] @ weights)
        held[False].append(unlabelled[1 - k :: 2] @ weights)
    p, u = np.sort(np.concatenate(held[True])), np.sort(np.concatenate(held[False]))
    if not len(p) or not len(u):
        return 0.5
    at = np.quantile(p, np.linspace(0.02, 0.7, 35))
    above = lambda s: 1 - np.searchsorted(s, at) / len(s)
    ratio = (above(u) / above(p)).min() - 1.5 / np.sqrt(len(u))
    return float(np.clip(ratio, 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 200, rate: float = 0.05) -> np.ndarray:
    """Weights of least non-negative risk."""
    n, m = len(positive), len(unlabelled)
    x = np.vstack([positive, unlabelled])
    softplus = lambda z: np.logaddexp(0, z)

    def slope(z: np.ndarray) -> np.ndarray:
        p, u = z[:n], z[n:]
        negative = softplus(u).mean() - prior * softplus(p).mean()
        up, down = prior * -sigmoid(-p) / n, np.concatenate([-prior * sigmoid(p) / n, sigmoid(u) / m])
        if negative < 0:  # undo the overfit alone
            return -down
        return down + np.concatenate([up, np.zeros(m)])

    return descend(x, slope, steps, rate)


def sample_features(docs: DataFrame, roles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and roles of the sampled documents, one text of each id, by rising role. ``roles``: (doc_id, role int), of a size that the callers bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, role = text_bytes(batch["text"]), batch["role"]
            for i, j in slices(texts):
                rows = features.matrix(words(texts[i:j])).astype(np.float16)
                yield pa.RecordBatch.from_arrays([role[i:j], pa.array([r.tobytes() for r in rows], pa.binary())], ["role", "x"])

    one = docs.join(F.broadcast(roles), "doc_id").groupBy("doc_id", "role").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = one.mapInArrow(lean(run), "role int, x binary").toArrow()
    role = got["role"].to_numpy()
    half = np.empty((len(role), features.WIDTH), np.float16)
    for i, row in enumerate(got["x"]):  # row by row: the driver holds the sample as it came and one copy
        half[i] = np.frombuffer(row.as_buffer(), np.float16)
    del got
    x = half.astype(np.float32)
    order = np.lexsort((x @ np.linspace(1, 2, features.WIDTH, dtype=np.float32), role))  # the same whatever task ends first
    x[:] = half[order]
    return x, role[order]


def score_column(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) by sigmoid of the linear score, in Arrow batches."""
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch["text"])
            parts = [sigmoid((features.matrix(words(texts[i:j])) @ weights).astype(float)) for i, j in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(parts or [np.zeros(0)]))], ["doc_id", "score"])

    return docs.mapInArrow(lean(run), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> np.ndarray:
    """Weights from the ``positives`` and ``unlabelled`` ids of smallest hash whose crc32 modulo 3 is not 1; zeros without positives."""
    own = id_text(docs, id_col, text_col).where("doc_id is not null")
    pick = lambda ids, n, role: ids.where(fold(F.col("doc_id"), 3) != 1).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", F.lit(role).alias("role"))
    trusted = labels.where("quality = 1").select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    x, role = sample_features(own, pick(trusted, positives, 1).unionByName(pick(own.select("doc_id"), unlabelled, 0)))
    free, positive = np.split(x, [int((role == 0).sum())])  # rows come by role, so both are views
    if len(positive) < 2 or len(free) < 2:
        return np.zeros(features.WIDTH)
    return fit(positive, free, estimate_prior(positive, free))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Positives are rows of ``labels`` with quality 1, unlabelled texts any documents; both only from ids
    whose crc32 modulo 3 is not 1. Null and empty texts are scored by the constant alone; a null id is
    held out by the rule for an empty id. Without positives every score is 0.5. Repeated rows stay;
    other columns are ignored; empty tables give an empty result.
    """
    scored = score_column(id_text(docs, id_col, text_col), train(docs, labels, id_col, text_col, positives, unlabelled))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score of 0.5 or more, with all their columns."""
    weights = train(docs, labels, id_col, text_col).astype(np.float32)
    return keep_rows(docs, text_col, lambda texts: features.matrix(words(texts)) @ weights >= 0)
