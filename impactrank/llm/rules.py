"""Quality rules: counted rules, then a calibrated n-gram model against a fixed threshold.

The model is a logistic regression over hashed character and word n-grams, trained on labelled
rows; a scale and an offset fitted on rows that the regression has not seen make its scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import Words, fold, id_text, keep_rows, slices, text_bytes, words
from .pu import descend, sample_features, sigmoid

#: Most labelled rows that the fit sees.
LABELLED = 3000
#: Probability of quality below which a document is rejected.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def counts(w: Words) -> dict[str, np.ndarray]:
    """The counted rules of each document."""
    start_of_point = (w.data & 0xC0) != 0x80
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    stops = np.flatnonzero(w.data == 10)
    begins = np.concatenate(([0], stops[:-1] + 1))
    doc = np.searchsorted(w.bounds, begins, side="right") - 1
    filled = np.searchsorted(w.start, begins) < np.searchsorted(w.start, stops)
    key = w.span_hash(begins[filled], stops[filled]) + doc[filled].astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    n = len(w.bounds) - 1
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(doc[filled], minlength=n) - np.bincount(doc[filled][first], minlength=n)
    return {
        "n_words": np.diff(w.first),
        "word_chars": w.per_doc(inside & start_of_point),
        "n_symbols": w.per_doc(_SYMBOL[w.data]),
        "n_dup_lines": lines,
        "n_repeat_words": w.per_doc_words(features.repeated(w, 3)),
    }


def fit(x: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """(weights, scale, offset): a quarter of the rows is kept for the calibration."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), 0.0, 20.0 if len(y) and y[0] == 1 else (-20.0 if len(y) else 20.0)
    late = np.zeros(len(y), bool)
    for value in (0, 1):
        at = np.flatnonzero(y == value)
        late[at[::4] if len(at) > 3 else []] = True
    own, truth = x[~late], y[~late]
    weights = descend(own, lambda z: (sigmoid(z) - truth) / len(truth), steps, 0.05)
    if len(set(y[late].tolist())) < 2:
        return weights, 1.0, 0.0
    z, truth = x[late] @ weights, y[late]
    high, low = (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2)
    target = np.where(truth == 1, high, low)
    line = np.array([1.0, 0.0])
    loss = lambda l: (np.logaddexp(0, l[0] * z + l[1]) - target * (l[0] * z + l[1])).sum()
    for _ in range(50):  # Newton steps, halved until they lower the loss
        p = sigmoid(line[0] * z + line[1])
        g, h = p - target, p * (1 - p)
        slope = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(slope, [(g * z).sum(), g.sum()])
        while loss(line - move) > loss(line) and abs(move).max() > 1e-9:
            move = move / 2
        line = line - move
        if abs(move).max() < 1e-8:
            break
    scale, offset = line
    return weights, float(scale), float(offset)


@dataclass
class Rules:
    """A trained model with its fixed thresholds."""

    weights: np.ndarray
    scale: float
    offset: float
    threshold: float = THRESHOLD

    def verdicts(self, texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, failed a counted rule, kept, probability) of each text."""
        w = words(texts)
        got = counts(w)
        chance = sigmoid(self.scale * (features.matrix(w) @ self.weights).astype(float) + self.offset)
        failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEATED * got["n_words"])
        return got, failed, ~failed & (chance >= self.threshold), chance


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, threshold: float = THRESHOLD) -> Rules:
    """Fitted on the ``labelled`` rows of smallest id hash among those whose id's crc32 modulo 3 is not 1, so that the rest can test it."""
    own = id_text(docs, id_col, text_col).where("doc_id is not null")
    roles = labels.where("quality in (0, 1)").select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("role")).where("doc_id is not null").where(fold(F.col("doc_id"), 3) != 1)
    roles = roles.groupBy("doc_id").agg(F.min("role").alias("role")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    x, y = sample_features(own, roles)
    weights, scale, offset = fit(x, y.astype(float))
    return Rules(weights.astype(np.float32), scale, offset, threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) of every document.

    A null text counts as empty and fails the word count. With one class of label the model gives that
    class; without labels it rejects nothing. Repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty result.
    """
    rules = train(docs, labels, id_col, text_col, labelled, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch["text"])
            for i, j in slices(texts):
                got, failed, kept, chance = rules.verdicts(texts[i:j])
                cols = [batch["doc_id"][i:j], *(pa.array(c.astype(np.int64)) for c in got.values()), pa.array(failed), pa.array(kept), pa.array(chance)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *got, "base_failed", "kept", "probability"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def passed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rules = train(docs, labels, id_col, text_col)
    return keep_rows(docs, text_col, lambda texts: rules.verdicts(texts)[2])
