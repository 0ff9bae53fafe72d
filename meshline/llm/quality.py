"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (logs of sizes,
logits of shares). Per class, sums and sums of products over all labelled
rows give mean and covariance, shrunk towards the pooled one and a scaled
identity. A document's score is the logistic of the difference of the two
Gaussian log-densities, from Mahalanobis distances by cached Cholesky factors.

Edge cases: a null text counts as empty and gets the score of the empty text;
a class without labelled rows leaves the prior, all in one class; null labels
are ignored; a document labelled several times counts as often.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm.common import Stage, blocks, bytes_of

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "symbols", "sentence_marks", "other_marks",
    "distinct_words", "top_word", "repeated_pairs", "same_as_last", "repeated_lines", "ratio", "words_per_mark", "odd_words", "non_ascii", "line_words",
)

#: Byte classes: 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 other mark in prose, 7 symbol, 8 beyond ASCII.
_CLASS = np.full(256, 7, dtype=np.uint8)
for _k, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b" \t\n\r\v\f"), (5, b".,"), (6, b";:'\"()-?!"), (8, range(128, 256))):
    _CLASS[list(_bytes)] = _k


def _logit(part: float, whole: float) -> float:
    p = (part + 0.5) / (whole + 1.0)
    return float(np.log(p / (1 - p))) if p < 1 else 8.0


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    n = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9)
    words = raw.split()
    w = len(words)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=w)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(bytes.__eq__, words, words[1:])) if w > 1 else 0
    odd = sum(1 for x in counts if not x[-1:].isalpha() and x[-1] < 128 and x[-1] not in b".,")
    letters = kinds[1] + kinds[2]
    return [
        np.log1p(n), np.log1p(w), np.log1p(len(lines)),
        float(np.log1p(sizes.mean())) if w else 0.0, float(np.log1p(sizes.std())) if w else 0.0,
        _logit(kinds[2], letters), _logit(kinds[3], n), _logit(kinds[7], n), _logit(kinds[5], n), _logit(kinds[6], n),
        _logit(len(counts), w) + 0.5 * np.log1p(w), _logit(max(counts.values(), default=0), w), _logit(max(0, w - 1 - pairs), w), _logit(same, w),
        _logit(len(lines) - len(set(lines)), len(lines)), float(np.log((len(zlib.compress(raw, 1)) + 8) / (n + 8))),
        float(np.log((w + 1) / (kinds[5] + 1))), _logit(odd, len(counts)), _logit(kinds[8], n), float(np.log1p(w / max(1, len(lines)))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches):
        for block in blocks(batches):
            x = [statistics(raw) for raw in bytes_of(block.column("text"))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _moments(batches):
    d = len(FEATURES)
    held = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, d)
            y = np.asarray(batch.column("label"))
            for k, total in held.items():
                mine = x[y == k]
                total += np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
    for k, total in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(total), pa.int32()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["label", "place", "value"])


class Model:
    """Means, Cholesky factors and log-determinants of both classes."""

    def __init__(self, totals: dict[int, np.ndarray], shrink: float = 0.4, ridge: float = 0.1, temper: float = 0.3):
        d = len(FEATURES)
        n = np.array([totals[k][0] for k in (0, 1)])
        self.prior = (n[1] + 1) / (n.sum() + 2)
        self.fitted, self.temper = bool((n > d + 1).all()), temper
        if not self.fitted:
            return
        self.mean = [totals[k][1 : 1 + d] / n[k] for k in (0, 1)]
        own = [totals[k][1 + d :].reshape(d, d) / n[k] - np.outer(self.mean[k], self.mean[k]) for k in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
        scale = np.maximum(np.diag(pooled), 1e-6)
        self.root, self.log_det = [], []
        for k in (0, 1):
            c = (1 - shrink) * own[k] + shrink * pooled + ridge * np.diag(scale)
            factor = np.linalg.cholesky(c)
            self.root.append(np.linalg.inv(factor))
            self.log_det.append(2 * float(np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        if not self.fitted:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - self.mean[k]) @ self.root[k].T) ** 2).sum(axis=1) - 0.5 * self.log_det[k] for k in (0, 1)]
        gap = self.temper * (density[1] - density[0]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(labelled: DataFrame) -> Model:
    """The model of all rows of (x, label). The driver gets 2 (1 + d + d * d) sums."""
    rows = labelled.where(F.col("label").isin(0, 1)).select("x", F.col("label").cast("int").alias("label")).mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    d = len(FEATURES)
    totals = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in rows:
        totals[r["label"]][r["place"]] = r["value"]
    return Model(totals)


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return vectors.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every text of ``docs``, learned from ``labels`` (doc_id, quality)."""
    stage = Stage(docs.sparkSession, "quality")
    vectors = stage.write(features(docs), "features")
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)")
    return score(vectors, fit(vectors.join(known, "doc_id")))
