"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered over all labelled rows, per task in a dense matrix and
then by a partially aggregated sum; what reaches the driver is languages x
(buckets + 1) numbers, whatever the corpus. The log-probability matrix is
broadcast with the scoring function; texts are scored in numpy over the
n-grams present. ``MOST_LANGUAGES`` bounds the matrix: more different labels
than that are an error, not a silent choice among them.

Beside the language each text gets its fit: the mean log-probability of its
n-grams under that language, less what the language's own training texts have
on average, and with an allowance that shrinks with the root of the number of
n-grams. It is near 0 for the language itself, however short the text, and far
below for others. A model of few texts tells a typical n-gram less far from an
unseen one; where that range is under ``FULL_RANGE``, fits are stretched to it.

Edge cases: a null text or one without a letter is ``und`` with score 0;
with no labelled rows every text is; texts are read whole; equal texts get
equal predictions, rows that repeat a doc_id their own; ties go to the
language that sorts first; an empty table gives no rows; columns named like
the new ones are replaced by them. A text is held whole by one task, with
about 80 bytes a character beside it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm.common import BLOCK_BYTES, Stage, blocks

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
UNKNOWN = "und"
MOST_LANGUAGES, ALLOWANCE, FULL_RANGE = 1000, 4.0, 6.75


class _Letters:
    """Code points -> whether they are letters; made once per worker from the Unicode table."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
        return cls.table


def grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all n-grams with a letter, and where each text's begin (one more at the end).

    Characters are lower-cased, all but letters count as one blank, and runs
    of blanks are one.
    """
    joined = "\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(joined, dtype=np.uint32)
    letter = _Letters.get()[c]
    end = c == 0
    if end.sum() != len(texts) + 1:  # a text holds the separator itself
        c = np.frombuffer("\0".join(["", *(t.replace("\0", " ") for t in texts), ""]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter, end = _Letters.get()[c], c == 0
    keep = letter | end
    keep[1:] |= letter[:-1]  # the first blank after a letter
    c = np.where(letter | end, c, 32)[keep]
    letter, end = letter[keep], end[keep]
    starts = np.flatnonzero(end)
    ends = np.cumsum(end)
    hashed = np.zeros(len(c), dtype=np.uint32)
    some = np.zeros(len(c), dtype=bool)
    for n in range(1, max(ORDERS) + 1):
        # Grows each gram by its next character; those that would cross a text's end go.
        m = len(c) - n + 1
        if m <= 0:
            break
        hashed = (hashed[:m] * np.uint32(0x01000193) ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
        some = some[:m] | letter[n - 1 :]
        if n in ORDERS:
            ok = some & ~end[:m] & (ends[:m] == ends[n - 1 :])
            at = np.flatnonzero(ok)
            yield ((hashed[at] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32), np.searchsorted(at, starts)


def counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows with a language and a text; bucket -1 counts the texts."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for block in blocks(batches, limit=BLOCK_BYTES // 4):
            texts, langs = [x or "" for x in block.column("text").to_pylist()], block.column("lang").to_pylist()
            for lang in set(langs):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                row = held.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                row[buckets] += len(mine)
                for found, _ in grams(mine, buckets):
                    row[:buckets] += np.bincount(found, minlength=buckets)
        for lang, row in held.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < buckets, at, -1).astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, their log-probabilities (languages x buckets), priors, mean log-probability of their own n-grams and how far fits are stretched."""

    def __init__(self, langs: list[str], table: np.ndarray, texts: np.ndarray):
        self.langs = langs
        total = table.sum(axis=1, keepdims=True)
        logs = np.log((table + SMOOTHING) / (total + SMOOTHING * table.shape[1])) if langs else np.zeros((0, table.shape[1]))
        self.logs = np.ascontiguousarray(logs, dtype=np.float32)
        self.prior = np.log(texts / texts.sum()) if langs else np.zeros(0)
        self.typical = (table * logs).sum(axis=1) / np.maximum(total[:, 0], 1) if langs else np.zeros(0)
        unseen = np.log(SMOOTHING / (total[:, 0] + SMOOTHING * table.shape[1]))
        self.stretch = np.maximum(FULL_RANGE / np.maximum(self.typical - unseen, 1e-9), 1.0)

    def score(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Prediction, its probability and its fit; log-densities are tempered by the root of the number of n-grams, since n-grams overlap."""
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, [0.0] * n, [-np.inf] * n
        sums, found = np.zeros((len(self.langs), n)), np.zeros(n, dtype=np.int64)
        for ids, starts in grams(texts, self.logs.shape[1]):
            size = np.diff(starts)
            found += size
            full = np.flatnonzero(size)
            if len(full):
                for k, logs in enumerate(self.logs):
                    sums[k, full] += np.add.reduceat(logs[ids], starts[:-1][full], dtype=np.float64)
        some = np.maximum(found, 1)
        scaled = (sums + self.prior[:, None]) / np.sqrt(some)
        best = scaled.argmax(axis=0)
        odds = np.exp(scaled - scaled.max(axis=0))
        score = odds.max(axis=0) / odds.sum(axis=0)
        fit = (sums[best, np.arange(n)] / some - self.typical[best] + ALLOWANCE / np.sqrt(some)) * self.stretch[best]
        none = found == 0
        return [UNKNOWN if x else self.langs[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score).tolist(), np.where(none, -np.inf, fit).tolist()


def fit(docs: DataFrame, buckets: int = BUCKETS) -> Model:
    """The model of all rows of ``docs`` (text, lang)."""
    found = Stage(docs.sparkSession, "language").write(counts(docs, buckets), "counts")
    langs = [r["lang"] for r in found.where("bucket = -1").select("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    rows = found.toArrow()
    langs.sort()
    table = np.zeros((len(langs), buckets + 1))
    place = {x: k for k, x in enumerate(langs)}
    table[[place[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(langs, table[:, :buckets], table[:, buckets])


def predict(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with prediction, score and (if there is a third name) fit under ``names``, all other columns kept. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    old = [c for c in docs.columns if c.lower() not in names]

    def run(batches):
        for block in blocks(batches, limit=BLOCK_BYTES // 4):
            langs, *figures = shared.value.score([x or "" for x in block.column("text").to_pylist()])
            new = [pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in figures)][: len(names)]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in old), *new], [*old, *names])

    kept = docs.select(*old)
    schema = kept.withColumns({name: F.lit(0.0) if k else F.lit("") for k, name in enumerate(names)}).schema
    return kept.mapInArrow(run, schema)
