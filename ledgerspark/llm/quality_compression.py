"""Quality classifier by compression: which dictionary, of good or of bad text, makes a text smaller.

Two zstandard dictionaries are built from labelled text, one per label. A text's evidence is
the difference of its two compressed sizes over its length; a logistic curve, fitted on
labelled rows that went into neither dictionary, turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for each label, half for the dictionary and half for the curve.
ROWS_PER_LABEL = 1600
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Texts are compressed in pieces of so many bytes, so that the dictionary counts all along a long text.
PIECE_BYTES = 2048


@dataclass
class CompressionModel:
    """good, bad: dictionary bytes; weights of 1, the evidence and 1/sqrt(length)."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


class _Sizer:
    def __init__(self, dictionary: bytes):
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        self.run = zstandard.ZstdCompressor(
            dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress

    def __call__(self, data: bytes) -> int:
        return sum(len(self.run(data[i : i + PIECE_BYTES])) for i in range(0, len(data), PIECE_BYTES))


def _evidence(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Columns 1, (bad size - good size) / bytes, 1 / sqrt(bytes + 1) for each text; null is empty."""
    a, b = _Sizer(good), _Sizer(bad)
    rows = []
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        n = len(data)
        rows.append((1.0, (b(data) - a(data)) / n if n else 0.0, 1 / math.sqrt(n + 1)))
    return np.array(rows, float).reshape(-1, 3)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps on standardised columns."""
    mean, scale = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.hstack([x[:, :1], (x[:, 1:] - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge * w
        bend = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0] - (w[1:] * mean / scale).sum()), *map(float, w[1:] / scale))


def learnable(doc_id: str) -> F.Column:
    """Rows from which labels may be learned: crc32 of the id as text, modulo 3, is not 1 (null ids: never)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> CompressionModel:
    """Learns from at most ``rows_per_label`` rows of either label, those with the smallest hashed ids.

    The sampled ids are bounded by that parameter, so they are broadcast and the sampled
    texts come to the driver, of a repeated id the least text. A doc_id with both labels, or null labels, teaches nothing.
    Without a row of either label the model scores every text by the share of label 1 (0.5 if none).
    """
    spark = docs.sparkSession
    ids = (
        labels.where(learnable("doc_id") & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("draw"))
    )
    chosen = [
        r for q in (0, 1) for r in ids.where(F.col("quality") == q).orderBy("draw", "doc_id").limit(rows_per_label).collect()
    ]
    held = spark.createDataFrame([(r.doc_id, r.quality) for r in chosen], "doc_id bigint, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(held), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    known = {r.quality: r.n for r in ids.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts: dict[tuple[int, int], list[str]] = {(q, half): [] for q in (0, 1) for half in (0, 1)}
    turn = {r.doc_id: i % 2 for i, r in enumerate(sorted(chosen, key=lambda r: (r.quality, r.draw)))}
    for r in rows:
        parts[r.quality, turn[r.doc_id]].append(r.text or "")
    good, bad = (_dictionary(parts[q, 0]) for q in (1, 0))
    x = _evidence(parts[1, 1] + parts[0, 1], good, bad)
    y = np.array([1.0] * len(parts[1, 1]) + [0.0] * len(parts[0, 1]))
    if not len(y) or y.min() == y.max():
        return CompressionModel(good, bad, (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 0.0, 0.0))
    # each label counts as often as the labelled rows have it, so that scores are shares of label 1
    share = known[1] / (known[0] + known[1])
    each = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return CompressionModel(good, bad, _fit_curve(x, y, each))  # type: ignore[arg-type]


def _dictionary(texts: list[str]) -> bytes:
    pieces = [d[i : i + PIECE_BYTES] for t in texts for d in [t.encode("utf-8", "surrogatepass")] for i in range(0, len(d), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text for training: the text itself serves as the dictionary
        return (b" ".join(pieces) or b" " * 8)[-DICTIONARY_BYTES:].ljust(8)


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows and a column with the probability, 0 to 1, that a text is good.

    Only the text counts. Null and empty texts get the curve's value at no evidence;
    equal texts get equal scores. A column that already has the score's name is replaced.
    """
    docs = docs.drop(score_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for texts in parts:
            x = _evidence(texts.tolist(), m.good, m.bad)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30))))

    return docs.withColumn(score_col, run(F.col(text_col)))
