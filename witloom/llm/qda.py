"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are built-in column expressions. Fitting needs each class's count, sums and products of the statistics:
one aggregate of (d + 1)(d + 2) / 2 numbers a class, whatever the number of labelled rows, so every labelled row
counts. Class covariances are shrunk towards the pooled one and its diagonal; their Cholesky factors are made once and
scoring is a difference of Mahalanobis log densities in numpy over Arrow batches.

Defined results: null text is the empty text and is scored; documents without a label are scored only; a document
with several labels counts once a label; labels other than 0 and 1 are ignored; without both classes in the training
rows every score is the share of label 1 (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, stored, text_of

SYMBOLS = "#*$%&|<>{}[]^~=+\\_@"
STATISTICS = ("log_chars", "word_length", "symbols", "digits", "capitals", "end_marks", "commas", "other_marks", "new_words", "line_repeats", "log_line", "letters")


@dataclass(frozen=True)
class Model:
    """Means and Cholesky factors of both classes, and the log of the classes' odds; the factors are inverted once."""

    means: np.ndarray
    factors: np.ndarray
    log_odds: float

    @cached_property
    def inverses(self) -> np.ndarray:
        return np.tril(np.linalg.inv(self.factors))

    @cached_property
    def log_determinants(self) -> np.ndarray:
        return np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(axis=1)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``x``, an array of transformed statistics of the whole text."""
    t = F.col("t_")
    lower = "abcdefghijklmnopqrstuvwxyz"
    base = docs.select(*keep, text_of().alias("t_")).select(*keep, "t_", F.split(t, r"[\x20\x09-\x0D]+").alias("w_"), F.split(t, "\n").alias("l_"))
    n, words = F.greatest(F.length(t), F.lit(1)).cast("double"), F.greatest(F.size("w_"), F.lit(1)).cast("double")
    lines = F.greatest(F.size("l_"), F.lit(1)).cast("double")
    rate = lambda part, whole: F.sqrt(part.cast("double") / whole)
    x = [
        F.log1p(F.length(t).cast("double")),
        F.log1p(n / words),
        rate(_count(t, SYMBOLS), words),
        rate(_count(t, "0123456789"), n),
        rate(_count(t, lower.upper()), n),
        rate(_count(t, "!?"), words),
        rate(_count(t, ","), words),
        rate(_count(t, ".;:"), words),
        rate(F.size(F.array_distinct("w_")), words),
        rate(lines - F.size(F.array_distinct("l_")), lines),
        F.log1p(n / lines),
        rate(_count(t, lower), n),
    ]
    return base.select(*keep, F.array(*x).alias("x"))


def fit(examples: DataFrame, alpha: float = 0.2, gamma: float = 0.05) -> Model:
    """``examples``: columns ``x`` and ``label`` (0 or 1). ``alpha`` pulls class covariances to the pooled one, ``gamma`` to the diagonal."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {r["label"]: r for r in examples.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()}
    n = [rows[k]["n"] if k in rows else 0 for k in (0, 1)]
    if not all(n):
        share = 0.5 if not sum(n) else min(max(n[1] / sum(n), 1e-9), 1 - 1e-9)
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), float(np.log(share / (1 - share))))
    means = np.array([[rows[k][f"s{i}"] / n[k] for i in range(d)] for k in (0, 1)])
    scatter = np.zeros((2, d, d))
    for k in (0, 1):
        for i in range(d):
            for j in range(i, d):
                scatter[k, i, j] = scatter[k, j, i] = rows[k][f"p{i}_{j}"] - n[k] * means[k, i] * means[k, j]
    pooled = scatter.sum(axis=0) / sum(n)
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors = []
    for k in (0, 1):
        shrunk = (1 - alpha) * scatter[k] / n[k] + alpha * pooled
        factors.append(np.linalg.cholesky((1 - gamma) * shrunk + gamma * diagonal))
    return Model(means, np.stack(factors), float(np.log(n[1] / n[0])))


def score_rows(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of statistics."""
    logs = []
    for k in (0, 1):
        z = (x - model.means[k]) @ model.inverses[k].T
        logs.append(-0.5 * (z * z).sum(axis=1) - model.log_determinants[k])
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + model.log_odds, -500, 500)))


def with_scores(frame: DataFrame, model: Model) -> DataFrame:
    """Replaces ``x`` by ``score`` in a frame made by :func:`statistics`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("x")
            x = b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(STATISTICS))
            s = score_rows(model, x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[c for j, c in enumerate(b.columns) if j != i], pa.array(s)], [*[f.name for f in b.schema if f.name != "x"], "score"])

    kept = [f for f in frame.schema if f.name != "x"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    return frame.mapInArrow(run, schema)


def labelled(stats: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """``x`` and ``label`` of the labelled rows of ``stats`` (doc_id, x) that are not held out: no text is moved."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id_"), F.col("quality").alias("label"))
    known = known.where(crc_remainder("id_", modulus) != held)
    return stats.join(known, F.col("doc_id") == F.col("id_")).select("label", "x")


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    return labelled(statistics(docs, "doc_id"), labels, modulus, held)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document. The statistics are worked out and written once."""
    stats = stored(statistics(docs, "doc_id"), "statistics")
    scored = with_scores(stats, fit(labelled(stats, labels, modulus, held)))
    return scored.select("doc_id", (crc_remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
