"""Quality classifier: a regularised quadratic discriminant over statistics of a text.

Every text becomes a short vector: lengths and shares of kinds of characters and words, put on log scales so
that each class is closer to a normal distribution. One grouped sum gives the count, the sums and
the sums of products of either class, however many labelled rows there are; the driver sees two small matrices. Each covariance is
shrunk towards the pooled one and towards a multiple of the unit matrix, factored once, and the triangular
inverse travels with the tasks. A score is the logistic value of the difference of the two log densities (Mahalanobis
distance and determinant) and the log prior.

Defined results: a null text counts as empty, and an empty one has a score like any other. Texts are read whole. Rows with a null
label, or whose labels contradict each other, teach nothing; without any row of a class, every score is the share of label 1
among the rows that teach, or one half without any. Repeated documents each get the same score, and each teaches if
labelled; a null id has no label. Other columns are not carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import blank_words, count_char, stage

#: Share of the pooled covariance, and of the unit matrix, in the covariance of a class.
POOLED, UNIT = 0.1, 0.02
#: Log densities further apart than this give the same score.
FAR = 60.0
#: A share of zero counts as this much.
LEAST = 0.005


def _counts(t: Column) -> dict[str, Column]:
    """Characters and words of some kinds."""
    only = lambda kept: F.char_length(F.regexp_replace(t, f"[^{kept}]+", F.lit("")))
    return {
        "words": blank_words(t),
        "chars": F.char_length(t),
        "capitals": only(r"\p{Lu}"),
        "symbols": only("#*$%&|<>"),
        "marks": only(".,;:?"),
        "digits": only("0-9"),
        "shouts": count_char(t, "!"),
        "breaks": count_char(t, "\n"),
        # Words that the next word repeats.
        "twins": F.regexp_count(t, F.lit(r"(?<!\S)(\S++)(?=\s+\1(?!\S))")),
    }


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without its text, and its statistics on log scales in ``x``."""
    kept = [c for c in docs.columns if c != text]
    counted = docs.select(*kept, F.coalesce(text, F.lit("")).alias("t"))
    counted = counted.select(*kept, *[c.alias(f"n_{name}") for name, c in _counts(F.col("t")).items()])
    counted = counted.withColumns({"n": F.size("n_words").cast("double"), "distinct": F.size(F.array_distinct("n_words"))})

    def share(part: str, whole: str = "n") -> Column:
        return F.log(F.col(part) / F.greatest(F.col(whole).cast("double"), F.lit(1.0)) + LEAST)

    parts = [share(f"n_{c}") for c in ("chars", "symbols", "shouts", "marks", "digits", "breaks", "twins")]
    x = F.array(F.log1p("n"), *parts, share("n_capitals", "n_chars"), share("distinct"))
    return counted.select(*kept, x.alias("x"))


SIZE = 10


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of both classes, and the log odds of the prior."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_prior: float
    fitted: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_prior)))
        away = [((x - m) @ f.T) for m, f in zip(self.means, self.factors)]
        density = [-0.5 * (a * a).sum(axis=1) - d for a, d in zip(away, self.log_dets)]
        odds = np.clip(density[1] - density[0] + self.log_prior, -FAR, FAR)
        return 1 / (1 + np.exp(-odds))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of each class in this task."""
    total = np.zeros((2, SIZE + 1, SIZE + 1))
    for batch in batches:
        x = np.asarray(batch.column("x").flatten(), dtype="float64").reshape(-1, SIZE)
        x = np.hstack([np.ones((len(x), 1)), x])
        label = batch.column("label").to_numpy()
        for k in (0, 1):
            own = x[label == k]
            total[k] += own.T @ own
    k, i, j = (a.ravel() for a in np.indices(total.shape))
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(j), pa.array(total.ravel())], ["k", "i", "j", "v"])


def fit(labelled: DataFrame, pooled: float = POOLED, unit: float = UNIT) -> Model:
    """The model of rows ``(x, label)`` with label 0 or 1."""
    sums = labelled.select("x", F.col("label").cast("long").alias("label")).mapInArrow(_moments, "k long, i long, j long, v double")
    total = np.zeros((2, SIZE + 1, SIZE + 1))
    for k, i, j, v in sums.groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[k, i, j] = v
    n = total[:, 0, 0]
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5))) if n.sum() else 0.0
    if not n.all():
        share = np.clip(n[1] / n.sum(), 1e-9, 1 - 1e-9) if n.sum() else 0.5
        return Model(np.zeros((2, SIZE)), np.zeros((2, SIZE, SIZE)), np.zeros(2), float(np.log(share / (1 - share))), False)
    means = total[:, 0, 1:] / n[:, None]
    own = total[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    together = (n[:, None, None] * own).sum(axis=0) / n.sum()
    shrunk = (1 - pooled) * own + pooled * together
    level = np.trace(shrunk, axis1=1, axis2=2) / SIZE
    shrunk = (1 - unit) * shrunk + unit * np.maximum(level, 1e-6)[:, None, None] * np.eye(SIZE)
    lower = np.linalg.cholesky(shrunk)
    factors = np.stack([np.linalg.inv(c) for c in lower])
    return Model(means, factors, np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1), prior, True)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``score``; ``x`` is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype="float64").reshape(-1, SIZE)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.scores(x))], [*names, "score"])

    names = [c for c in rows.columns if c != "x"]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, teaches: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, teaches, score)`` of every document; only those that ``teaches`` says are learned from.

    ``teaches`` is a condition on the id, named ``doc``.
    """
    given = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    rows = stage(with_statistics(given, "text").withColumn("teaches", teaches))
    known = labels.select(F.col(doc_id).alias("doc"), F.col(label).alias("label")).filter("doc IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    model = fit(rows.filter("teaches").join(known.select("doc", "label"), "doc").select("x", "label"))
    return score(rows, model)
