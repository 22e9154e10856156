"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and a diagonal; a document's evidence
is the difference of the two Gaussian log densities, each from a Mahalanobis distance by the inverse of a Cholesky
factor that is computed once and kept with the model. A logistic curve over that difference gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are learned from, at most; chosen by a seeded hash of the id.
TRAIN_ROWS = 20_000
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
PREDICT_AT = 0.3
_DROP_WORDS = re.compile(r"[\w\s]+")


def _rate(n: float, of: float) -> float:
    """Logarithm of a share, held away from zero by a pseudo-count."""
    return math.log((n + 0.5) / (of + 1.0))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), len(text)
    counts, kinds = Counter(words), Counter(lines)
    signs = Counter(_DROP_WORDS.sub("", text))
    upper = sum(map(str.isupper, words))
    lengths = sum(map(len, words)) / n if n else 0.0
    marks = sum(signs.values())
    plain = signs["."] + signs[","]
    return [
        math.log1p(n),
        math.log1p(lengths),
        math.log((len(counts) + 1) / (n + 1)),
        _rate(counts.most_common(1)[0][1] if n else 0, n),
        _rate(sum(a == b for a, b in zip(words, words[1:])), n),
        _rate(upper, n),
        _rate(marks - plain, chars),
        _rate(signs["|"], n),
        _rate(signs["!"], n),
        _rate(plain, n),
        math.log((len(kinds) + 1) / (len(lines) + 1)),
        math.log1p(n / (len(lines) + 1)),
        _rate(sum(map(str.isdigit, words)), n),
    ]


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverses: np.ndarray  # of the lower Cholesky factors
    offsets: np.ndarray  # half the log determinants
    curve: tuple[float, float] = (0.0, 1.0)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - o for m, inv, o in zip(self.means, self.inverses, self.offsets)]
        return np.clip(logs[1] - logs[0], -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.evidence(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit on rows of statistics; both classes must be there.

    The curve's slope is a logistic fit with both classes weighed alike. Its offset puts the cut with the best
    balanced accuracy on these rows at ``PREDICT_AT``.
    """
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    means = np.array([p.mean(0) for p in parts])
    scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means)]
    pooled = sum(scatter) / len(z)
    inverses, offsets = [], []
    for p, s in zip(parts, scatter):
        own = (1 - SHRINK_POOLED) * s / len(p) + SHRINK_POOLED * pooled
        own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.diag(np.maximum(np.diag(own), 0.05))
        factor = np.linalg.cholesky(own)
        inverses.append(np.linalg.inv(factor))
        offsets.append(np.log(np.diag(factor)).sum())
    model = Discriminant(centre, scale, means, np.array(inverses), np.array(offsets))
    e = model.evidence(x)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, w = np.column_stack([np.ones(len(e)), e]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), a.T @ (weight * (y - p)) - 1e-6 * w)
        w += np.clip(step, -2, 2)
    order = np.argsort(e, kind="stable")
    gain = np.cumsum(np.where(y[order] == 0, weight[order], -weight[order]))  # cut after each row: zeros below, ones above
    best = int(np.argmax(np.where(np.append(e[order][1:] > e[order][:-1], True), gain, -np.inf)))
    cut = (e[order][best] + e[order][min(best + 1, len(e) - 1)]) / 2
    slope = max(float(w[1]), 1e-3)
    model.curve = (math.log(PREDICT_AT / (1 - PREDICT_AT)) - slope * float(cut), slope)
    return model


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Discriminant | None:
    """The model of at most ``limit`` labelled rows whose crc32(doc_id) mod 5 is not 0; None without both labels.

    Statistics are computed on the executors; only these numbers come to the driver.
    """
    sample = common.labelled_sample(docs, labels, "quality", common.split_of(F.col("doc_id"), 5) != 0, limit)

    def count(batches):
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [statistics(t) for t in batch["text"]]})

    rows = sorted(sample.select("y", "text").mapInPandas(count, "y int, x array<double>").collect())  # TRAIN_ROWS rows of numbers
    y = np.array([r.y for r in rows])
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    return fit(np.array([r.x for r in rows]), y)


def score(text: Column, model: Discriminant | None) -> Column:
    """double from 0 to 1; 0.5 for all where nothing could be learned."""

    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return F.pandas_udf(score, "double").asNondeterministic()(text)


def quality(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. One pass, no shuffle.

    Null and empty texts have the statistics of no words; texts of any length count whole; repeated ids and rows have a
    row each; a null id counts as the empty text in the split; other columns are ignored.
    """
    out = docs.select("doc_id", (common.split_of(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality`` of the whole of ``documents`` by a model of its labelled rows; an empty table has no rows."""
    docs = common.table(spark, sf_dir, "documents")
    return quality(docs, learn(docs, common.table(spark, sf_dir, "labels")))
