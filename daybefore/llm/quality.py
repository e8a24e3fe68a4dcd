"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives thirteen statistics, transformed so that they are roughly bell-shaped within a
class.  Count, mean and covariance of either class come from one Spark aggregate over *all*
labelled training rows (sums and sums of products, a fixed few hundred numbers).  The
covariance of a class is shrunk towards the pooled one, and that towards its diagonal.  The score is
the posterior probability of label 1: the prior log-odds plus the difference of the log
densities, by Mahalanobis distances through Cholesky factors computed once on the driver.

Edge rows: null and empty texts have all statistics 0 and get a score like any other; labels null
or other than 0 and 1 are left out; a document labelled several times counts once, by its mean
label; with only one class labelled the score is that class, with none 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybefore.llm.common import arrow_map, document_columns, held_out, stored

FOLDS = 5
THRESHOLD = 0.3
#: Share of the pooled covariance in a class's own, and of the diagonal in the result.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_STOP = np.isin(np.arange(256), list(b".,;:'\"()-"))
_ASCII_MARK = (np.arange(256) > 32) & (np.arange(256) < 127) & ~(_UPPER | _LOWER | _DIGIT)
_KINDS = np.stack([_UPPER, _DIGIT, _ASCII_MARK & _STOP, _ASCII_MARK & ~_STOP]).astype(float)
SIZE = 13


def statistics(text: str) -> np.ndarray:
    """Transformed statistics of a whole text."""
    out = np.zeros(SIZE)
    raw = text.encode()
    if not raw:
        return out
    words, lines = raw.split(), raw.split(b"\n")
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    shares = _KINDS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    out[0] = np.log1p(len(raw))
    out[1] = np.log1p(len(words))
    out[2:6] = np.arcsin(np.sqrt(shares))
    out[6] = np.log1p(lengths.mean())
    out[7] = np.log1p(lengths.std())
    out[8] = np.arcsin(np.sqrt(len(set(words)) / count)) if words else 0
    out[9] = np.arcsin(np.sqrt(len(set(lines)) / len(lines)))
    out[10] = np.log1p(len(words) / len(lines))
    out[11] = np.arcsin(np.sqrt(sum(map(bytes.istitle, words)) / count))
    out[12] = np.arcsin(np.sqrt(sum(map(eq, words, words[1:])) / count))
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    keys = ["doc_id", "row"] if row_col else ["doc_id"]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * SIZE, pa.int32()), pa.array(flat))
            return pa.RecordBatch.from_arrays([*map(batch.column, keys), lists], [*keys, "x"])
        return run
    return arrow_map(document_columns(docs, id_col, text_col, row_col), make, ", ".join(f"{k} long" for k in keys) + ", x array<double>")


@dataclass(frozen=True)
class Model:
    """Per class log prior, mean and inverse Cholesky factor; ``only`` where a class is missing."""
    prior: np.ndarray | None
    means: np.ndarray | None
    factors: np.ndarray | None
    half_logdet: np.ndarray | None
    only: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        log = [self.prior[k] - self.half_logdet[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(feature_rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """Fit on every labelled document whose id isn't held out."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
             .filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, 0))
             .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")))
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    x = [F.col("x")[i] for i in range(SIZE)]
    sums = (feature_rows.join(known, "doc_id").groupBy("label")
            .agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs])
            .collect())  # two rows
    by = {r["label"]: r for r in sums}
    if len(by) < 2:
        return Model(None, None, None, None, float(next(iter(by))) if by else 0.5)
    n = np.array([by[k]["n"] for k in (0, 1)], float)
    means = np.array([[by[k][f"s{i}"] for i in range(SIZE)] for k in (0, 1)]) / n[:, None]
    scatter = np.zeros((2, SIZE, SIZE))
    for k in (0, 1):
        for i, j in pairs:
            scatter[k, i, j] = scatter[k, j, i] = by[k][f"p{i}_{j}"] - n[k] * means[k, i] * means[k, j]
    pooled = scatter.sum(0) / n.sum()
    factors, half = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(SIZE)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        half.append(np.log(np.diag(lower)).sum())
    return Model(np.log(n / n.sum()), means, np.array(factors), np.array(half))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """``doc_id`` (and ``row`` if named), ``held_out``, ``score`` and ``predicted`` for every row; each text is read once."""
    keys = ["doc_id", "row"] if row_col else ["doc_id"]
    rows = stored(features(docs, id_col, text_col, row_col))
    model = fit(rows, labels, id_col, label_col)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("x")
            x = np.asarray(lists.flatten()).reshape(len(lists), SIZE)
            return pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(model.scores(x), pa.float64())], [*keys, "score"])
        return run
    out = arrow_map(rows, make, ", ".join(f"{k} long" for k in keys) + ", score double")
    return out.select(*keys, held_out(F.col("doc_id"), FOLDS, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
