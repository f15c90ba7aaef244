"""Quality by regularised quadratic discriminants over transformed document statistics.

Each class has its own mean and covariance, from sums and products added up over all labelled
training rows; the covariance is shrunk towards the pooled diagonal, so it can be inverted whatever
the sample. A text's score starts from the difference of the two log densities, each a squared
Mahalanobis distance by the class's Cholesky factor, which is inverted once. A logistic curve,
fitted to counts of that difference per label, makes it a probability.

Defined results: null or empty texts have statistics like any other and a score; without both
classes in the training rows every score is the share of label 1 among them (0 without any);
labels that are null are not used; of several labels of a document the highest counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from evalgrid.session import cut_lineage

SHRINK = 0.1  # share of the pooled diagonal in each class's covariance
FLOOR = 1e-4  # variance that is added to every statistic
BINS = 64.0  # bins per unit of the compressed density difference
_SYMBOLS, _MARKS, _DIGITS = b"#*$%&|<>", b".,;:!?", b"0123456789"
_LOUD = re.compile(rb"[!?]{2,}")
STATISTICS = [
    "log words", "log word length", "spread of word length", "symbols", "marks", "repeated marks", "digits", "capitals",
    "different words", "commonest word", "word as the one before", "different lines", "log line length", "non-ASCII", "compressed size",
]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of STATISTICS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    seen = dict.fromkeys(words, 0)
    for w in words:
        seen[w] += 1
    strip = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    capitals = sum(map(str.isupper, text)) / max(1, len(text)) if not raw.isascii() else strip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [
        np.log1p(len(words)),
        np.log1p(lengths.sum() / n),
        np.log1p(lengths.std()) if len(words) else 0.0,
        np.sqrt(strip(_SYMBOLS)),
        np.sqrt(strip(_MARKS)),
        np.sqrt(len(_LOUD.findall(raw)) / n),
        np.sqrt(strip(_DIGITS)),
        np.sqrt(capitals),
        len(seen) / n,
        np.sqrt(max(seen.values(), default=0) / n),
        np.sqrt(sum(map(bytes.__eq__, words[1:], words)) / n),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(size / max(1, len(lines))),
        np.sqrt(1 - len(text) / size) if raw else 0.0,
        np.log(max(1, len(zlib.compress(raw, 1)) - 8) / size + 0.05),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], index=texts.index, dtype=object)


@dataclass
class Discriminant:
    """Means and inverted Cholesky factors of both classes, and the logistic curve over them."""

    means: np.ndarray | None = None
    roots: np.ndarray | None = None
    logdet: np.ndarray | None = None
    curve: tuple[float, float] = (0.0, 0.0)
    share: float = 0.0

    @classmethod
    def of_sums(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
        """From counts (2), sums (2, p) and sums of products (2, p, p) per class."""
        total = float(n.sum())
        out = cls(share=float(n[1]) / total if total else 0.0)
        if min(n) < 1:
            return out
        out.means = sums / n[:, None]
        cov = products / n[:, None, None] - out.means[:, :, None] * out.means[:, None, :]
        pooled = np.diag((n[:, None, None] * cov).sum(axis=0) / total).copy()
        cov = (1 - SHRINK) * cov + SHRINK * np.diag(pooled) + FLOOR * np.eye(sums.shape[1])
        factors = np.linalg.cholesky(cov)
        out.roots = np.linalg.inv(factors)
        out.logdet = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
        return out

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, compressed far from zero."""
        d = [((x - m) @ r.T) ** 2 for m, r in zip(self.means, self.roots)]
        s = 0.5 * (d[0].sum(axis=1) + self.logdet[0] - d[1].sum(axis=1) - self.logdet[1])
        return np.arcsinh(s / 2)

    def fit_curve(self, s: np.ndarray, label: np.ndarray, count: np.ndarray) -> None:
        x, w, ridge = np.c_[np.ones(len(s)), s], np.zeros(2), 1e-2
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            h = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
            w = w + np.clip(np.linalg.solve(h, x.T @ (count * (label - p)) - ridge * w), -5, 5)
        self.curve = float(w[0]), float(w[1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.difference(x), -50, 50)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: count, sums and products, as (label, place, value)."""
    p = len(STATISTICS)
    n, s, q = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for batch in batches:
        x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
        for k in (0, 1):
            part = x[y == k]
            n[k] += len(part)
            s[k] += part.sum(axis=0)
            q[k] += part.T @ part
    flat = np.concatenate([n[:, None], s, q.reshape(2, -1)], axis=1)
    places = np.tile(np.arange(flat.shape[1], dtype=np.int32), 2)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.int32([0, 1]), flat.shape[1])), pa.array(places), pa.array(flat.ravel())], ["label", "place", "value"])


def with_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep` and the statistics of each document, from one pass over the texts, written once."""
    return cut_lineage(docs.select(*keep, _statistics("text").alias("x")))


def learn(stats: DataFrame, labels: DataFrame, allowed: Column) -> Discriminant:
    """Fit to all labelled rows that `allowed` (over doc_id) lets in. stats: doc_id, x."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
    train = cut_lineage(stats.select("doc_id", "x").join(known, "doc_id").select("x", "label"))
    p = len(STATISTICS)
    flat = np.zeros((2, 1 + p + p * p))
    for r in train.mapInArrow(_sums, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        flat[r["label"], r["place"]] = r["value"]
    model = Discriminant.of_sums(flat[:, 0], flat[:, 1 : 1 + p], flat[:, 1 + p :].reshape(2, p, p))
    if model.means is None:
        return model

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.floor(model.difference(_matrix(batch.column(0))) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], ["bin", "label"])

    rows = train.mapInArrow(bins, "bin int, label int").groupBy("bin", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    got = np.array([(r["bin"], r["label"], r["n"]) for r in sorted(rows)], float)
    model.fit_curve((got[:, 0] + 0.5) / BINS, got[:, 1], got[:, 2])
    return model


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Adds `score` in place of the statistics."""

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_list()) if len(x) else np.zeros((0, len(STATISTICS)))
        return pd.Series(model.scores(rows), index=x.index)

    return stats.withColumn("score", scored("x")).drop("x")
