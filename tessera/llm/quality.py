"""Quality classification by a regularised quadratic discriminant.

Each text becomes a short row of transformed statistics (lengths, shares of
character kinds, repetition of words, pairs and lines).  Each class has a mean
and a covariance, shrunk towards the pooled covariance and towards its diagonal;
a score is the difference of the classes' log densities (Mahalanobis distances
through Cholesky factors that are computed once), through a logistic link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, documents, mix, table, words

_UPPER, _LOWERC, _DIGIT, _STOP, _SYMBOL, _HIGH = range(6)
_KIND = np.full(256, -1, np.int8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWERC, _DIGIT
for _c in b".,;:?'\"-()":
    _KIND[_c] = _STOP
for _c in b"!#$%&*|@/\\<>=[]{}^_~`+":
    _KIND[_c] = _SYMBOL
_KIND[128:] = _HIGH

#: Shrinkage towards the pooled covariance and towards its diagonal.
POOL, RIDGE = 0.2, 0.02
FEATURES = 20


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text; an empty text has zeros."""
    n = len(bounds) - 1
    w = words(data, bounds)
    nb, nw = np.diff(bounds).astype(float), np.diff(w.first).astype(float)
    own = np.repeat(np.arange(n), np.diff(bounds))
    kind = _KIND[data]
    share = np.stack([np.bincount(own[kind == k], minlength=n) for k in range(6)], axis=1) / np.maximum(nb, 1)[:, None]

    def per(x, weights=None):
        return np.bincount(x, weights, n)

    size = (w.end - w.start).astype(float)
    some = np.maximum(nw, 1)
    mean = per(w.doc, size) / some
    spread = np.sqrt(np.maximum(per(w.doc, size * size) / some - mean * mean, 0))
    name = w.names()

    def repeats(key, doc):
        """(share of distinct keys, share of the commonest) in each text."""
        if not len(key):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((key, doc))
        k, d = key[order], doc[order]
        head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
        many = np.diff(np.append(head, len(k)))
        top = np.zeros(n)
        np.maximum.at(top, d[head], many)
        all_ = np.maximum(per(doc), 1)
        return per(d[head]) / all_, top / all_

    distinct, top = repeats(name, w.doc)
    same = w.doc[1:] == w.doc[:-1] if len(name) else np.zeros(0, bool)
    pair = mix(name[:-1] * np.uint64(3) + name[1:])[same] if len(name) else name
    pairs, top_pair = repeats(pair, w.doc[1:][same] if len(name) else w.doc)
    again = per(w.doc[1:][same & (name[1:] == name[:-1])]) / some if len(name) else np.zeros(n)
    # lines: a line is named by the words it holds
    end = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=end[1:])
    line = end[w.start] if len(name) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1]))) if len(name) else line
    total = np.append(np.uint64(0), np.cumsum(mix(name, 5) * (np.arange(len(name), dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, len(name)))).astype(np.uint64) + np.uint64(1)))) if len(name) else np.zeros(1, np.uint64)
    stop = np.append(first[1:], len(name)) if len(name) else first
    lines = w.doc[first] if len(name) else w.doc
    distinct_lines, _ = repeats(total[stop] - total[first], lines)
    last = data[w.end - 1] if len(name) else data[:0]
    ends = per(w.doc[_KIND[last] == _STOP]) / some
    marked = per(w.doc[_KIND[last] == _SYMBOL]) / some
    initial = data[w.start] if len(name) else data[:0]
    capital = per(w.doc[_KIND[initial] == _UPPER]) / some
    short, long_ = per(w.doc[size <= 2]) / some, per(w.doc[size >= 12]) / some
    root = np.sqrt(share)
    return np.stack(
        [np.log1p(nw), mean, np.log1p(spread), *root.T, distinct, np.sqrt(top), pairs, np.sqrt(top_pair), np.sqrt(again), np.log1p(per(lines)), distinct_lines, ends, np.sqrt(marked), np.sqrt(capital), np.sqrt(short) - np.sqrt(long_)],
        axis=1,
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of statistics) of each whole text; null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in chunks(batch):
                x = statistics(data, bounds)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "x"])

    return documents(docs).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Two classes: prior log odds, means, and inverse Cholesky factors."""

    odds: float
    mean: np.ndarray
    inverse: list[np.ndarray]
    log_det: np.ndarray
    scale: float

    @classmethod
    def fit(cls, count: np.ndarray, total: np.ndarray, square: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
        """From the classes' counts, sums and sums of squares and products."""
        mean = total / np.maximum(count, 1)[:, None]
        cov = square / np.maximum(count, 1)[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * count[:, None, None]).sum(axis=0) / max(count.sum(), 1)
        pooled = pooled + np.eye(len(pooled)) * 1e-6
        inverse, log_det = [], []
        for c, n in zip(cov, count, strict=True):
            w = pool + (1 - pool) * len(pooled) / (len(pooled) + n)  # few rows lean on the pooled covariance
            s = (1 - w) * c + w * pooled
            s = (1 - ridge) * s + ridge * np.diag(np.diag(pooled))
            low = np.linalg.cholesky(s)
            inverse.append(np.linalg.inv(low))
            log_det.append(2 * np.log(np.diag(low)).sum())
        return cls(float(np.log((count[1] + 1) / (count[0] + 1))), mean, inverse, np.array(log_det), 1.0)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        far = [((x - m) @ i.T) for m, i in zip(self.mean, self.inverse, strict=True)]
        d = [(f * f).sum(axis=1) for f in far]
        return self.odds + 0.5 * ((d[0] + self.log_det[0]) - (d[1] + self.log_det[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(x), -40, 40)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total, square = np.zeros(2), np.zeros((2, FEATURES)), np.zeros((2, FEATURES, FEATURES))
    for b in batches:
        if b.num_rows:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            y = np.array(b.column("label"))
            for k in (0, 1):
                z = x[y == k]
                count[k] += len(z)
                total[k] += z.sum(axis=0)
                square[k] += z.T @ z
    flat = np.concatenate([count, total.ravel(), square.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])


def fit(labelled: DataFrame) -> Discriminant | None:
    """labelled: x, label (0 or 1).  Uses all rows; None if a class has none."""
    got = labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(_moments, "i long, v double")
    rows = got.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # a fixed number
    v = np.array([r["v"] for r in rows])
    if not len(v):
        return None
    count, total, square = v[:2], v[2 : 2 + 2 * FEATURES].reshape(2, FEATURES), v[2 + 2 * FEATURES :].reshape(2, FEATURES, FEATURES)
    return Discriminant.fit(count, total, square) if count.min() > 0 else None


def score(made: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id, score in 0..1 (higher: label 1 likelier); without a model 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if model is not None and b.num_rows:
                s = model.score(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return made.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """doc_id, score of each document.

    labels: doc_id, label (0 or 1; others and nulls do not count); learn: which
    of its rows may be learnt from.  Repeated documents are scored row by row;
    repeated labels count each.  Null and empty texts are scored like any other,
    long ones whole; an empty table gives no rows.  Without labels of both classes
    there is no model, and all scores are 0.5.
    """
    made = table(spark, features(docs), "features")
    known = labels.filter(learn).filter("label in (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), "label")
    return score(made, fit(made.join(known, made.doc_id == known["_id"]).select("x", "label")))
