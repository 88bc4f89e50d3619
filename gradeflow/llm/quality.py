"""Quality by ordinal cumulative-link regression on graded ratings (operator 5).

Grades 0 .. K-1 share one weight vector over hashed text features; K-1 ordered thresholds cut the score:
P(grade <= k) = logistic(threshold_k - w.x). A text's features are the shares of its words that fall into each
bucket: one bucket for each word in lower case, one for its shape (kinds of its first, second, last but one and last
bytes, and its length). From the score follow the expected grade and the probability of a grade of at least
``tail``, by which documents are selected.

Bounds: the fit looks at ``MOST_FITTED`` rows at most; the weights are 2 ** ``FEATURE_BITS`` numbers whatever the data.

Edge cases: null and empty texts, or texts of white space, have no features and score 0; without labels, or with one
grade only, the expected grade is that grade (0 without any); labels that are null are ignored; very long texts are read whole; rows that repeat are
each scored; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .textkernel import LOWER, NOT_SPACE, U64, find_words, hash_spans, mix, slices, text_bytes

#: Labelled rows that the fit looks at, at most; the driver holds some 2 KB of each.
MOST_FITTED = 12_000
#: Buckets of the features; steps, step size and shrinkage of the fit; grade whose tail is reported.
FEATURE_BITS, STEPS, RATE, SHRINK = 17, 150, 0.5, 2e-6
#: Kinds of bytes: lower case, upper case, digits, beyond ASCII, and each sign by itself.
KIND = np.arange(256, dtype=np.uint64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 97, 65, 48, 128


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, its bucket, features by row): two for each word."""
    w = find_words(raw, offs, NOT_SPACE)
    row, size = w.row_of(), w.ends - w.starts
    word = hash_spans(LOWER[raw], w.starts, w.ends) if len(raw) else np.zeros(0, U64)
    kind = lambda at: KIND[raw[at]]
    shape = kind(w.starts) | kind(np.minimum(w.starts + 1, w.ends - 1)) << U64(8) | kind(np.maximum(w.ends - 2, w.starts)) << U64(16) | kind(w.ends - 1) << U64(24) | np.minimum(size, 15).astype(U64) << U64(32)
    top = U64(64 - FEATURE_BITS + 1)  # the upper half for shapes
    bucket = np.concatenate([mix(word) >> top, (mix(shape) >> top) + U64(1 << FEATURE_BITS - 1)]).astype(np.int64)
    return np.concatenate([row, row]), bucket, 2 * w.counts


@dataclass
class OrdinalModel:
    """weights by bucket; thresholds in order; grades: their values."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """w.x of each row."""
        row, bucket, n = features(raw, offs)
        return np.bincount(row, self.weights[bucket], len(offs) - 1) / np.maximum(n, 1)

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds, -50, 50)))

    def expected(self, x: np.ndarray) -> np.ndarray:
        """Expected grade of each row."""
        return self.grades[0] + self.above(x) @ np.diff(self.grades)


def fit_ordinal(rows: np.ndarray, buckets: np.ndarray, shares: np.ndarray, y: np.ndarray, grades: np.ndarray) -> OrdinalModel:
    """Weights and thresholds by Adam steps on the mean log loss. y: index of each row's grade."""
    n, k, size = len(y), len(grades) - 1, 1 << FEATURE_BITS
    w = np.zeros(size)
    at_most = np.clip(np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / max(1, n), 1e-3, 1 - 1e-3)
    t = np.log(at_most / (1 - at_most))
    free = np.concatenate([t[:1], np.log(np.expm1(np.maximum(np.diff(t), 1e-3)))])  # first threshold, then gaps
    par = [w, free]
    first, second = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for step in range(1, STEPS + 1):
        gap = np.log1p(np.exp(free[1:]))
        t = free[0] + np.concatenate([[0.0], np.cumsum(gap)])
        x = np.bincount(rows, shares * w[buckets], n)
        up = np.concatenate([t, [np.inf]])[y] - x
        low = np.concatenate([[-np.inf], t])[y] - x
        f = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        a, b = np.where(np.isinf(up), 1.0, f(up)), np.where(np.isinf(low), 0.0, f(low))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        gx = (da - db) / n
        gt = np.bincount(y, -da / n, k + 1)[:k] + np.bincount(y, db / n, k + 1)[1:]
        tail = np.cumsum(gt[::-1])[::-1]
        grads = [np.bincount(buckets, shares * gx[rows], size) + SHRINK * w, np.concatenate([tail[:1], tail[1:] * f(free[1:])])]
        for q, g, m, v, rate in zip(par, grads, first, second, (RATE, 0.05), strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    t = free[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(free[1:])))])
    return OrdinalModel(w, t, grades.astype(float))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_FITTED) -> OrdinalModel:
    """The model of a bounded sample of the labelled rows of the training fold."""
    rows = labelled.sample(docs, labels, label, ~is_held_out(), most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            for a, b in slices(raw, offs):
                row, bucket, n = features(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                key, count = np.unique(row << FEATURE_BITS | bucket, return_counts=True)
                own, share = key >> FEATURE_BITS, (count / np.maximum(n, 1)[key >> FEATURE_BITS]).astype("<f4")
                edges = np.searchsorted(own, np.arange(1, b - a))
                columns = [[p.tobytes() for p in np.split(x, edges)] for x in ((key & (1 << FEATURE_BITS) - 1).astype("<i4"), share)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), *(pa.array(c, pa.binary()) for c in columns)], names=["label", "buckets", "shares"])

    # bounded: ``most`` rows
    found = rows.select("text", "label").mapInArrow(vectors, "label int, buckets binary, shares binary").collect()
    y = np.array([r.label for r in found], dtype=np.int64)
    grades, y = np.unique(y, return_inverse=True)
    if len(grades) < 2:
        return OrdinalModel(np.zeros(1 << FEATURE_BITS), np.zeros(0), grades.astype(float) if len(grades) else np.zeros(1))
    own = [np.frombuffer(r.buckets, "<i4") for r in found]
    return fit_ordinal(np.repeat(np.arange(len(found)), [len(x) for x in own]), np.concatenate(own).astype(np.int64), np.concatenate([np.frombuffer(r.shares, "<f4") for r in found]).astype(float), y, grades)


def is_held_out():
    """Rows that the fit never sees: a third, by the identifier's crc32."""
    return F.pmod(labelled.id_crc(F.col("doc_id")), F.lit(3)) == 1


def grade(docs: DataFrame, model: OrdinalModel, tail: float = 1.0) -> DataFrame:
    """(doc_id, expected_grade, tail_probability: of a grade of at least ``tail``) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = int(np.searchsorted(m.grades, tail)) - 1  # the threshold below the tail
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            for a, b in slices(raw, offs):
                x = m.scores(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                p = np.full(len(x), float(k < 0)) if not 0 <= k < len(m.thresholds) else m.above(x)[:, k]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(m.expected(x)), pa.array(p)], names=["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(rate, "doc_id long, expected_grade double, tail_probability double")


def select(docs: DataFrame, model: OrdinalModel, tail: float, least: float) -> DataFrame:
    """``docs`` whose tail probability is at least ``least``; all columns are kept, nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = int(np.searchsorted(m.grades, tail)) - 1
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            x = np.concatenate([m.scores(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(raw, offs)] or [np.zeros(0)])
            p = np.full(len(x), float(k < 0)) if not 0 <= k < len(m.thresholds) else m.above(x)[:, k]
            yield batch.filter(pa.array(p >= least))

    return docs.mapInArrow(keep, docs.schema)
