"""Toxicity scores by logistic regression with the FTRL-proximal update, over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, pairs of neighbours and pairs with one word between, words
in lower case without outer punctuation. The update has a rate for each coordinate and an L1 penalty that leaves most
weights exactly zero, so the table that scoring tasks receive has a fixed size of 2**BITS at most.

Training reads at most TRAIN_ROWS labelled rows, those of least hashed doc_id, in an order of their own; scoring reads
all rows. The rates and penalties were chosen by cross-validation among rows that labels may be learned from.

Toxic rows are few, so the model's own probabilities stay low on rows that it has not seen. The training rows are
therefore scored by models of the other folds, and the bias is moved so that the cut of best F1 among them falls on the
threshold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.staging import table
from . import caches

BITS = 20
TRAIN_ROWS = 10_000
#: Features (four bytes each) of all training rows: the sample ends with the row that reaches it, so very long texts stay within a task's memory.
TRAIN_ENTRIES = 40_000_000
EPOCHS = 8
#: Texts of a batch that are Python strings at once.
SLICE = 500
#: Parts of the training rows that are scored by a model of the others.
FOLDS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
THRESHOLD = 0.7

#: Buckets (the bias is 2**BITS) and their weights, only those that are not zero.
Weights = tuple[np.ndarray, np.ndarray]

_OUTER = re.compile(r"^\W+|\W+$")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        bare = _OUTER.sub("", word.lower())
        h = self[word] = xxhash.xxh3_64_intdigest(bare) if bare else 0
        return h


_words = _Words()
caches.register("toxicity", _words.clear)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets; none for a null or empty text."""
    caches.claim("toxicity")
    if len(_words) > 300_000:
        _words.clear()
    w = (text if isinstance(text, str) else "").split()
    h = np.fromiter(map(_words.__getitem__, w), dtype=np.uint64, count=len(w))
    h = h[h != 0]
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    m = np.uint64(0x9E3779B97F4A7C15)
    grams = [h, h[:-1] * m + (h[1:] ^ np.uint64(0xA5A5)), h[:-2] * m + (h[2:] ^ np.uint64(0x5A5A5A))]
    x = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((x >> np.uint64(64 - BITS)).astype(np.int64))


class Ftrl:
    """FTRL-proximal for binary features, with a bias that carries no penalty."""

    def __init__(self, size: int = 1 << BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, buckets: np.ndarray, label: int) -> None:
        i = np.append(buckets, self.bias)
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[i]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] = n + g * g

    def table(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def logit(weights: np.ndarray, buckets: np.ndarray) -> float:
    return float(weights[buckets].sum(dtype=np.float64)) + float(weights[-1])


def score(weights: np.ndarray, buckets: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit(weights, buckets), -35, 35))))


def fitted(data: list[tuple[np.ndarray, int]], epochs: int) -> np.ndarray:
    model = Ftrl()
    for _ in range(epochs):
        for x, y in data:
            model.update(x, y)
    return model.table()


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """The middle between the two neighbouring scores that part the labels with the best F1 (ties: the highest); None where nothing can be parted."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    ends = np.flatnonzero(s[:-1] > s[1:])
    if not len(ends) or not 0 < y.sum() < len(y):
        return None
    best = ends[np.argmax(2 * np.cumsum(y)[ends] / (ends + 1 + y.sum()))]
    return float(s[best] + s[best + 1]) / 2


def calibrated(data: list[tuple[np.ndarray, int]], epochs: int, threshold: float, folds: int = FOLDS) -> np.ndarray:
    """The weights learned from (buckets, label), with the bias moved as above; as they are where labels are all alike."""
    w = fitted(data, epochs)
    labels = np.array([y for _, y in data], dtype=np.int64)
    scores = np.zeros(len(data))
    for f in range(folds):
        apart = fitted([d for i, d in enumerate(data) if i % folds != f], epochs)
        for i in range(f, len(data), folds):
            scores[i] = logit(apart, data[i][0])
    cut = best_cut(scores, labels)
    if cut is not None:
        w[-1] += np.log(threshold / (1 - threshold)) - cut
    return w


def held_out(doc_id) -> F.Column:
    """Rows that no label may be learned from: crc32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(_label_id, text, toxic, at) of the labelled rows to learn from; at orders them."""
    usable = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("_toxic")).where("_label_id IS NOT NULL AND _toxic IS NOT NULL").where(~held_out("_label_id"))
    sample = usable.orderBy(F.xxhash64("_label_id"), "_label_id", "_toxic").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_label_id"))  # at most `rows` ids
    return joined.select("_label_id", "text", F.col("_toxic").alias("toxic"), F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "_toxic").cast("binary")).alias("at"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, entries: int = TRAIN_ENTRIES, threshold: float = THRESHOLD) -> Weights:
    """The weights from the labels.toxic of rows that are not held out; none without labels.

    Of rows with the same doc_id and label one is learned, that of the least features, before they meet in one task.

    Features are made where the texts are; one task holds those of the sample (four bytes each, at most `entries` and
    the last row) and learns, so the driver receives only the weights that are not zero.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                f = [features(t).astype("<i4").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_label_id", "toxic", "at")), pa.array(f, pa.binary())], ["id", "toxic", "at", "f"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[tuple[np.ndarray, int]] = []
        n = 0
        for b in batches:
            for f, y in zip(b.column("f"), b.column("toxic").to_pylist(), strict=True):
                if n < entries:
                    data.append((np.frombuffer(f.as_py(), "<i4").copy(), y))
                    n += len(data[-1][0])
        w = calibrated(data, epochs, threshold) if data else np.zeros(1, np.float32)
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(w[i])], ["bucket", "weight"])

    sample = _sample(docs, labels, rows)
    id_type = sample.schema["_label_id"].dataType.simpleString()
    made = sample.mapInArrow(hashed, f"id {id_type}, toxic int, at long, f binary").groupBy("id", "toxic", "at").agg(F.min("f").alias("f"))
    one = made.select("toxic", "at", "f").repartition(1).sortWithinPartitions("at", "toxic", "f")  # the bounded sample
    found = sorted((r.bucket, r.weight) for r in one.mapInArrow(learned, "bucket int, weight float").collect())  # 2**BITS + 1 rows at most
    return np.array([b for b, _ in found], dtype=np.int32), np.array([w for _, w in found], dtype=np.float32)


def _dense(weights: Weights) -> np.ndarray:
    w = np.zeros((1 << BITS) + 1, dtype=np.float32)
    w[weights[0]] = weights[1]
    return w


def scorer(spark: SparkSession, weights: Weights) -> Callable[[str], Column]:
    """A function from a text column to its score in 0..1 (null: as an empty text, which has the bias only)."""
    shared = spark.sparkContext.broadcast(weights)

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = _dense(shared.value)
        for part in texts:
            slices = (part.slice(at, SLICE).to_pylist() for at in range(0, len(part), SLICE))
            yield pa.array([score(w, features(t)) for s in slices for t in s], pa.float64())

    return F.arrow_udf(scores, "double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents (doc_id, text).

    Null and empty texts get the bias's score. Repeated rows and ties score alike; a score at the threshold is 1. Texts
    of any length are read whole. Without usable labels every score is 0.5. A null doc_id is not held out. An empty
    table gives no rows. Other columns are not read.
    """
    scored = docs.select("doc_id", scorer(docs.sparkSession, train(docs, labels, rows, threshold=threshold))("text").alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    return docs.where(scorer(docs.sparkSession, train(docs, labels, threshold=threshold))("text") < threshold)


def op10_toxicity_ftrl(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
