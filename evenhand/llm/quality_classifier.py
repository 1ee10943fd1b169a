"""Quality scores by logistic regression on hashed word n-grams.

Features are single words, pairs of words, and the same of word shapes, in which a run of
lower-case letters, of upper-case letters, of digits or of other non-ASCII bytes is one sign; a
pair of equal words or shapes counts as one feature of its own kind. All are hashed into ``2**BITS`` weights;
a feature's value is its share of the document's features of that kind times ``SCALE``.

Weights are learned in numpy by the follow-the-regularised-leader rule with a rate of its own for
each weight, from at most ``PER_LABEL`` rows of documents of each label, drawn by hashes over all
rows that it may learn from, and cut on Spark, so that an id with many rows brings no more; the bias then corrects for the shares of the labels among all of these.
Scoring a document is one sparse dot product over its whole text, and shuffles nothing.

A null or empty text has no features and gets the score of the bias. Without labels all scores
are a half. Labels that are null or not 0 or 1, and labels without a document, are not learned from. Several labels
of one document are learned from each for itself.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .words import SPACED, Words, map_slabs, mix, pack, span_hashes, text_bytes, unpack

BITS = 18
SCALE = 8.0
PER_LABEL = 2000
EPOCHS = 2
THRESHOLD = 0.7

_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[0x61:0x7B], _SIGNS[0x41:0x5B], _SIGNS[0x30:0x3A], _SIGNS[0x80:] = ord("a"), ord("A"), ord("0"), 0xFF
_KINDS = 4


def features(table: pa.Table) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """For each kind: a weight's number for each feature, and the word where it begins."""
    w = Words(*text_bytes(table["text"]), SPACED)
    signs = _SIGNS[w.data]
    new = np.ones(len(signs), bool)
    new[1:] = signs[1:] != signs[:-1]
    new[w.starts] = True
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])
    shapes = span_hashes(signs[new], before[w.starts], before[w.ends])
    pair = np.flatnonzero(np.arange(1, w.n + 1) < np.repeat(w.first[1:], w.counts))
    out = []
    for kind, h in enumerate((w.hashes(lower=True), shapes)):
        a, b = h[pair], h[pair + 1]
        both = np.where(a == b, np.uint64(1), mix(a) + b)
        for salt, values, at in ((2 * kind + 1, h, np.arange(w.n)), (2 * kind + 2, both, pair)):
            out.append(((mix(values, salt * 0x9E3779B97F4A7C15 % 2**64) >> np.uint64(64 - BITS)).astype(np.int64), at))
    return w, out


class Regression:
    """Follow the regularised leader: from the sums of gradients and of their squares the weights
    follow in closed form."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.bias_n = 0.0, 1.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g0 = 1 / (1 + np.exp(-np.clip(w @ x + self.bias, -35, 35))) - label
        g = g0 * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        self.bias_n += g0 * g0
        self.bias -= self.alpha * g0 / np.sqrt(self.bias_n)


def sparse(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's weights' numbers and values, equal features added up."""
    w, kinds = features(table)
    out = []
    for d in range(table.num_rows):
        numbers, values = [], []
        for number, at in kinds:
            a, b = np.searchsorted(at, [w.first[d], w.first[d + 1]])
            if b > a:
                own, n = np.unique(number[a:b], return_counts=True)
                numbers.append(own)
                values.append(n * (SCALE / (b - a)))
        if numbers:
            own, back = np.unique(np.concatenate(numbers), return_inverse=True)
            out.append((own, np.bincount(back, np.concatenate(values))))
        else:
            out.append((np.empty(0, np.int64), np.empty(0)))
    return out


def train(sample: list[tuple[np.ndarray, np.ndarray, int]], share: float, *, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias; ``share`` is that of label 1 among all rows to learn from."""
    model, rng = Regression(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(sample)):
            model.learn(*sample[i])
    own = np.clip(np.mean([s[2] for s in sample]), 1e-3, 1 - 1e-3)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return model.weights().astype(np.float32), float(model.bias + np.log(share / (1 - share)) - np.log(own / (1 - own)))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_label: int = PER_LABEL, may_learn: Column | None = None) -> tuple[np.ndarray, float] | None:
    """A model of the labels outside the held-out fourth; None without any."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        (~frames.held_out() if may_learn is None else may_learn) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = dict(marked.groupBy("label").count().collect())
    if not counts:
        return None
    keep = F.lit(False)
    for label, n in sorted(counts.items()):
        keep = keep | ((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id", "label"), F.lit(1 << 30)) < min(1.0, 1.2 * per_label / n) * (1 << 30)))
    few = marked.where(keep).withColumn("draw", F.xxhash64("doc_id", "label"))
    ids = few.orderBy("draw").limit(4 * per_label)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "label", "text"))
    parts = [rows.where(F.col("label") == label).orderBy("draw", "doc_id").limit(per_label) for label in sorted(counts)]
    rows = functools.reduce(DataFrame.unionAll, parts)

    def extract(table: pa.Table) -> pa.Table:
        blobs = [pack(at.astype(np.uint32), x.astype(np.float32)) for at, x in sparse(table)]
        return pa.table({"draw": table["draw"], "label": table["label"], "features": pa.array(blobs, pa.binary())})

    found = map_slabs(rows, extract, "draw long, label int, features binary").collect()
    sample = []
    for _, label, blob in sorted(found, key=lambda r: (r[0], r[2])):
        at, x = unpack(blob)
        sample.append((at.astype(np.int64), x.astype(np.float64), label))
    return train(sample, counts.get(1, 0) / sum(counts.values())) if sample else None


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``score`` (the chance of label 1) and ``rest``, a struct of its columns."""
    rows = frames.packed(docs, id_col, text_col)
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), "rest")
    held, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def judge(table: pa.Table) -> pa.Table:
        w, kinds = features(table)
        total = np.full(table.num_rows, bias)
        for number, at in kinds:
            sums = np.concatenate([np.zeros(1), np.cumsum(held.value[number], dtype=np.float64)])
            own = np.searchsorted(at, w.first)
            total += (sums[own[1:]] - sums[own[:-1]]) * SCALE / np.maximum(np.diff(own), 1)
        return pa.table({"doc_id": table["doc_id"], "score": pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))), "rest": table["rest"]})

    return map_slabs(rows, judge, frames.with_rest("doc_id long, score double", rows))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = frames.documents(spark, folder).select("doc_id", "text")
    scores = score(docs, learn(docs, frames.documents(spark, folder, "labels")))
    return scores.select("doc_id", frames.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
