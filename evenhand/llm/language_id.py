"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of ``SEGMENT`` bytes. In each a gated recurrent network reads the
bytes forwards and another one backwards; at every position both states give a probability for
each language, so every position has a label. A document's probabilities are the means over
all its positions, and its language is the most probable one.

The network is trained in numpy by back-propagation through time, on slices of at most
``PER_LANGUAGE`` documents of each language and ``MOST_DOCUMENTS`` in all, but at least one of each
language, drawn by a hash over all rows that it may learn from. No language is left out. Gates are x / (1 + abs(x)), shifted to 0..1 where they need to
be, which costs no exponential. Scoring reads whole texts and shuffles nothing; the weights are
some ten kilobytes.

A text that is null or has no letter is ``und`` with score 0, and so are all texts if there is
nothing to learn from. An empty table gives no rows. Equally probable languages go to the first by name. Rows that share an
id are labelled each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .words import map_slabs, text_bytes

UNKNOWN = "und"
SEGMENT = 128
HIDDEN = 8
BATCH = 2048
MANY = 32
"""Segments are worked on ``BATCH`` at once, or fewer if there are more languages than this."""
PER_LANGUAGE = 600
MOST_DOCUMENTS = 8192
SLICE = 512
STEPS = 120


def block_size(languages: int) -> int:
    return max(16, min(BATCH, MANY * BATCH // max(languages, 1)))


def _squash(x: np.ndarray) -> None:
    """x / (1 + abs(x)), in place."""
    bottom = np.abs(x)
    bottom += 1
    x /= bottom


class Cell:
    """One direction: a table of input weights for each byte and recurrent weights, both for the
    update gate, the reset gate and the new state, one below the other."""

    def __init__(self, table: np.ndarray, recurrent: np.ndarray) -> None:
        self.table, self.recurrent = table, recurrent
        self.hidden = recurrent.shape[1]

    def step(self, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The gates and the next state (rows: units, columns: segments)."""
        n = self.hidden
        x = np.take(self.table, inputs, axis=1)
        g = self.recurrent @ h
        gates = x[:2 * n]
        gates += g[:2 * n]
        _squash(gates)
        gates *= 0.5
        gates += 0.5
        new = gates[n:] * g[2 * n:]
        new += x[2 * n:]
        _squash(new)
        out = h - new
        out *= gates[:n]
        out += new
        return gates, g[2 * n:], new, out

    def back(self, kept: tuple, h: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of a step: of its inputs, of the recurrent weights and of the state before."""
        gates, g, new = kept
        n = self.hidden
        z, r = gates[:n], gates[n:]
        d_new = d_out * (1 - z) * (1 - np.abs(new)) ** 2
        d_z = d_out * (h - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_r = d_new * g * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_g = np.concatenate([d_z, d_r, d_new * r])
        return np.concatenate([d_z, d_r, d_new]), d_g @ h.T, self.recurrent.T @ d_g + d_out * z


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    def cells(self) -> tuple[Cell, Cell]:
        w = self.weights
        return Cell(w["table_f"], w["recurrent_f"]), Cell(w["table_b"], w["recurrent_b"])

    def probabilities(self, text: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities for each position, language and segment. ``text`` has a row for each
        position and a column for each segment of which ``length`` bytes count."""
        forward, backward = self.cells()
        steps, n = text.shape
        w, partial = self.weights, bool(np.any(length < steps))
        out = np.empty((steps, len(self.languages), n), np.float32)
        h = np.zeros((forward.hidden, n), np.float32)
        for t in range(steps):
            h = forward.step(text[t], h)[3]
            np.matmul(w["out_f"], h, out=out[t])
        h = np.zeros((backward.hidden, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h = backward.step(text[t], h)[3]
            if partial:
                h *= t < length
            out[t] += w["out_b"] @ h
        out += w["bias"][:, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, text: np.ndarray, length: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, by back-propagation through time."""
        w, (steps, n) = self.weights, text.shape
        inside = np.arange(steps)[:, None] < length
        states: dict[str, list] = {}
        kept: dict[str, list] = {}
        for name, cell, order in zip("fb", self.cells(), (range(steps), range(steps - 1, -1, -1))):
            h = np.zeros((cell.hidden, n), np.float32)
            states[name], kept[name] = [None] * (steps + 1), [None] * steps
            for t in order:
                gates, g, new, after = cell.step(text[t], h)
                kept[name][t] = (gates, g, new, h)
                h = after * inside[t] if name == "b" else after
                states[name][t] = h
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        total, loss = float(inside.sum()), 0.0
        d_logits = np.empty((steps, len(self.languages), n), np.float32)
        for t in range(steps):
            logits = w["out_f"] @ states["f"][t] + w["out_b"] @ states["b"][t] + w["bias"][:, None]
            logits -= logits.max(axis=0)
            p = np.exp(logits)
            p /= p.sum(axis=0)
            loss -= float((np.log(p[truth, np.arange(n)] + 1e-9) * inside[t]).sum())
            p[truth, np.arange(n)] -= 1
            d_logits[t] = p * (inside[t] / total)
            for name in "fb":
                grads[f"out_{name}"] += d_logits[t] @ states[name][t].T
        grads["bias"] += d_logits.sum(axis=(0, 2))
        order = np.argsort(text.ravel(), kind="stable")
        bytes_, first = np.unique(text.ravel()[order], return_index=True)
        for name, cell, back in zip("fb", self.cells(), (range(steps - 1, -1, -1), range(steps))):
            d_h = np.zeros((cell.hidden, n), np.float32)
            inputs = np.empty((steps, n, 3 * cell.hidden), np.float32)
            for t in back:
                d_out = d_h + w[f"out_{name}"].T @ d_logits[t]
                if name == "b":
                    d_out = d_out * inside[t]
                d_x, d_u, d_h = cell.back(kept[name][t][:3], kept[name][t][3], d_out)
                inputs[t] = d_x.T
                grads[f"recurrent_{name}"] += d_u
            grads[f"table_{name}"][:, bytes_] += np.add.reduceat(inputs.reshape(-1, 3 * cell.hidden)[order], first).T
        return loss / max(total, 1), grads


def segments(data: np.ndarray, offsets: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as columns of ``size`` bytes: the bytes, how many count, and whose text it is."""
    length = np.diff(offsets)
    parts = -(-length // size)
    doc = np.repeat(np.arange(len(length)), parts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][doc] + within * size
    count = np.minimum(size, offsets[1:][doc] - start)
    at = np.minimum(start[None, :] + np.arange(size)[:, None], max(len(data) - 1, 0))
    text = data[at] if len(data) else np.zeros((size, 0), np.uint8)
    text[np.arange(size)[:, None] >= count[None, :]] = 0
    return text, count, doc


def train(texts: list[str], truth: list[str], *, hidden: int = HIDDEN, steps: int = STEPS, batch: int = 512,
          rate: float = 0.02, seed: int = 11) -> Network:
    """A network for the languages in ``truth``, by Adam steps over batches of the segments of ``texts``."""
    rng, names = np.random.default_rng(seed), sorted(set(truth))
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    weights = {"bias": np.zeros(len(names), np.float32)}
    for d in "fb":
        weights |= {f"table_{d}": normal(3 * hidden, 256, scale=0.5), f"recurrent_{d}": normal(3 * hidden, hidden, scale=hidden**-0.5),
                    f"out_{d}": normal(len(names), hidden, scale=hidden**-0.5)}
    net, batch = Network(names, weights), min(batch, block_size(len(names)))
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    text, length, doc = segments(data, offsets)
    label = np.searchsorted(names, truth)[doc]
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    order = np.empty(0, np.int64)
    for done in range(1, steps + 1):
        while len(order) < min(batch, len(label)):
            order = np.concatenate([order, rng.permutation(len(label))])
        own, order = order[:batch], order[batch:]
        _, grads = net.gradients(text[:, own], length[own], label[own])
        now = rate * (1 - 0.9 * done / steps)
        norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grads.values()))))
        for k, g in grads.items():
            g = g / norm
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g**2 - second[k])
            weights[k] -= (now * first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return net


def learning_sample(docs: DataFrame, may_learn: Column, lang_col: str = "lang") -> list[tuple[str, str]]:
    """Slices of texts and their languages: the documents of each language with the least hashes
    under a bound that lets about as many through as are wanted."""
    rows = docs.select(F.col("text").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("hash")).where(
        may_learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    # at least one document of each language, however many there are
    want = min(PER_LANGUAGE, max(1, MOST_DOCUMENTS // len(counts)))
    some = 1.2 * want + 20
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, some / n))])
    near = rows.where(F.pmod("hash", F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    start = F.pmod(F.shiftright("hash", 8), F.greatest(F.lit(1), F.length("text") - SLICE)).cast("int") + 1
    picked = near.select("lang", "hash", F.substring("text", start, F.lit(SLICE)).alias("slice")).orderBy("hash", "lang").limit(
        int(2 * sum(min(n, some) for n in counts.values()) + 1000)).collect()
    taken: dict[str, int] = {}
    out = []
    for lang, _, text in picked:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= want and text:
            out.append((text, lang))
    return out


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network that learned from rows with a language outside the held-out fourth."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    sample = learning_sample(rows.withColumn("text", F.col("text")).where(~frames.held_out()), F.lit(True))
    return train([t for t, _ in sample], [lang for _, lang in sample]) if sample else None


def identify(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score`` (its probability), ``probabilities``
    (of ``net.languages``) and ``rest``, a struct of its columns."""
    rows = frames.packed(docs, id_col, text_col)
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.array().cast("array<double>").alias("probabilities"), "rest")

    def label(table: pa.Table) -> pa.Table:
        text, length, doc = segments(*text_bytes(table["text"]))
        total = np.zeros((table.num_rows, len(net.languages)))
        size = block_size(len(net.languages))
        for at in range(0, len(length), size):
            own = slice(at, at + size)
            p = net.probabilities(text[:, own], length[own])
            if np.any(length[own] < SEGMENT):
                p *= (np.arange(SEGMENT)[:, None] < length[own])[:, None, :]
            np.add.at(total, doc[own], p.sum(axis=0).T.astype(np.float64))
        share = total / np.maximum(np.bincount(doc, length, table.num_rows), 1)[:, None]
        best = share.argmax(axis=1)
        return pa.table({"doc_id": table["doc_id"], "lang_pred": pa.array([net.languages[i] for i in best], pa.string()),
                         "score": pa.array(np.minimum(share[np.arange(len(best)), best], 1.0)),
                         "probabilities": pa.array(list(share), pa.list_(pa.float64())), "letters": table["letters"], "rest": table["rest"]})

    found = map_slabs(rows.withColumn("letters", letters), label,
                      frames.with_rest("doc_id long, lang_pred string, score double, probabilities array<double>, letters boolean", rows), most=2 << 20)
    return found.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"), "probabilities", "rest")


def position_labels(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The label of every position as runs: ``doc_id``, ``start`` and ``length`` in bytes, ``lang``."""
    rows = frames.packed(docs, id_col, text_col).drop("rest")

    def runs(table: pa.Table) -> pa.Table:
        data, offsets = text_bytes(table["text"])
        text, length, _ = segments(data, offsets)
        size = block_size(len(net.languages))
        best = [net.probabilities(text[:, at:at + size], length[at:at + size]).argmax(axis=1) for at in range(0, len(length), size)]
        inside = np.arange(SEGMENT)[:, None] < length
        flat = np.concatenate(best, axis=1).T[inside.T] if best else np.empty(0, np.int64)
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[offsets[:-1][offsets[:-1] < len(flat)]] = True
        at = np.flatnonzero(new)
        doc = np.searchsorted(offsets, at, "right") - 1
        return pa.table({"doc_id": table["doc_id"].take(pa.array(doc)), "start": pa.array(at - offsets[doc], pa.int64()),
                         "length": pa.array(np.diff(at, append=len(flat)), pa.int64()), "lang": pa.array([net.languages[i] for i in flat[at]], pa.string())})

    return map_slabs(rows, runs, "doc_id long, start long, length long, lang string", most=2 << 20)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = frames.documents(spark, folder)
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", frames.held_out().alias("held_out"), "lang_pred", "score")
