"""Substring deduplication with a count-min prefilter.

A window is ``window`` consecutive words of one document. A word is removed if a window that
covers it has the word sequence of a window that starts earlier (smaller id, or the same
document and an earlier start). Windows are judged on the input, not on what is left.

Documents are dealt by id into blocks of bounded text. Then:

1. Every block sketches its distinct windows: for each of ``depth`` hash rows the cells that
   they touch. Slices of the sketches are merged, each in a task of its own, and a block hears
   which of its cells another block touched too. A cell count is never less than the count of
   any window in it, so no window that repeats across blocks can be missed.
2. A block sends the fingerprint of each window estimated to repeat, once per distinct window.
   Fingerprints are grouped exactly, and a block hears for which of its windows an earlier
   document has the first start. Repeats within a block are found exactly in the block.

What is shuffled is the text once, about three bytes per window for the sketches, and some
fifteen for each window estimated to repeat. The sketch has no fixed size: its slices grow in
number with the text and nothing is broadcast. A passage that all documents hold is one
message per block, so no key gathers rows. Fingerprints have 96 bits.

Nulls and texts without words have no words and keep none. Rows that share an id count in the
order of their texts; a null id counts as the smallest. Documents with fewer than ``window``
words lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .words import SPACED, Words, deltas, mix, pack, release, text_bytes, undeltas, unpack, window_hashes

WINDOW = 20
BLOCK_BYTES = 6 << 20
LEAST_BLOCKS = 64
CELLS_PER_WINDOW = 8
SLICE_WINDOWS = 1 << 21


def _bits(n: float) -> int:
    return max(1, int(np.ceil(np.log2(max(n, 2)))))


def _ordered(table: pa.Table) -> pa.Table:
    keys = table.select(["doc_id", "text"])
    return table.take(pc.sort_indices(
        keys, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))


class _Windows:
    """The windows of a block, in the order of documents and starts."""

    def __init__(self, table: pa.Table, size: int) -> None:
        self.words = Words(*text_bytes(table["text"]), SPACED)
        hashes = self.words.hashes()
        self.at = self.words.windows(size)
        self.h1 = window_hashes(hashes, self.at, size)
        self.h2 = (window_hashes(hashes, self.at, size, 1) >> np.uint64(32)).astype(np.uint32)
        self.size = size

    def firsts(self) -> np.ndarray:
        """Whether each window is the first of its word sequence in the block."""
        order = np.argsort(self.h1, kind="stable")
        a, b = self.h1[order], self.h2[order]
        same = a[1:] == a[:-1]
        if np.any(same & (b[1:] != b[:-1])):  # two sequences with one first hash
            order = np.lexsort((self.h2, self.h1))
            a, b = self.h1[order], self.h2[order]
            same = a[1:] == a[:-1]
        out = np.ones(len(order), bool)
        out[order[1:][same & (b[1:] == b[:-1])]] = False
        return out

    def cells(self, row: int, bits: int) -> np.ndarray:
        return mix(self.h1, 0x2545F4914F6CDD1D * (row + 1)) >> np.uint64(64 - bits)

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """Which words the windows ``hit`` cover."""
        change = np.zeros(self.words.n + 1, np.int32)
        np.add.at(change, self.at[hit], 1)
        np.add.at(change, self.at[hit] + self.size, -1)
        return np.cumsum(change[:-1]) > 0


def _split(values: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Runs of ascending values that share their leading bits: (leading bits, from, to)."""
    if not len(values):
        return []
    top = (values >> np.uint64(shift)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(top)]))
    return [(int(top[a]), int(a), int(b)) for a, b in itertools.pairwise(cuts)]


def _column(table: pa.Table, name: str) -> list:
    return table[name].to_pylist()


def _tidy(fn: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``fn`` of a group or of a pair of groups, after which freed memory goes back."""
    if fn.__code__.co_argcount == 3:
        def two(key: tuple, table: pa.Table, other: pa.Table) -> pa.Table:
            out = fn(key, table, other)
            release()
            return out

        return two

    def one(key: tuple, table: pa.Table) -> pa.Table:
        out = fn(key, table)
        release()
        return out

    return one


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    depth: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``kept`` (kept words joined by one space), ``n_words``,
    ``n_removed``, and ``rest``, a struct of all its columns."""
    frames.small_batches(docs.sparkSession)
    total = frames.text_total(docs, text_col)
    blocks = max(LEAST_BLOCKS, -(-total // block_bytes))
    cell_bits = min(56, _bits(CELLS_PER_WINDOW * total / 6))
    slice_bits = min(cell_bits - 1, _bits(max(LEAST_BLOCKS, depth * total / 6 / SLICE_WINDOWS)))
    cell_shift, key_shift = cell_bits - slice_bits, 64 - slice_bits

    rows = frames.packed(docs, id_col, text_col).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        w = _Windows(_ordered(table), window)
        out = []
        for row in range(depth):
            cells = np.unique(w.cells(row, cell_bits))
            out += [(row << 40 | top, pack(deltas(cells[a:b], top << cell_shift)))
                    for top, a, b in _split(cells, cell_shift)]
        return pa.table({"slice": pa.array([s for s, _ in out], pa.int64()),
                         "block": pa.array([key[0].as_py()] * len(out), pa.int64()),
                         "cells": pa.array([c for _, c in out], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        base = (key[0].as_py() & (1 << 40) - 1) << cell_shift
        parts = [undeltas(unpack(c)[0], base) for c in _column(table, "cells")]
        every = np.sort(np.concatenate(parts))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for block, cells in zip(_column(table, "block"), parts):
            if len(shared):
                at = np.minimum(np.searchsorted(shared, cells), len(shared) - 1)
                if len(found := cells[shared[at] == cells]):
                    out.append((block, pack(deltas(found, base))))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                         "slice": pa.array([key[0].as_py()] * len(out), pa.int64()),
                         "cells": pa.array([c for _, c in out], pa.binary())})

    def candidates(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("prints", pa.binary())])
        if not len(table) or not len(replies):
            return schema.empty_table()
        table = _ordered(table)
        w, slices = _Windows(table, window), dict(zip(_column(replies, "slice"), _column(replies, "cells")))
        chosen = np.flatnonzero(w.firsts())
        for row in range(depth):
            mine = [undeltas(unpack(slices[s])[0], (s & (1 << 40) - 1) << cell_shift)
                    for s in sorted(slices) if s >> 40 == row]
            shared = np.concatenate(mine) if mine else np.empty(0, np.int64)
            if not len(shared):
                return schema.empty_table()
            cells = w.cells(row, cell_bits).astype(np.int64)[chosen]
            at = np.minimum(np.searchsorted(shared, cells), len(shared) - 1)
            chosen = chosen[shared[at] == cells]
        ids = pc.fill_null(table["doc_id"], -(2**63)).to_numpy()
        doc = ids[np.searchsorted(w.words.first, w.at[chosen], "right") - 1]
        top = w.h1[chosen] >> np.uint64(key_shift)
        order = np.argsort(top, kind="stable")
        out = []
        for s, a, b in _split(top[order], 0):
            part = order[a:b]
            at = chosen[part]
            out.append((s, pack(w.h1[at], w.h2[at], doc[part[:1]], np.diff(doc[part]), deltas(at))))
        return pa.table([pa.array([s for s, _ in out], pa.int64()),
                         pa.array([key[0].as_py()] * len(out), pa.int64()),
                         pa.array([p for _, p in out], pa.binary())], schema=schema)

    def later(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in _column(table, "prints")]
        sizes = [len(p[0]) for p in parts]
        h1, h2 = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc = np.concatenate([np.concatenate((p[2], p[2][0] + np.cumsum(p[3]))) for p in parts])
        order = np.lexsort((doc, h2, h1))
        a, b = h1[order], h2[order]
        after = np.zeros(len(order), bool)
        after[order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]] = True
        out, at = [], 0
        for block, part, size in zip(_column(table, "block"), parts, sizes):
            if len(found := undeltas(part[4])[after[at:at + size]]):
                out.append((block, pack(deltas(found))))
            at += size
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                         "starts": pa.array([c for _, c in out], pa.binary())})


    def keep(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        table = _ordered(table)
        w = _Windows(table, window)
        hit = ~w.firsts()
        for blob in _column(replies, "starts"):
            hit[undeltas(unpack(blob)[0])] = True
        gone = w.covered(np.flatnonzero(hit))
        before = np.concatenate(([0], np.cumsum(gone)))
        removed = before[w.words.first[1:]] - before[w.words.first[:-1]]
        kept, flags = [], ~gone
        for i, text in enumerate(table["text"]):
            words = (text.as_py() or "").encode().split()
            if removed[i]:
                words = itertools.compress(words, flags[w.words.first[i]:w.words.first[i + 1]].tolist())
            kept.append(b" ".join(words))
        return pa.table({"doc_id": table["doc_id"], "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                         "n_words": pa.array(w.words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "rest": table["rest"]})

    by_block = rows.groupBy("block")
    sketch, merge, candidates, later, keep = (_tidy(fn) for fn in (sketch, merge, candidates, later, keep))
    shared = by_block.applyInArrow(sketch, "slice long, block long, cells binary").groupBy("slice").applyInArrow(
        merge, "block long, slice long, cells binary")
    first_elsewhere = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        candidates, "slice long, block long, prints binary").groupBy("slice").applyInArrow(
        later, "block long, starts binary")
    return by_block.cogroup(first_elsewhere.groupBy("block")).applyInArrow(
        keep, frames.with_rest("doc_id long, kept string, n_words long, n_removed long", rows))


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = frames.documents(spark, folder).select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
