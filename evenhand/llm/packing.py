"""Packing of documents into sequences of at most ``size`` tokens by minimum bin slack.

A document is its token ids and one end id. What is longer than a sequence is cut into whole
sequences and a rest. The rests wait in a pool, counted by length. To fill a sequence the
longest rest is taken, and a bitset of all sums that the pool's lengths can make, bounded by
their counts, finds the multiset that comes closest to the room left; it is traced back and
used as often as the counts allow. Room that no multiset fills takes a piece cut off a longer
rest, so a sequence stays short only when its task has no tokens left. Those last tokens are
cut into powers of two, which need no padding.

A task packs its own documents and nothing is shuffled; sequence ids hold the number of the
task's partition above its own count. The pool is packed down to ``POOL`` sequences after
each slab of text, so memory is bounded. A null is an empty text: the end id alone. Rows that
share an id are packed each for itself; a null id is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import frames
from .tokens import default_vocabulary, encoder
from .words import release, slabs

SIZE = 2048
END = 1
POOL = 256


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``room`` as it can be."""
    sums, steps = 1, []
    mask = (1 << room + 1) - 1
    for length in sorted((k for k in counts if k <= room), reverse=True):
        steps.append((length, sums))
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            sums |= sums << length * k & mask
            left -= k
            k *= 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            out[length] = out.get(length, 0) + 1
            at -= length
    return out


class Packer:
    """Pieces of documents in sequences; ``rows`` holds those not yet handed on."""

    def __init__(self, size: int, first_sequence: int) -> None:
        self.size, self.sequence, self.tokens = size, first_sequence, 0
        self.pool: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _add(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool.setdefault(n, []).append(piece)
        self.tokens += n

    def _take(self, length: int) -> tuple:
        waiting = self.pool[length]
        piece = waiting.pop()
        if not waiting:
            del self.pool[length]
        self.tokens -= length
        return piece

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset, ids))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.size
        for at in range(0, whole, self.size):
            self._write([(doc_id, at, ids[at:at + self.size], len(ids))])
        if whole < len(ids):
            self._add((doc_id, whole, ids[whole:], len(ids)))

    def pack(self, keep: int) -> None:
        """Fills sequences while the pool holds at least ``keep`` tokens."""
        while self.tokens >= max(keep, self.size):
            longest = max(self.pool)
            counts = {k: len(v) for k, v in self.pool.items()}
            counts[longest] -= 1
            if not counts[longest]:
                del counts[longest]
            chosen = fill(counts, self.size - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.size - sum(k * n for k, n in chosen.items())
            times = min(len(self.pool[k]) // n for k, n in chosen.items())
            for _ in range(times if not slack else 1):
                pieces = [self._take(k) for k, n in chosen.items() for _ in range(n)]
                if slack and self.pool:
                    self._cut(slack, pieces)
                self._write(pieces)

    def _cut(self, room: int, pieces: list[tuple]) -> None:
        while room and self.pool:
            doc_id, start, ids, total = self._take(max(self.pool))
            pieces.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                self._add((doc_id, start + room, ids[room:], total))
            room -= min(room, len(ids))

    def finish(self) -> None:
        self.pack(0)
        while self.tokens:
            pieces: list[tuple] = []
            self._cut(1 << self.tokens.bit_length() - 1, pieces)
            self._write(pieces)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END,
                   vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (in its document), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` (in its sequence), and ``ids`` if asked for."""
    frames.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = frames.packed(docs, id_col, text_col).drop("rest")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def table(packer: Packer) -> Iterator[pa.RecordBatch]:
        step = 500 if with_ids else 5000
        for at in range(0, len(packer.rows), step):
            part = packer.rows[at:at + step]
            columns = {n: pa.array([r[i] for r in part], pa.int64()) for i, n in enumerate(names)}
            if with_ids:
                columns["ids"] = pa.array([r[7].astype(np.int32) for r in part], pa.list_(pa.int32()))
            yield from pa.table(columns).to_batches()
        packer.rows.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        for slab in slabs(batches):
            ids, bounds = encoder(path).encode(slab["text"])
            for i, doc_id in enumerate(slab["doc_id"].to_pylist()):
                packer.add(doc_id, np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end)).astype("<u4"))
            packer.pack(POOL * size)
            yield from table(packer)
        packer.finish()
        yield from table(packer)
        release()

    schema = ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(frames.documents(spark, folder).select("doc_id", "text"), with_ids=False)
