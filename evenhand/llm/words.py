"""Words of whole texts, as numpy arrays over Arrow buffers.

Texts reach Python in Arrow batches. Their UTF-8 bytes lie one after the other, so words, word
hashes and hashes of word windows of many documents are computed at once, without a Python
object for each word. Words are sequences of bytes outside a set of ASCII separators, which in
UTF-8 is the same as sequences of characters outside that set.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import frames

SLAB_BYTES = 3 << 20
"""Bytes of text that a task works on at once, but for longer single documents."""

_CHUNK = 1 << 18


def _table(allowed: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(allowed)] = True
    return table


SPACED = _table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
"""Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256), *range(0x41, 0x5B)])
"""Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z count as a-z."""

_rng = np.random.default_rng(20240517)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUES.copy()
_LOWER[0x41:0x5B] = _VALUES[0x61:0x7B]
_STEP = 0x9E3779B97F4A7C15 | 1
_WINDOW = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2**64, and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, _CHUNK + 256)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size == _CHUNK + 256:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads each bit over all others."""
    h = h ^ np.uint64(salt) if salt else h.copy()
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry at the end).
    A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and don't overlap."""
    values, n, i = _LOWER if lower else _VALUES, len(starts), 0
    out = np.empty(n, np.uint64)
    while i < n:
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + _CHUNK, "left")) - 1)
        b = ends[j - 1]
        up, down = powers(_STEP, b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[data[a:b]] * up[:-1], out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[ends[i:j] - a] - total[s]) * down[s]
        i = j
    out += (ends - starts).astype(np.uint64)
    return mix(out)


class Words:
    """The words of some documents: where each starts and ends, and each document's first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = allowed[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.n = len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` takes A-Z as a-z."""
        return span_hashes(self.data, self.starts, self.ends, lower)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """The first words of all windows of ``size`` words that lie in one document."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(self.n)
        return np.flatnonzero(left >= size)


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the word sequences of ``size`` words that start at ``at``; a second
    seed gives a second, independent hash."""
    up, down = powers(_WINDOW[seed], len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((mix(words, 0x5851F42D4C957F2D) if seed else words) * up[:-1], out=total[1:])
    return mix((total[at + size] - total[at]) * down[at])


def slabs(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLAB_BYTES) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``most`` bytes of text, or one longer document."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(table[column]), 0).to_numpy()).astype(np.int64) + 16)
        at = base = 0
        while at < len(ends):
            to = int(np.searchsorted(ends, base + most - size, "right"))
            if to > at or not held:
                to = max(to, at + 1)
                held.append(table.slice(at, to - at))
                size += int(ends[to - 1]) - base
                at, base = to, int(ends[to - 1])
            if at < len(ends) or size >= most:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def map_slabs(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: T.StructType | str, column: str = "text",
              most: int = SLAB_BYTES) -> DataFrame:
    """``fn`` over slabs of rows. No shuffle; memory is bounded by the slab."""
    frames.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, column, most):
            yield from fn(slab).to_batches()
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system. Worker processes live on from task to task and
    from job to job; without this each holds the most that any of its tasks has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; each keeps its type."""
    head = b"".join(a.dtype.str[1:].encode() + len(a).to_bytes(8, "little") for a in arrays)
    raw = len(arrays).to_bytes(1, "little") + head + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, out = raw[0], []
    at = 1 + 10 * n
    for i in range(n):
        head = raw[1 + 10 * i:11 + 10 * i]
        dtype, size = np.dtype(head[:2].decode()), int.from_bytes(head[2:], "little")
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


def deltas(ascending: np.ndarray, base: int = 0) -> np.ndarray:
    """Ascending numbers as differences of the least width."""
    gaps = np.diff(ascending.astype(np.int64), prepend=np.int64(base))
    most = int(gaps.max(initial=0))
    return gaps.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 2**32 else np.int64)


def undeltas(gaps: np.ndarray, base: int = 0) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64) + base
