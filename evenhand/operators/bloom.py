"""A Bloom filter of finished keys, so that rows of new ones need no join.

Each task that reads finished keys sets bits of its own; the filters of tasks, of days or of commits are united by
OR, slice by slice. The filter has as many bits as suit the number of keys, but never more than ``MOST_BYTES``: that is the bound of
what is broadcast. A larger set of keys makes it say "maybe" more often, which costs time and no result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 16 << 20
BITS_PER_KEY, PROBES = 10, 4
_SLICE = 1 << 16
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EXACT = (*_WHOLE, T.StringType, T.DateType, T.BooleanType, T.BinaryType)


@dataclass(frozen=True)
class BloomFilter:
    """Bits of the hashes of some keys."""

    bits: np.ndarray

    @classmethod
    def empty(cls, keys: int, most_bytes: int = MOST_BYTES) -> BloomFilter:
        size = _SLICE
        while size < most_bytes and 8 * size < BITS_PER_KEY * keys:
            size *= 2
        return cls(np.zeros(size, np.uint8))

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
        for k in range(PROBES):
            yield (low + np.uint64(k) * high) % np.uint64(8 * len(self.bits))

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes.view(np.uint64)):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """False only for hashes that were never added."""
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes.view(np.uint64)):
            out &= self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        return out

    def merge(self, other: BloomFilter) -> BloomFilter:
        if len(self.bits) != len(other.bits):
            raise ValueError("filters of different sizes")
        return BloomFilter(self.bits | other.bits)


def comparable(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> bool:
    """Whether equal keys of both have equal hashes: whole numbers of any width, or one type without rounding."""
    kinds = [(one.schema[k].dataType, two.schema[k].dataType) for k in keys]
    return all(isinstance(a, _WHOLE) and isinstance(b, _WHOLE) or a == b and isinstance(a, _EXACT) for a, b in kinds)


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    wide = [F.col(k).cast("long") if isinstance(df.schema[k].dataType, _WHOLE) else F.col(k) for k in keys]
    return F.xxhash64(*wide)


def filter_of(done: DataFrame, keys: Sequence[str] = ("record_id",), most_bytes: int = MOST_BYTES) -> BloomFilter:
    """The filter of a table's keys: a count by sketch for its size, then one pass. Tasks send the slices of their
    filters in which a bit is set; a slice is united in one place."""
    hashed = done.select(key_hash(done, keys).alias("h"))
    empty = BloomFilter.empty(hashed.agg(F.approx_count_distinct("h")).first()[0], most_bytes)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BloomFilter(np.zeros_like(empty.bits))
        for batch in batches:
            own.add(np.asarray(batch.column(0)))
        for k in range(0, len(own.bits), _SLICE):
            if own.bits[k:k + _SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _SLICE]), pa.array([own.bits[k:k + _SLICE].tobytes()])], ["slice", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(*[c.to_pylist() for c in batch.columns]):
                bits = np.frombuffer(bits, np.uint8)
                held[k] = bits if k not in held else held[k] | bits
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([b.tobytes() for b in held.values()])], ["slice", "bits"])

    schema = "slice long, bits binary"
    for row in hashed.mapInArrow(set_bits, schema).repartition("slice").mapInArrow(unite, schema).collect():
        empty.bits[row.slice * _SLICE:(row.slice + 1) * _SLICE] = np.frombuffer(row.bits, np.uint8)
    return empty


def maybe_in(found: BloomFilter, df: DataFrame, keys: Sequence[str]) -> Column:
    """Whether a row's key may be in the filter; only a hash of the key goes to Python."""
    shared = df.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_hold(hashes.to_numpy(np.int64)))

    return test(key_hash(df, keys))
