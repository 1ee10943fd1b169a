"""Running numbers and sums over groups of any size: a scan in two levels.

Rows are sorted by range over all tasks. Each task scans its own rows and says, in rows of their own, what the
first and the last of its groups amount to; no other group reaches into another task. What the
tasks before one hold of its first group is then added, out of a table of two rows for each task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..staging import stage


class _Scan:
    """Running numbers and sums of the sorted rows of a task, batch by batch."""

    def __init__(self, sums: int) -> None:
        self.key, self.held, self.first = None, np.zeros(1 + sums, np.int64), None

    def add(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Totals of each row's group up to it: the number of rows, then the sums."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        start = np.flatnonzero(new)
        total = np.cumsum(np.vstack([np.ones(len(keys), np.int64), values]), axis=1)
        before = np.hstack([np.zeros((len(total), 1), np.int64), total[:, start[1:] - 1]])
        if self.key == keys[0]:
            before[:, 0] -= self.held
        elif self.key is not None:
            self._note(self.key, self.held)
        out = total - np.repeat(before, np.diff(np.append(start, len(keys))), axis=1)
        if len(start) > 1:
            self._note(keys[0], out[:, start[1] - 1])
        self.key, self.held = keys[-1], out[:, -1].copy()
        return out

    def _note(self, key: int, held: np.ndarray) -> None:
        """Keeps the task's first group, when it has ended."""
        if self.first is None:
            self.first = key, held.copy()

    def close(self) -> list[tuple[int, np.ndarray]]:
        """Totals of the first and the last group."""
        last = [] if self.key is None else [(self.key, self.held)]
        return last if self.first is None else [self.first, *last]


def scan(rows: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Adds ``number`` (from 1, within ``key``, a long that is never null) and replaces ``sums`` (longs) by running
    sums. ``order`` begins with ``key``; rows that tie in it are in any order."""
    names = list(rows.columns)
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    out = T.StructType([*fields, T.StructField("number", T.LongType()), T.StructField("part", T.IntegerType()),
                        T.StructField("tally", T.BooleanType())])
    schema, at, totals = to_arrow_schema(out), names.index(key), [names.index(s) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), _Scan(len(sums))
        constant = lambda n, tally: [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, tally))]
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.vstack([np.asarray(batch.column(i)) for i in totals]) if totals else np.empty((0, batch.num_rows), np.int64)
            found = state.add(np.asarray(batch.column(at)), values)
            columns = list(batch.columns)
            for i, row in zip(totals, found[1:]):
                columns[i] = pa.array(row)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[0]), *constant(batch.num_rows, False)], schema=schema)
        for k, held in state.close():
            columns = [pa.nulls(1, f.type) for f in schema][:len(names)]
            columns[at] = pa.array([k], schema.field(at).type)
            for i, value in zip(totals, held[1:]):
                columns[i] = pa.array([value])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held[:1]), *constant(1, True)], schema=schema)

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = stage(ordered.mapInArrow(run, out), "scanned")
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.where("tally").select(F.col(key).alias("_key"), F.col("part").alias("_part"), *[
        F.sum(c).over(earlier).alias(f"_{c}") for c in ("number", *sums)]).where("_number is not null")
    # two rows for each task at most
    joined = local.where("not tally").join(F.broadcast(carry), (F.col(key) == F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    added = {c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in ("number", *sums)}
    return joined.select(*[added.get(c, F.col(c)).alias(c) for c in (*names, "number")])
