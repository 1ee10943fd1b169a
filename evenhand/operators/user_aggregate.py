"""Aggregates of a user's own, in two phases: states by task, then states merged.

Unlike a metric function, which sees the cells of a group, such an aggregate may use any column, a score
say. Each task updates a state for each of the groups it meets, batch by batch; states, not rows, are shuffled
and merged one after the other. So no group is ever held, whatever its size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MOST_GROUPS = 10_000
"""States that a task holds before it passes them on."""


class UserAggregate(Protocol):
    """What a user gives. ``merge`` is associative and commutative; states can be pickled and stay small."""

    columns: Sequence[str]
    result: T.StructType

    def init(self) -> Any: ...

    def update(self, state: Any, rows: pa.Table) -> Any: ...

    def merge(self, one: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> dict: ...


def aggregate(df: DataFrame, by: Sequence[str], user: UserAggregate) -> DataFrame:
    """One row per group (nulls are a group): ``by`` and the columns of ``user.result``. An empty table has no groups."""
    keys = [df.schema[k] for k in by]
    held = T.StructType([*keys, T.StructField("_state", T.BinaryType())])
    out = T.StructType([*keys, *user.result.fields])
    held_schema, out_schema, by = to_arrow_schema(held), to_arrow_schema(out), list(by)

    def passed_on(states: dict[tuple, Any]) -> pa.RecordBatch:
        rows = [(*k, pickle.dumps(s)) for k, s in states.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), held_schema)], schema=held_schema)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = table.append_column("_row", pa.array(np.arange(len(table))))
            groups = rows.group_by(by, use_threads=False).aggregate([("_row", "list")])
            for key, at in zip(zip(*[groups[k].to_pylist() for k in by]), groups["_row_list"]):
                state = states[key] if key in states else user.init()
                states[key] = user.update(state, table.take(at.values).select(list(user.columns)))
            if len(states) > MOST_GROUPS:
                yield passed_on(states)
                states = {}
        if states:
            yield passed_on(states)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            key = state = None
            for batch in batches:
                for *k, data in zip(*[c.to_pylist() for c in batch.columns]):
                    if key is not None and k == key:
                        state = user.merge(state, pickle.loads(data))
                        continue
                    if key is not None:
                        yield dict(zip(by, key)) | user.finish(state)
                    key, state = k, pickle.loads(data)
            if key is not None:
                yield dict(zip(by, key)) | user.finish(state)

        held = []
        for row in rows():
            held.append(row)
            if len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, out_schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, out_schema)

    columns = [*by, *[c for c in user.columns if c not in by]]
    states = df.select(*columns).mapInArrow(update, held)
    return states.repartition(*by).sortWithinPartitions(*by).mapInArrow(finish, out)


class ThresholdCurve:
    """True and false positive rates of a score at ``bins`` thresholds between two values, and the area under
    the curve. A state is two rows of counts."""

    result = T.StructType().add("thresholds", T.ArrayType(T.StructType().add("threshold", "double").add("true_positives", "long").add(
        "false_positives", "long").add("tpr", "double").add("fpr", "double"))).add("auc", "double").add("n", "long")

    def __init__(self, score: str, positive: str, low: float = 0.0, high: float = 1.0, bins: int = 20) -> None:
        self.columns, self.low, self.high, self.bins = (score, positive), low, high, bins

    def init(self) -> np.ndarray:
        return np.zeros((2, self.bins), np.int64)

    def update(self, state: np.ndarray, rows: pa.Table) -> np.ndarray:
        score = rows[self.columns[0]].to_numpy(zero_copy_only=False).astype(float)
        positive = np.array(rows[self.columns[1]].to_pylist(), object)
        known = ~np.isnan(score) & np.array([p is not None for p in positive], bool)
        at = np.floor((score[known] - self.low) * self.bins / (self.high - self.low)).clip(0, self.bins - 1).astype(int)
        for side in (0, 1):
            state[side] += np.bincount(at[positive[known].astype(bool) == bool(side)], minlength=self.bins)
        return state

    def merge(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return one + other

    def finish(self, state: np.ndarray) -> dict:
        above = state[:, ::-1].cumsum(axis=1)[:, ::-1]
        fp, tp = above
        rate = lambda part, of: None if not of else part / of
        step = (self.high - self.low) / self.bins
        points = [{"threshold": self.low + k * step, "true_positives": int(tp[k]), "false_positives": int(fp[k]),
                   "tpr": rate(int(tp[k]), int(tp[0])), "fpr": rate(int(fp[k]), int(fp[0]))} for k in range(self.bins)]
        pairs = int(tp[0]) * int(fp[0])
        below = np.concatenate(([0], state[0].cumsum()[:-1]))
        wins = int((state[1] * (2 * below + state[0])).sum())
        return {"thresholds": points, "auc": wins / (2 * pairs) if pairs else None, "n": int(state.sum())}


def curve_rows(curves: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per group and threshold."""
    return curves.select(*by, "auc", F.inline("thresholds"))
