"""Resume: what is still to do, and old and new rows as one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .bloom import BloomFilter, comparable, maybe_in
from .prepare import conform


def remaining(samples: DataFrame, done: DataFrame, keys: Sequence[str] = ("record_id",),
              screen: BloomFilter | None = None) -> DataFrame:
    """Samples without a row in the checkpoint. Failed rows count as done.

    The checkpoint's keys are made distinct first, so a key that was logged many
    times is one row in the join. ``screen`` is a filter of at least the finished keys: rows that it does not know stay
    where they are, and only the others, finished ones and few more, are shuffled and joined.
    """
    finished = done.select(*keys).distinct()
    if screen is None or not comparable(samples, done, keys):
        return samples.join(finished, list(keys), "left_anti")
    maybe = maybe_in(screen, samples, keys)
    return samples.where(~maybe).unionByName(samples.where(maybe).join(finished, list(keys), "left_anti"))


def with_done(done: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpointed and new rows on the one predictions schema."""
    rename = {"prediction_label": "prediction"}
    return conform(done, rename=rename).unionByName(conform(new, rename=rename))
