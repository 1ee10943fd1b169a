"""Numbers of groups by mergeable sketches, where the keys of years are too many to count again each day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .confusion import BY, CELL

LOG_REGISTERS = 14
"""2^14 registers: a relative standard error of about 0.8 per cent."""


def group_sketches(predictions: DataFrame, by: Sequence[str] = BY, group: str = CELL[0], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """A HyperLogLog sketch of the groups for each of ``by``, an experiment and a day say. Tasks sketch their own rows
    first. A null group counts for nothing."""
    return predictions.groupBy(*by).agg(F.hll_sketch_agg(F.col(group).cast("string"), log_registers).alias("sketch"))


def united(sketches: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Sketches of coarser keys, out of stored ones: nothing but the sketches is read."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", True).alias("sketch"))


def estimated_groups(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("num_groups", F.hll_sketch_estimate("sketch")).drop("sketch")
