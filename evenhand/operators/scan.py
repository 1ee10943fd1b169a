"""Running totals over a whole table in two levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def with_total_before(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before a row in ``order``, which no two rows share.

    Rows are sorted by range and written with the number of their range. Each range sums up its own
    rows; what comes before a range is a sum over at most one row for each of them.
    """
    placed = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # one row for each range, of which there are as many as tasks
    start = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_from"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return placed.withColumn("_inside", F.sum(value).over(inside) - F.col(value)).join(F.broadcast(start), "_range").select(
        *rows.columns, (F.col("_from") + F.col("_inside")).alias(name))
