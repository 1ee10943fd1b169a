"""The confusion cube: rows per (experiment, group, truth, prediction).

Every metric, gap and distribution derives from it, so the data is read and
shuffled once, with counts combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BY = ("experiment_id",)
CELL = ("sensitive_feature", "ground_truth", "prediction")


def confusion_cube(predictions: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return predictions.groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("n"))


def confusion_cube_wide(
    rows: DataFrame, group: Column, truth: Column, predictions: Mapping[str, Column]
) -> DataFrame:
    """Cube of several experiments whose predictions sit side by side in each row.

    Rows are counted by the combination of all predictions first; only the counted
    combinations are unfolded into one cell per experiment.
    """
    names = {f"_p{i}": name for i, name in enumerate(predictions)}
    counted = rows.select(
        group.alias(CELL[0]), truth.alias(CELL[1]),
        *[predictions[name].alias(alias) for alias, name in names.items()],
    ).groupBy(*CELL[:2], *names).agg(F.count(F.lit(1)).alias("n"))
    cells = F.inline(F.array(*[
        F.struct(F.lit(name).alias(BY[0]), F.col(alias).alias(CELL[2])) for alias, name in names.items()
    ]))
    return counted.select(*CELL[:2], "n", cells).groupBy(*BY, *CELL).agg(F.sum("n").alias("n"))
