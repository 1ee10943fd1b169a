"""Accuracy, weighted precision, recall and F1, overall and per group, from the cube."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confusion import BY, CELL

GROUP = CELL[0]
METRICS = ("accuracy", "precision", "recall", "f1_score")
OVERALL, PER_GROUP = "overall", "group"


def label_sums(cube: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Support, predicted and tp per label, for each group and overall.

    ``level`` tells the two apart; the group column is NULL overall.
    """
    hit = F.when(F.col("ground_truth") == F.col("prediction"), F.col("n")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")

    def entry(label: str, support: Column, predicted: Column, tp: Column) -> Column:
        return F.struct(F.col(label).alias("label"), support.alias("support"),
                        predicted.alias("predicted"), tp.alias("tp"))

    entries = cube.select(*by, GROUP, F.inline(F.array(
        entry("ground_truth", F.col("n"), zero, hit),
        entry("prediction", zero, F.col("n"), zero),
    )))
    sets = [[*by, GROUP, "label"], [*by, "label"]]
    sums = entries.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]]
    ).agg(
        F.grouping(GROUP).alias("_all"),
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")],
    )
    return sums.select(*by, GROUP, F.when(F.col("_all") == 1, OVERALL).otherwise(PER_GROUP).alias("level"),
                       "label", "support", "predicted", "tp")


def _weighted(per_label: Column) -> Column:
    """Mean over labels weighted by support; a label that is never true weighs nothing."""
    return F.try_divide(F.sum(F.col("support") * F.coalesce(per_label, F.lit(0.0))), F.sum("support"))


def builtin_metrics() -> dict[str, Column]:
    """The four metrics as aggregates over label sums."""
    tp = F.col("tp").cast("double")
    return {
        "accuracy": F.try_divide(F.sum(tp), F.sum("support")),
        "precision": _weighted(F.try_divide(tp, F.col("predicted"))),
        "recall": _weighted(F.try_divide(tp, F.col("support"))),
        "f1_score": _weighted(F.try_divide(2 * tp, F.col("predicted") + F.col("support"))),
    }


def metric_frame(
    cube: DataFrame, by: Sequence[str] = BY, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per group and one overall: n and the metrics.

    ``extra`` adds metrics as aggregate expressions over support, predicted and tp.
    """
    metrics = builtin_metrics() | dict(extra or {})
    return label_sums(cube, by).groupBy(*by, GROUP, "level").agg(
        F.sum("support").alias("n"), *[m.alias(name) for name, m in metrics.items()])


def long_metrics(frame: DataFrame, by: Sequence[str] = BY, names: Sequence[str] = METRICS) -> DataFrame:
    """The frame as (by, group, level, metric, value) rows."""
    return frame.unpivot([*by, GROUP, "level"], list(names), "metric", "value")


MetricFunction = Callable[[pd.Series, pd.Series, pd.Series], float]
# Stands for answers outside the classes that are not the row's truth. No label begins with NUL.
OTHER = "\0other"


def custom_metrics(
    cube: DataFrame, functions: Mapping[str, MetricFunction], classes: Sequence[str], by: Sequence[str] = BY
) -> DataFrame:
    """User metrics as long rows: ``fn(y_true, y_pred, sample_weight) -> float``.

    A function sees the cells of a group (a row per pair of labels, its count as the
    weight), never the group's rows. Truths come as they are. A prediction that is neither
    among ``classes`` nor the row's truth, such as a stray answer of a model, comes as
    ``OTHER``, which equals no truth. So k classes and t true labels make at most
    t * (k + 2) rows, however large the group is and whatever a model answers.
    """

    def udf(fn: MetricFunction) -> Callable[..., Column]:
        @F.pandas_udf("double")
        def evaluate(truth: pd.Series, prediction: pd.Series, weight: pd.Series) -> float:
            return float(fn(truth, prediction, weight))

        return evaluate

    truth, said = (F.col(c) for c in CELL[1:])
    said = F.when(said.isin(*classes) | (said == truth), said).otherwise(OTHER).alias(CELL[2])
    cells = cube.select(*by, GROUP, truth, said, "n")
    aggregates = [udf(fn)("ground_truth", "prediction", "n").alias(name) for name, fn in functions.items()]

    def evaluated(keys: Sequence[str], level: str) -> DataFrame:
        counts = cells.groupBy(*keys, *CELL[1:]).agg(F.sum("n").alias("n"))
        return counts.groupBy(*keys).agg(*aggregates).withColumn("level", F.lit(level))

    both = evaluated([*by, GROUP], PER_GROUP).unionByName(evaluated(by, OVERALL), allowMissingColumns=True)
    return long_metrics(both, by, list(functions))
