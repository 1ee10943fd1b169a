"""Sizes, shares, label distributions and prediction summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confusion import BY
from .metrics import GROUP


def with_share(counts: DataFrame, over: Sequence[str]) -> DataFrame:
    """Adds ``percentage``: the count's share of its total over some keys.

    The totals are joined back rather than summed by a window, as one key's rows
    (all groups of an experiment) need not fit a task.
    """
    totals = counts.groupBy(*over).agg(F.sum("count").alias("_total"))
    return counts.join(totals, list(over)).withColumn(
        "percentage", F.try_divide(F.col("count") * F.lit(100.0), F.col("_total"))).drop("_total")


def group_sizes(cube: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return with_share(cube.groupBy(*by, GROUP).agg(F.sum("n").alias("count")), by)


def largest_first(counts: DataFrame, *ties: str) -> DataFrame:
    """By falling count, ties by name: the order reports list groups and labels in."""
    return counts.orderBy(F.desc("count"), *ties)


def class_distributions(cube: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Count and share of each label per group, for truths and for predictions."""
    keys = [*by, GROUP, "kind"]
    labels = cube.select(*by, GROUP, "n", F.inline(F.array(
        F.struct(F.lit("ground_truth").alias("kind"), F.col("ground_truth").alias("label")),
        F.struct(F.lit("predictions").alias("kind"), F.col("prediction").alias("label")),
    )))
    return with_share(labels.groupBy(*keys, "label").agg(F.sum("n").alias("count")), keys)


def totals(cube: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Analysed samples and number of groups per experiment."""
    return cube.groupBy(*by, GROUP).agg(F.sum("n").alias("n")).groupBy(*by).agg(
        F.sum("n").alias("total_samples"), F.count(F.lit(1)).alias("num_groups"))


def approximate_groups(predictions: DataFrame, by: Sequence[str] = BY, error: float = 0.02) -> DataFrame:
    """Number of groups per experiment by sketch, where a count of the keys is too much."""
    return predictions.groupBy(*by).agg(F.approx_count_distinct(GROUP, error).alias("num_groups"))


def _rows(condition: Column) -> Column:
    return F.count_if(condition)


def prediction_summary(predictions: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Totals before the analysis mask. Accuracy is correct over successful rows, and
    0 where no row was successful."""
    won = F.coalesce("api_success", F.lit(False))
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        _rows(won).alias("successful_predictions"),
        _rows(~won).alias("failed_predictions"),
        F.coalesce(F.try_divide(_rows(F.col("correct")).cast("double"), _rows(won)),
                   F.lit(0.0)).alias("accuracy"),
        F.avg("attempts_made").alias("mean_attempts"),
    )


def label_counts(predictions: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """How often each label occurs as prediction and as truth (NULL not counted).

    Rows are counted by pair of labels first and unfolded after.
    """
    pairs = predictions.groupBy(*by, "ground_truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(*by, "n", F.inline(F.array(
        F.struct(F.lit("prediction").alias("kind"), F.col("prediction").alias("label")),
        F.struct(F.lit("ground_truth").alias("kind"), F.col("ground_truth").alias("label")),
    ))).where(F.col("label").isNotNull()).groupBy(*by, "kind", "label").agg(F.sum("n").alias("count"))
