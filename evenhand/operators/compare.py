"""Experiments side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .confusion import BY
from .fairness import gaps, group_rates, parity
from .metrics import METRICS, OVERALL, long_metrics, metric_frame

COMPARISON = (
    "experiment_id", "model", "dataset", "accuracy", "accuracy_difference", "accuracy_ratio",
    "demographic_parity_diff", "equalized_odds_diff",
)


def compare_cube(cube: DataFrame, positive: Column | str, by: Sequence[str] = BY) -> DataFrame:
    """Comparison rows of all experiments of a cube in one job."""
    frame = metric_frame(cube, by)
    overall = frame.where(F.col("level") == OVERALL).select(*by, "accuracy")
    gap = gaps(long_metrics(frame, by, METRICS[:1]), by).select(
        *by, F.col("difference").alias("accuracy_difference"), F.col("ratio").alias("accuracy_ratio"))
    odds = parity(group_rates(cube, positive, by), by).select(
        *by, F.col("demographic_parity_difference").alias("demographic_parity_diff"),
        F.col("equalized_odds_difference").alias("equalized_odds_diff"))
    return overall.join(gap, list(by)).join(odds, list(by))


def compare_summaries(summaries: DataFrame) -> DataFrame:
    """Comparison rows out of stored summary documents."""
    return summaries.select(
        "experiment_id", F.col("model_size").alias("model"), "dataset",
        F.col("overall_metrics")["accuracy"].alias("accuracy"),
        F.col("fairness_differences")["accuracy"].alias("accuracy_difference"),
        F.col("fairness_ratios")["accuracy"].alias("accuracy_ratio"),
        F.col("binary_metrics")["demographic_parity_difference"].alias("demographic_parity_diff"),
        F.col("binary_metrics")["equalized_odds_difference"].alias("equalized_odds_diff"),
    )


def pick_experiments(rows: DataFrame, experiment_ids: Sequence[str], order: str = "timestamp") -> DataFrame:
    """The rows of the listed experiments, with their place in the list (``pos``).

    Matches the id exactly; ids without a row are skipped. Of several rows of an id
    the first by ``order`` stays. The list comes from the caller, so it is small.
    """
    listed = F.broadcast(rows.sparkSession.createDataFrame(
        list(enumerate(experiment_ids)), "pos int, experiment_id string"))
    first = Window.partitionBy("pos").orderBy(order)
    return (
        rows.join(listed, "experiment_id")
        .withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
        .orderBy("pos")
    )
