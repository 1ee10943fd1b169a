"""Gaps between groups: differences, ratios, best and worst, parity and odds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confusion import BY
from .metrics import GROUP, PER_GROUP

FOUR_FIFTHS = 0.8


def gaps(long: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per metric: difference (max - min), ratio (min / max, NULL for 0/0), best and
    worst group with their values, and the four-fifths flag on the ratio.

    Between groups of equal value the smallest name is named, as best and as worst.
    """
    value, group = F.col("value"), F.col(GROUP)
    return long.where(F.col("level") == PER_GROUP).groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("num_groups"),
        (F.max(value) - F.min(value)).alias("difference"),
        F.try_divide(F.min(value), F.max(value)).alias("ratio"),
        F.min_by(group, F.struct(-value, group)).alias("best_group"),
        F.max(value).alias("best_value"),
        F.min_by(group, F.struct(value, group)).alias("worst_group"),
        F.min(value).alias("worst_value"),
    ).withColumns({
        "gap": F.col("best_value") - F.col("worst_value"),
        "meets_four_fifths": F.col("ratio") >= FOUR_FIFTHS,
    })


def _class(positive: Column | str) -> Column:
    return F.lit(positive) if isinstance(positive, str) else positive


def group_rates(cube: DataFrame, positive: Column | str, by: Sequence[str] = BY) -> DataFrame:
    """Selection rate, TPR and FPR per group.

    ``positive`` is a label, or a column of the cube where experiments differ in it.
    A group without positives has TPR 0, without negatives FPR 0.
    """
    name = _class(positive)
    true, chosen = F.col("ground_truth") == name, F.col("prediction") == name

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))

    other = F.when(~true, F.col("ground_truth"))
    counted = cube.groupBy(*by, GROUP).agg(
        F.sum("n").alias("n"),
        rows(true).alias("positives"), rows(~true).alias("negatives"), rows(chosen).alias("selected"),
        rows(true & chosen).alias("true_positives"), rows(~true & chosen).alias("false_positives"),
        F.min(other).alias("_other_min"), F.max(other).alias("_other_max"),
    )

    def rate(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return counted.withColumns({
        "selection_rate": rate("selected", "n"),
        "tpr": rate("true_positives", "positives"),
        "fpr": rate("false_positives", "negatives"),
    })


def parity(rates: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Demographic parity and equalized odds differences per experiment.

    They hold only where the truth has exactly two labels and one of them is the
    positive class; elsewhere they are NULL.
    """

    def spread(c: str) -> Column:
        return F.max(c) - F.min(c)

    spreads = rates.groupBy(*by).agg(
        F.coalesce((F.max(F.col("positives") > 0)) & (F.min("_other_min") == F.max("_other_max")),
                   F.lit(False)).alias("binary"),
        spread("selection_rate").alias("_dp"), spread("tpr").alias("_tpr"), spread("fpr").alias("_fpr"),
        F.try_divide(F.min("selection_rate"), F.max("selection_rate")).alias("_dp_ratio"),
    )
    gated = {
        "demographic_parity_difference": F.col("_dp"),
        "demographic_parity_ratio": F.col("_dp_ratio"),
        "tpr_difference": F.col("_tpr"),
        "fpr_difference": F.col("_fpr"),
        "equalized_odds_difference": F.greatest("_tpr", "_fpr"),
    }
    return spreads.select(*by, "binary", *[F.when(F.col("binary"), c).alias(k) for k, c in gated.items()])
