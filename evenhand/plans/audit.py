"""Audit of a predictions table: every analysis of every experiment off one cube."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import NO_SUCCESS
from ..operators.compare import compare_cube
from ..operators.confusion import confusion_cube
from ..operators.distribution import class_distributions, group_sizes, label_counts, prediction_summary, totals
from ..operators.fairness import gaps, group_rates, parity
from ..operators.metrics import long_metrics, metric_frame
from ..operators.prepare import analysis_set
from ..operators.summary import group_rows, summarize
from ..sources.registry import with_dataset
from ..staging import stage


@dataclass(frozen=True)
class Audit:
    """Lazy results; each is a DataFrame keyed by experiment_id."""

    predictions: DataFrame
    experiments: DataFrame
    cube: DataFrame

    @property
    def metrics(self) -> DataFrame:
        return metric_frame(self.cube)

    @property
    def gaps(self) -> DataFrame:
        return gaps(long_metrics(self.metrics))

    @property
    def rates(self) -> DataFrame:
        return group_rates(self._classed(), F.col("positive_class"))

    @property
    def parity(self) -> DataFrame:
        return parity(self.rates)

    @property
    def sizes(self) -> DataFrame:
        return group_sizes(self.cube)

    @property
    def distributions(self) -> DataFrame:
        return class_distributions(self.cube)

    @property
    def totals(self) -> DataFrame:
        return totals(self.cube)

    @property
    def prediction_summary(self) -> DataFrame:
        return prediction_summary(self.predictions)

    @property
    def label_counts(self) -> DataFrame:
        return label_counts(self.predictions)

    @property
    def group_rows(self) -> DataFrame:
        return group_rows(self.cube)

    @property
    def comparison(self) -> DataFrame:
        names = self.experiments.select("experiment_id", F.col("model_size").alias("model"),
                                        F.col("dataset_name").alias("dataset"))
        return compare_cube(self._classed(), F.col("positive_class")).join(names, "experiment_id")

    @property
    def summaries(self) -> DataFrame:
        return summarize(self.cube, self.experiments)

    @property
    def reasons(self) -> DataFrame:
        """All experiments, with the reason why one has no row to analyse, else null. A row for each lets a later
        audit take back a reason."""
        seen = self.cube.select("experiment_id").distinct().withColumn("_seen", F.lit(True))
        return self.experiments.select("experiment_id").join(seen, "experiment_id", "left").select(
            "experiment_id", F.when(F.col("_seen").isNull(), NO_SUCCESS).alias("error"))

    @property
    def without_success(self) -> DataFrame:
        """Experiments that have no row to analyse, with the reason."""
        return self.reasons.where("error is not null")

    def _classed(self) -> DataFrame:
        return self.cube.join(self.experiments.select("experiment_id", "positive_class"), "experiment_id")


def audit(predictions: DataFrame, experiments: DataFrame, keep_cube: bool = True) -> Audit:
    """Audit of all experiments in ``predictions``.

    The cube is written once (``keep_cube``), so several results do not read the
    predictions again. ``experiments`` needs positive_class; where it lacks it, the
    dataset registry fills it in.
    """
    if "positive_class" not in experiments.columns:
        experiments = with_dataset(experiments)
    cube = confusion_cube(analysis_set(predictions))
    return Audit(predictions, experiments, stage(cube, "cube") if keep_cube else cube)


