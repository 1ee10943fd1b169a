"""Writers: a table per artefact, partitioned by dataset and experiment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_safe
from ..operators.prepare import conform


@dataclass(frozen=True)
class Layout:
    """The artefact tables below a base folder; partitions take the place of file names."""

    base: str

    def table(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    configs = property(lambda self: self.table("configs"))
    responses = property(lambda self: self.table("responses"))
    predictions = property(lambda self: self.table("predictions"))
    prediction_summaries = property(lambda self: self.table("prediction_summaries"))
    label_counts = property(lambda self: self.table("label_counts"))
    unanalysed = property(lambda self: self.table("unanalysed"))
    group_rows = property(lambda self: self.table("group_rows"))
    analysis = property(lambda self: self.table("analysis"))
    summaries = property(lambda self: self.table("summaries"))
    logs = property(lambda self: self.table("logs"))
    checkpoints = property(lambda self: self.table("checkpoints"))
    comparisons = property(lambda self: self.table("comparisons"))
    runs = property(lambda self: self.table("runs"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Ten-column predictions as Parquet by experiment; an experiment's new ones replace its old."""
    _replace_partitions(conform(predictions), path, "parquet", "experiment_id")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_checkpoint(predictions: DataFrame, path: str) -> None:
    """Adds finished rows; rows already there are never rewritten."""
    conform(predictions).write.mode("append").partitionBy("experiment_id").parquet(path)


def _replace_partitions(rows: DataFrame, path: str, form: str, *keys: str) -> None:
    """Writes the partitions the rows belong to; others at the path stay."""
    rows.write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "header", True).partitionBy(*keys).save(path)


def write_analysis(analysed: DataFrame, path: str) -> None:
    """The rows behind an experiment's metrics; a new analysis replaces its own."""
    _replace_partitions(conform(analysed), path, "parquet", "experiment_id")


def write_configs(experiments: DataFrame, path: str) -> None:
    _replace_partitions(experiments, path, "json", "dataset_name", "experiment_id")


def write_by_experiment(rows: DataFrame, path: str) -> None:
    """Prediction summaries, label counts, group rows, or reasons why there is no analysis, as
    JSON by experiment."""
    _replace_partitions(rows, path, "json", "experiment_id")


def write_summaries(documents: DataFrame, path: str) -> None:
    """Summary documents as JSON lines, a folder per dataset and experiment."""
    _replace_partitions(documents, path, "json", "dataset", "experiment_id")


def write_comparison(comparison: DataFrame, path: str) -> None:
    """Comparison rows as CSV by dataset; a new one replaces its own dataset's only."""
    _replace_partitions(comparison, path, "csv", "dataset")


def write_batch_summary(summary: DataFrame, path: str, stamp: str) -> None:
    """Batch, master and progress summaries as JSON, by the (path-safe) time of the run."""
    _replace_partitions(summary.withColumn("stamp", path_safe(F.lit(stamp))), path, "json", "stamp")
