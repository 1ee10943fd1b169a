"""Run-level tables: experiment matrix, status rollups, progress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import experiment_id


def experiment_matrix(
    datasets: DataFrame, stamp: str, models: Sequence[str] = fv.DEFAULT_MODELS, provider: str | None = None,
    **settings: float,
) -> DataFrame:
    """Every dataset with every listed model as experiment configurations.

    ``datasets`` has dataset_name and dataset_type. ``stamp`` stands for the run's
    time: the same stamp gives the same ids, so a run can be resumed. The models are
    a short literal list unfolded per dataset, not a cross join. Further columns of
    ``datasets`` come last.
    """
    unknown = [m for m in models if m not in fv.MODELS]
    if unknown:
        raise ValueError(f"Unknown models: {unknown}")
    listed = F.inline(F.array(*[
        F.struct(F.lit(fv.MODELS[m][0]).alias("model_name"), F.lit(provider or fv.MODELS[m][1]).alias("api_provider"))
        for m in models
    ]))
    further = [c for c in datasets.columns if c not in ("dataset_name", "dataset_type")]
    unfolded = datasets.select("*", listed)
    return unfolded.select(
        experiment_id(F.col("dataset_name"), F.col("model_name"), F.lit(stamp)).alias("experiment_id"),
        "dataset_name", "model_name", F.col("model_name").alias("model_size"), "api_provider", "dataset_type",
        F.lit(float(settings.get("temperature", fv.TEMPERATURE))).alias("temperature"),
        F.lit(int(settings.get("max_tokens", fv.MAX_TOKENS))).alias("max_tokens"),
        F.lit(float(settings.get("test_size", fv.TEST_SIZE))).alias("test_size"),
        F.lit(int(settings.get("random_state", fv.RANDOM_STATE))).alias("random_state"),
        F.lit(stamp).alias("timestamp"),
        *further,
    )


def without_alias(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.col("dataset_name") != fv.ALIAS_DATASET)


def completed(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "completed")


def run_results(summary: DataFrame, experiments: DataFrame,
                errors: Mapping[str, str] | None = None) -> DataFrame:
    """Status row per experiment: completed where it has predictions, else failed."""
    known = experiments.sparkSession.createDataFrame(list((errors or {}).items()), "experiment_id string, _error string")
    failed = F.col("_error")
    joined = experiments.join(summary, "experiment_id", "left").join(known, "experiment_id", "left")
    ran = F.col("total_predictions").isNotNull() & failed.isNull()
    return joined.select(
        "experiment_id", F.col("dataset_name").alias("dataset"), F.col("model_name").alias("model"),
        F.when(ran, "completed").otherwise("failed").alias("status"),
        F.when(~ran, F.coalesce(failed, F.lit("No predictions"))).alias("error"),
        "successful_predictions", "failed_predictions", "accuracy",
    )


def batch_status(runs: DataFrame) -> DataFrame:
    """Totals over a batch of runs: one row."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(~F.coalesce(F.col("status") == "completed", F.lit(False))).alias("failed"),
        F.try_divide(F.count_if(F.col("status") == "completed") * F.lit(100.0), F.count(F.lit(1)))
        .alias("success_rate"),
    )


def dataset_rollup(runs: DataFrame) -> DataFrame:
    """Per dataset: completed and failed models, ids of completed runs, all results."""
    done = F.col("status") == "completed"
    return runs.groupBy("dataset").agg(
        F.count_if(done).alias("completed_models"),
        F.count_if(~F.coalesce(done, F.lit(False))).alias("failed_models"),
        F.sort_array(F.collect_list(F.when(done, F.col("experiment_id")))).alias("experiment_ids"),
        F.sort_array(F.collect_list(F.struct("model", "experiment_id", "status"))).alias("results"),
    ).withColumn("comparable", F.col("completed_models") > 1)


def progress(rollup: DataFrame) -> DataFrame:
    """Snapshot after each dataset: how many of how many are done, and the running totals.

    A window over all datasets of one batch, so over a handful of rows.
    """
    whole = Window.partitionBy()
    so_far = whole.orderBy("dataset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rollup.select(
        F.col("dataset").alias("current_dataset"),
        F.count(F.lit(1)).over(so_far).alias("completed_datasets"),
        F.count(F.lit(1)).over(whole).alias("total_datasets"),
        F.sum("completed_models").over(so_far).alias("completed_so_far"),
        F.sum("failed_models").over(so_far).alias("failed_so_far"),
    )
