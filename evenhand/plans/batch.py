"""A matrix of experiments: score each, audit all of them in one pass, write the artefacts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed_values as fv
from ..operators.compare import compare_summaries, pick_experiments
from ..operators.prepare import analysis_set
from ..operators.runs import batch_status, completed, dataset_rollup, experiment_matrix, progress, run_results
from ..sources import sinks
from ..sources.commits import CommitLog
from ..sources.files import read_configs, read_summaries
from ..sources.registry import datasets_table
from ..staging import stage
from .audit import Audit, audit
from .experiment import Classifier, Prepared, prepare, run_experiment


def run_batch(
    spark: SparkSession,
    paths: Mapping[str, str],
    stamp: str,
    layout: sinks.Layout,
    make_classifier: Callable[[str], Callable[[], Classifier]],
    models: Sequence[str] = fv.DEFAULT_MODELS,
    rounds: int = 1,
    tasks: int | None = None,
    resume: bool = True,
) -> DataFrame:
    """Runs every dataset of ``paths`` with every model and returns the run results.

    ``make_classifier`` takes a model name. A dataset is loaded, split and rendered once,
    and all models read the prompts that were written. An experiment that fails is a failed
    run and stops nothing. The same ``stamp`` resumes: finished records are not scored
    again, unless ``resume`` is off. The loop goes over configurations, a handful; the rows
    stay in Spark.
    """
    datasets = datasets_table(spark, list(paths)).select("dataset_name", "dataset_type")
    matrix = experiment_matrix(datasets, stamp, models)
    sinks.write_configs(matrix, layout.configs)
    errors: dict[str, str] = {}
    prepared: dict[str, Prepared | Exception] = {}
    for run in matrix.orderBy("dataset_name", "model_name").collect():
        if run.dataset_name not in prepared:
            prepared[run.dataset_name] = _prepared(spark, run.dataset_name, paths[run.dataset_name])
        try:
            ready = prepared[run.dataset_name]
            if isinstance(ready, Exception):
                raise ready
            run_experiment(spark, run.dataset_name, paths[run.dataset_name], run.model_name, stamp, layout,
                           make_classifier(run.model_name), rounds=rounds, tasks=tasks, resume=resume, prepared=ready)
        except Exception as error:  # a failed run is a result
            errors[run.experiment_id] = f"{type(error).__name__}: {error}"
    return conclude(spark, matrix, stamp, layout, errors)


def _prepared(spark: SparkSession, dataset: str, path: str) -> Prepared | Exception:
    try:
        return prepare(spark, dataset, path)
    except Exception as error:  # fails each of the dataset's runs
        return error


def conclude(
    spark: SparkSession, experiments: DataFrame, stamp: str, layout: sinks.Layout,
    errors: Mapping[str, str] | None = None,
) -> DataFrame:
    """Audits what the listed experiments have predicted and writes all artefacts."""
    ids = experiments.select("experiment_id").distinct()
    scored = CommitLog(spark, layout.checkpoints).read(schemas.PREDICTIONS).join(ids, "experiment_id", "left_semi")
    result = audit(scored, experiments)
    runs = stage(run_results(result.prediction_summary, experiments, errors), "runs")
    sinks.write_predictions(scored, layout.predictions)
    sinks.write_by_experiment(result.prediction_summary, layout.prediction_summaries)
    sinks.write_by_experiment(result.label_counts, layout.label_counts)
    sinks.write_analysis(analysis_set(scored), layout.analysis)
    sinks.write_by_experiment(result.reasons, layout.unanalysed)
    sinks.write_summaries(result.summaries, layout.summaries)
    sinks.write_by_experiment(result.group_rows, layout.group_rows)
    rollup = dataset_rollup(runs)
    comparable = rollup.where("comparable").select("dataset")
    compared = result.comparison.join(completed(runs).select("experiment_id"), "experiment_id", "left_semi")
    sinks.write_comparison(compared.join(comparable, "dataset", "left_semi"), layout.comparisons)
    sinks.write_batch_summary(runs, f"{layout.runs}/results", stamp)
    sinks.write_batch_summary(batch_status(runs), f"{layout.runs}/status", stamp)
    sinks.write_batch_summary(rollup, f"{layout.runs}/datasets", stamp)
    sinks.write_batch_summary(progress(rollup), f"{layout.runs}/progress", stamp)
    return runs


def compare_stored(spark: SparkSession, layout: sinks.Layout, experiment_ids: Sequence[str]) -> DataFrame:
    """Comparison of experiments by id, out of their stored summaries, in list order."""
    return compare_summaries(pick_experiments(read_summaries(spark, layout.summaries), experiment_ids))


def reaudit(spark: SparkSession, layout: sinks.Layout) -> Audit:
    """Audit of everything a base folder holds."""
    return audit(CommitLog(spark, layout.checkpoints).read(schemas.PREDICTIONS), read_configs(spark, layout.configs))
