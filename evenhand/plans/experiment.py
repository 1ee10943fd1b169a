"""One experiment end to end: samples, prompts, answers, predictions, audit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import fixed_values as fv
from ..functions.describe import prompt_columns
from ..functions.responses import classify_attempts
from ..operators.attempts import judged, reduce_attempts, to_predictions
from ..operators.bloom import filter_of
from ..operators.prepare import conform
from ..operators.resume import remaining
from ..sources import sinks
from ..sources.commits import CommitLog
from ..sources.registry import DatasetConfig, load_dataset
from ..staging import new_folder, stage
from .answers import Responder, ask_in_rounds

Classifier = Callable[[str, str, str, int], dict]


def prompts(described: DataFrame, config: DatasetConfig) -> DataFrame:
    """Samples with their system and user prompt."""
    system, user = prompt_columns(
        F.lit(config.dataset_type), F.lit(config.task_description), F.lit(config.positive_class),
        F.lit(config.negative_class), F.col("record_id"), F.col("data_description"))
    return described.withColumns({"system_prompt": system, "user_prompt": user})


def classify(
    prompted: DataFrame, make_classifier: Callable[[], Classifier], experiment: str, stamp: str,
    max_attempts: int = fv.MAX_ATTEMPTS, tasks: int | None = None,
) -> DataFrame:
    """Runs a user's classifier over the prompts, partition by partition.

    ``make_classifier`` is called once per task (clients and models are set up
    there) and returns ``fn(system_prompt, user_prompt, record_id, max_attempts)``,
    which gives the fields of ``schemas.CLASSIFIED`` it knows. Truth and group pass
    through beside the answer, so nothing is joined back; rows stream in Arrow
    batches and nothing is collected. ``tasks`` spreads slow calls over more (or
    fewer) partitions than the scan has.
    """
    if tasks:
        prompted = prompted.repartition(tasks)
    kept = [c for c in ("ground_truth", "sensitive_feature") if c in prompted.columns]
    answer = to_arrow_schema(schemas.CLASSIFIED)
    out = T.StructType([*schemas.CLASSIFIED.fields, *[T.StructField(c, T.StringType()) for c in kept]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make_classifier()
        base = {"experiment_id": experiment, "api_success": False, "attempts_made": 1, "timestamp": stamp}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:3]]
            rows = [base | {"record_id": r} | call(s, u, r, max_attempts) for s, u, r in zip(*columns)]
            answered = pa.RecordBatch.from_pylist(rows, answer)
            yield pa.RecordBatch.from_arrays([*answered.columns, *batch.columns[3:]], [*answer.names, *kept])

    return prompted.select("system_prompt", "user_prompt", "record_id", *kept).mapInArrow(run, out)


def answered(samples: DataFrame, responses: DataFrame, config: DatasetConfig, experiment: str,
             max_attempts: int = fv.MAX_ATTEMPTS) -> DataFrame:
    """Predictions out of a table of raw responses (``schemas.RESPONSES``)."""
    mine = responses.where(F.col("experiment_id") == experiment)
    outcomes = reduce_attempts(classify_attempts(mine, max_attempts), ("record_id",))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = to_predictions(
        samples.select("record_id", "ground_truth", "sensitive_feature"),
        outcomes.withColumn("timestamp", when), config.positive_class, config.negative_class)
    return conform(rows.withColumn("experiment_id", F.lit(experiment)))


@dataclass(frozen=True)
class Prepared:
    """A dataset's test samples with their prompts, written once for all models."""

    prompted: DataFrame
    config: DatasetConfig


def prepare(spark: SparkSession, dataset: str, path: str, test_size: float = fv.TEST_SIZE,
            seed: int = fv.RANDOM_STATE) -> Prepared:
    """Loads, splits and renders a dataset in one job."""
    loaded = load_dataset(spark, dataset, path, test_size, seed)
    return Prepared(stage(prompts(loaded.described(), loaded.config), "prompts"), loaded.config)


def run_experiment(
    spark: SparkSession, dataset: str, path: str, model: str, stamp: str, layout: sinks.Layout,
    make_classifier: Callable[[], Classifier] | None = None, responses: DataFrame | None = None,
    test_size: float = fv.TEST_SIZE, seed: int = fv.RANDOM_STATE, rounds: int = 1,
    tasks: int | None = None, make_responder: Callable[[], Responder] | None = None, provider: str = fv.TOGETHER,
    resume: bool = True, prepared: Prepared | None = None,
) -> DataFrame:
    """Scores what the checkpoint lacks, commits it, and returns all predictions.

    Answers come from a classifier, from a table of raw responses, or from a responder
    that gives raw responses (parsed and retried here). The id follows from
    dataset, model and ``stamp``, so the same call resumes an interrupted run; without
    ``resume`` all is scored anew and replaces what the checkpoint has, at once and when all is
    done. With several ``rounds`` the prompts are scored in as many parts, each committed when it is
    done; a crash then costs one part of the calls. ``prepared`` saves loading the dataset again.
    """
    ready = prepared or prepare(spark, dataset, path, test_size, seed)
    config, experiment = ready.config, hashlib.md5(f"{dataset}_{model}_{stamp}".encode()).hexdigest()[:8]
    log = CommitLog(spark, layout.checkpoints)
    run = log.begin(experiment, resume)
    todo = ready.prompted
    if run.resumes():
        done = run.done(schemas.PREDICTIONS)
        todo = remaining(todo, done, screen=filter_of(done))
    if make_responder is not None:
        answers = layout.responses if resume else f"{layout.responses}-anew-{run.name}"
        responses = ask_in_rounds(todo, make_responder, experiment, provider, answers, tasks=tasks)
    if responses is not None:
        run.add(answered(todo, responses, config, experiment))
    else:
        for number, part in enumerate(_parts(todo, rounds)):
            scored = classify(part, make_classifier, experiment, stamp, tasks=tasks)
            run.add(conform(judged(scored, config.positive_class, config.negative_class)), str(number))
    run.finish()
    return log.read(schemas.PREDICTIONS, [experiment])


def _parts(prompted: DataFrame, rounds: int) -> Iterator[DataFrame]:
    if rounds <= 1:
        yield prompted
        return
    path = new_folder(prompted.sparkSession, "rounds")
    numbered = prompted.withColumn("round", F.pmod(F.xxhash64("record_id"), F.lit(rounds)).cast("int"))
    numbered.write.mode("append").partitionBy("round").parquet(path)
    written = prompted.sparkSession.read.schema(numbered.schema).parquet(path)
    for number in range(rounds):
        yield written.where(F.col("round") == number).drop("round")


def rule_classifier(label: Callable[[str], str]) -> Callable[[], Classifier]:
    """A classifier without a model: a label from the user prompt. For tests and dry runs."""

    def make() -> Classifier:
        def call(system_prompt: str, user_prompt: str, record_id: str, max_attempts: int) -> dict:
            return {"prediction_label": label(user_prompt), "reasoning": "rule", "api_success": True}

        return call

    return make
