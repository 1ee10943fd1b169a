"""Calls to a model in rounds of attempts: each round asks again for what is still open.

The retry loop runs over attempts, not over records: a round calls the model for all
open records at once, logs the raw answers, and the log decides, by the same parsing
and stop rules as everywhere, which records the next round asks for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions.fixed_values import MAX_ATTEMPTS
from ..functions.responses import classify_attempts
from ..sources.files import read_predictions

Responder = Callable[[str, str, str], dict]


def ask(
    prompted: DataFrame, make_responder: Callable[[], Responder], experiment: str, provider: str, attempt: int,
) -> DataFrame:
    """One attempt per record as ``schemas.RESPONSES``.

    ``make_responder`` is called once per task and returns ``fn(system_prompt,
    user_prompt, record_id)``, which gives ``content`` and, if it has them, ``status``
    (ok, error or no_candidates), ``error_text`` and ``finish_reason``. What it raises
    is logged as an error.
    """
    answer = to_arrow_schema(schemas.RESPONSES)

    def call(respond: Responder, system: str, user: str, record: str) -> dict:
        base = {"experiment_id": experiment, "record_id": record, "provider": provider, "attempt": attempt,
                "status": "ok"}
        try:
            row = base | respond(system, user, record)
        except Exception as error:
            row = base | {"status": "error", "error_text": str(error)}
        return row | {"ts": dt.datetime.now(dt.timezone.utc)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        respond = make_responder()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_pylist([call(respond, *row) for row in zip(*columns)], answer)

    return prompted.select("system_prompt", "user_prompt", "record_id").mapInArrow(run, schemas.RESPONSES)


def ask_in_rounds(
    prompted: DataFrame, make_responder: Callable[[], Responder], experiment: str, provider: str, log: str,
    max_attempts: int = MAX_ATTEMPTS, tasks: int | None = None,
) -> DataFrame:
    """Asks up to ``max_attempts`` times for each record and returns its log.

    ``log`` is a table that grows by one partition per round. A run that broke off
    goes on with the round it was in; an answer that was logged is not asked again.
    ``prompted`` is read once per round: stage it where it is costly.
    """
    spark = prompted.sparkSession

    def logged(attempt: int) -> DataFrame:
        rows = read_predictions(spark, log, schemas.RESPONSES)
        return rows.where((F.col("experiment_id") == experiment) & (F.col("attempt") == attempt))

    for attempt in range(1, max_attempts + 1):
        todo = prompted.join(logged(attempt).select("record_id"), "record_id", "left_anti")
        if attempt > 1:
            failed = classify_attempts(logged(attempt - 1), max_attempts).where(~F.col("stops"))
            todo = todo.join(failed.select("record_id"), "record_id", "left_semi")
        todo = todo.repartition(tasks) if tasks else todo
        ask(todo, make_responder, experiment, provider, attempt).write.mode("append").partitionBy(
            "experiment_id", "attempt").parquet(log)
        if logged(attempt).isEmpty():
            break
    return read_predictions(spark, log, schemas.RESPONSES).where(F.col("experiment_id") == experiment)
