"""Incremental scoring: responses arrive as files, outcomes are kept up to date.

``outcome_stream`` keeps the attempts of each record as state, so a batch costs what its rows and the records
they belong to cost. ``attempt_stream`` has no state; its outcomes are reduced from all that it has written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schemas
from ..functions.fixed_values import CHECKPOINT_INTERVAL, MAX_ATTEMPTS
from ..functions.responses import SUCCESS, classify_attempts
from ..operators.attempt_fold import SLOT, AttemptFold, Entry
from ..operators.attempts import OUTCOME, RECORD, entries, reduce_attempts, with_times
from ..operators.distribution import prediction_summary


def response_stream(spark: SparkSession, path: str, files_per_trigger: int = CHECKPOINT_INTERVAL) -> DataFrame:
    """Response files of a folder, in order of arrival, some files per micro-batch."""
    return spark.readStream.schema(schemas.RESPONSES).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(path)


def attempt_stream(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Classified attempts as a stream without state: each response is parsed once, when
    it arrives, so a record may have any number of attempts, in any order and batch."""
    return classify_attempts(responses, max_attempts)


class AttemptProcessor(StatefulProcessor):
    """The attempts of a record as state; each batch gives the outcome of every record it has rows of."""

    def __init__(self, keys: Sequence[str], expire_ms: int | None) -> None:
        self.keys, self.expire_ms = list(keys), expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("attempts", T.StructType().add("fold", T.BinaryType()), self.expire_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fold = AttemptFold.load(self.held.get()[0]) if self.held.exists() else AttemptFold()
        for batch in rows:
            for text in batch["entry"]:
                entry = json.loads(text)
                fold.add(entry["_attempt"], Entry(entry["_stops"], tuple(entry.get(c) for c in SLOT)))
        self.held.update((fold.dump(),))
        found = dict(zip(OUTCOME.fieldNames(), fold.outcome().values(SUCCESS)))
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "row": [json.dumps(found)]})

    def close(self) -> None:
        pass


def outcome_stream(responses: DataFrame, keys: Sequence[str] = RECORD, max_attempts: int = MAX_ATTEMPTS,
                   expire_after: float | None = None) -> DataFrame:
    """The outcomes of the records that a batch has rows of, out of these rows and the state (update mode).

    Attempts may come late, out of order and more than once, and in any number; see ``attempt_fold``. A record's
    state is dropped ``expire_after`` seconds after its last row, if that is given; rows after that make a new record of it.
    """
    spark = responses.sparkSession
    # the only provider that keeps this kind of state
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if expire_after is not None:
        # else a query over what is there would go on with empty batches for ever, to wait for state that expires
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = entries(classify_attempts(responses, max_attempts), keys)
    packed = rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("entry"))
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("row", T.StringType())])
    processor = AttemptProcessor(keys, None if expire_after is None else int(1000 * expire_after))
    found = packed.groupBy(*keys).transformWithStateInPandas(
        processor, out, "Update", "None" if expire_after is None else "ProcessingTime")
    return with_times(found.select(*keys, F.from_json("row", OUTCOME).alias("row")).select(*keys, "row.*"), responses)


def outcomes(spark: SparkSession, out: str, keys: Sequence[str] = RECORD) -> DataFrame:
    """Outcomes per record of all attempts that a drained stream has written."""
    return reduce_attempts(spark.read.parquet(out), keys)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Processes what has arrived and stops. Each micro-batch writes the rows it
    changed as its own partition, and overwrites that partition if it runs again;
    so a crash and restart adds nothing twice, and a run without new files nothing
    at all. ``checkpoint`` holds progress and state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, keys: Sequence[str] = RECORD) -> DataFrame:
    """The newest row per key of a drained stream."""
    versions = spark.read.parquet(out)
    values = [c for c in versions.columns if c not in (*keys, "batch_id")]
    return versions.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.col("batch_id")).alias("_row")).select(*keys, "_row.*")


def running_summary(predictions: DataFrame, by: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """Prediction summary that a stream keeps up to date; its keys are few, so the
    state is small and needs no watermark."""
    return prediction_summary(predictions, by)
