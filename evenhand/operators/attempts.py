"""Attempt logs to one outcome per record."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import responses as R
from ..functions.labels import is_correct, with_normalized
from ..schemas import struct
from .attempt_fold import SLOT

RECORD = ("experiment_id", "record_id")
_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
ENTRY = struct(_attempt=_I, _stops=T.BooleanType(), ts=_L, outcome=_S, prediction_label=_S, reasoning=_S, error_message=_S, wait_seconds=_L)
OUTCOME = struct(prediction_label=_S, reasoning=_S, api_success=T.BooleanType(), attempts_made=_I, ts=_L, error_message=_S,
                 wait_seconds=_L, outcome=_S)


def entries(attempts: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Classified attempts as entries of a fold. Attempts count from one: a number that is null or less is taken as one."""
    return attempts.select(
        *keys, F.greatest(F.coalesce("attempt", F.lit(1)), F.lit(1)).cast("int").alias("_attempt"),
        F.coalesce("stops", F.lit(False)).alias("_stops"),
        *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c == "ts" else F.col(c).cast(ENTRY[c].dataType).alias(c) for c in SLOT])


def with_times(outcomes: DataFrame, like: DataFrame) -> DataFrame:
    """Outcomes with times of the type that the attempts have."""
    return outcomes.withColumn("ts", F.timestamp_micros("ts").cast(like.schema["ts"].dataType))


def reduce_attempts(attempts: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Outcome per record: attempts count up to the first success or block; later ones
    are ignored even if they are in the log. There may be any number of them, in any order, and a row
    that was logged twice counts once. Of rows that differ and have one number the latest counts.
    A record whose attempts have no number keeps one attempt.

    Each task drops what its own rows show to be repeated or after the first stop, as merging two states of
    ``attempt_fold`` does, so partial results merge in any order. The rest is shuffled once, by record, and read
    in the order of attempts; windows and sums need no further shuffle and spill if a record is long.
    """
    order = Window.partitionBy(*keys).orderBy("_attempt", *[F.col(c).desc_nulls_last() for c in SLOT])
    rows = entries(attempts, keys)
    read = rows.mapInArrow(_pruned(list(keys)), rows.schema).repartition(*keys).withColumns({
        "_before": F.lag("_attempt").over(order),
        "_stopped": F.max("_stops").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    # of an attempt its greatest entry, if no attempt before it stops the record
    used = read.where((F.col("_before").isNull() | (F.col("_before") < F.col("_attempt"))) & ~F.coalesce("_stopped", F.lit(False)))
    error = F.col("error_message")
    final = used.groupBy(*keys).agg(
        F.max("_attempt").alias("attempts_made"), F.max_by(F.struct(*SLOT[:4]), "_attempt").alias("_final"),
        # an error before a later success stays on the record
        F.max_by(error, F.when(error.isNotNull(), F.col("_attempt"))).alias("error_message"),
        F.sum(F.coalesce("wait_seconds", F.lit(0))).cast("long").alias("wait_seconds"))
    return with_times(final.select(
        *keys, "_final.prediction_label", "_final.reasoning",
        F.coalesce(F.col("_final.outcome") == R.SUCCESS, F.lit(False)).alias("api_success"),
        "attempts_made", "_final.ts", "error_message", "wait_seconds", "_final.outcome"), attempts)


def _pruned(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a batch, each once, without those after the first stop that the batch has of their record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            once = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([])
            stops = once.filter(once["_stops"]).group_by(keys, use_threads=False).aggregate([("_attempt", "min")])
            if stops.num_rows:
                once = once.join(stops, keys, join_type="left outer", use_threads=False)
                once = once.filter(pc.less_equal(once["_attempt"], pc.coalesce(once["_attempt_min"], once["_attempt"])))
            yield from once.select(names).cast(batch.schema).to_batches()

    return run


def to_predictions(
    samples: DataFrame, outcomes: DataFrame, positive: str, negative: str,
    keys: Sequence[str] = ("record_id",),
) -> DataFrame:
    """Outcomes joined to their samples, labels normalised, correctness set.

    A sample without any outcome becomes a failed row with no attempts.
    """
    return judged(samples.join(outcomes, list(keys), "left"), positive, negative)


def judged(rows: DataFrame, positive: str, negative: str) -> DataFrame:
    """Answered samples with normalised ``prediction`` and ``correct``."""
    return with_normalized(rows, "prediction_label", positive, negative).withColumns({
        "prediction": F.coalesce("prediction", "prediction_label"),
        "api_success": F.coalesce("api_success", F.lit(False)),
        "attempts_made": F.coalesce("attempts_made", F.lit(0)),
    }).withColumn("correct", is_correct("api_success", "prediction", "ground_truth"))
