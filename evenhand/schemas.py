"""Explicit schemas of the tables that cross a storage boundary."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


PREDICTIONS = struct(
    record_id=_S, ground_truth=_S, prediction=_S, sensitive_feature=_S, experiment_id=_S,
    reasoning=_S, api_success=_B, attempts_made=_I, timestamp=_S, correct=_B,
)

# One row per call to a model; several attempts may share a record.
RESPONSES = struct(
    experiment_id=_S, record_id=_S, provider=_S, attempt=_I, status=_S,
    error_text=_S, finish_reason=_I, content=_S, ts=T.TimestampType(),
)

# What a classifier plug-in yields per record.
CLASSIFIED = struct(
    record_id=_S, experiment_id=_S, prediction_label=_S, reasoning=_S, api_success=_B,
    attempts_made=_I, timestamp=_S, error_message=_S,
)

EXPERIMENTS = struct(
    experiment_id=_S, dataset_name=_S, model_name=_S, model_size=_S, api_provider=_S,
    dataset_type=_S, temperature=_D, max_tokens=_I, test_size=_D, random_state=_I, timestamp=_S,
)

RUN_RESULTS = struct(
    experiment_id=_S, dataset=_S, model=_S, status=_S, error=_S,
    successful_predictions=_L, failed_predictions=_L, accuracy=_D,
)

_SCORES = T.MapType(_S, _D)

SUMMARY = struct(
    experiment_id=_S, timestamp=_S, dataset=_S, model=_S, model_size=_S, api_provider=_S,
    total_samples=_L, num_groups=_L,
    overall_metrics=_SCORES, fairness_differences=_SCORES, fairness_ratios=_SCORES,
    group_summary=T.MapType(_S, struct(
        best_group=_S, best_value=_D, worst_group=_S, worst_value=_D, gap=_D)),
    binary_metrics=struct(demographic_parity_difference=_D, equalized_odds_difference=_D),
)

# What a summary says by group, a row per group and label or metric.
GROUP_ROWS = struct(experiment_id=_S, section=_S, metric=_S, grp=_S, label=_S, count=_L, value=_D)
