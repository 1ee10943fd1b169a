"""Table preparation: feature selection, conforming, joining parts, analysis mask."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import col


def features_except(df: DataFrame, *reserved: str) -> list[str]:
    """All columns but the target, the ids and the group columns, in table order."""
    return [c for c in df.columns if c not in reserved]


def features_kept(df: DataFrame, keep: Iterable[str]) -> list[str]:
    """Those of a keep-list that the table has, in keep-list order."""
    present = set(df.columns)
    return [c for c in keep if c in present]


def to_samples(
    df: DataFrame, record_id: Column, truth: Column, group: Column, features: Sequence[str]
) -> DataFrame:
    """One wide row per sample: id, truth, group, then the features."""
    return df.select(
        record_id.alias("record_id"), truth.alias("ground_truth"), group.alias("sensitive_feature"),
        *[F.col(f"`{f}`") for f in features],
    )


def with_targets(features: DataFrame, targets: DataFrame, on: str = "row_id") -> DataFrame:
    """Features and targets side by side by row key; a row missing in one part stays."""
    return features.join(targets, on, "full_outer")


def conform(df: DataFrame, schema: T.StructType = schemas.PREDICTIONS,
            rename: Mapping[str, str] | None = None) -> DataFrame:
    """Exactly the schema's columns, in order; a column the table lacks is NULL."""
    for old, new in (rename or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def successful(predictions: DataFrame) -> DataFrame:
    return predictions.where("api_success")


def analysis_set(predictions: DataFrame) -> DataFrame:
    """Successful rows with a group (neither NULL nor the text 'None'), a prediction
    and a truth. The text 'nan' is a group."""
    return successful(predictions).where(
        F.col("sensitive_feature").isNotNull() & (F.col("sensitive_feature") != "None")
        & F.col("prediction").isNotNull() & F.col("ground_truth").isNotNull()
    )


def member_of(c: Column | str, values: Iterable[str]) -> Column:
    return col(c).isin(*values)
