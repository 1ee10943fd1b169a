"""Loaders of the six audited datasets, from local copies of their tables.

Each is a lazy chain: read, id, recode, group key, feature list. The split comes
after, in ``registry.load_dataset``. Group columns never stay among the features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.describe import describe_credit, describe_row
from ..functions.labels import age_bucket, group_key, recode, threshold_label
from ..functions.text import python_text, record_id, ws_strip
from ..operators.prepare import features_except, features_kept, member_of, to_samples
from ..operators.split import capped_sample
from .files import read_csv, read_parts, read_split, read_survey, with_row_id
from .registry import DatasetConfig, TwoParts, register

ADULT, COMPAS, CREDIT, FOLKTABLES, BANK, DIABETES = (
    DatasetConfig(key, *values, describe_credit if key == "german_credit" else describe_row) for key, values in fv.DATASETS.items())
HERITAGE = DatasetConfig(fv.ALIAS_DATASET, *fv.DATASETS["diabetes_readmission"])

# Columns of the recidivism file that the audit uses; the file has more.
COMPAS_COLUMNS = (
    "race", "sex", "two_year_recid", *fv.RECIDIVISM_FEATURES,
)


def _key(df: DataFrame, *names: str):
    types = {f.name: f.dataType for f in df.schema.fields}
    return group_key(*[python_text(F.col(n), types[n]) for n in names])


@register(ADULT)
def adult_income(spark: SparkSession, path: str, seed: int) -> DataFrame:
    df = read_split(spark, path)
    target = "income" if "income" in df.columns else "class"
    label = F.replace(ws_strip(F.col(target).cast("string")), F.lit("."), F.lit(""))
    features = features_except(df, target, "row_id", "race", "sex")
    return to_samples(df, record_id("row_id"), recode(label, fv.INCOME_TARGET), _key(df, "sex", "race"), features)


@register(COMPAS)
def compas(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Ids are given before the race filter, so they have gaps."""
    header = spark.read.option("header", True).csv(path).columns
    text = {"race", "sex", "c_charge_degree"}
    schema = ", ".join(
        f"`{c}` {'int' if c in COMPAS_COLUMNS and c not in text else 'string'}" for c in header)
    df = with_row_id(read_csv(spark, path, schema)).where(member_of("race", fv.RECIDIVISM_RACES))
    return to_samples(df, record_id("row_id"), recode("two_year_recid", fv.RECIDIVISM_TARGET),
                      _key(df, "sex", "race"), features_kept(df, fv.RECIDIVISM_FEATURES))


@register(CREDIT)
def german_credit(spark: SparkSession, path: str, seed: int) -> TwoParts:
    """The group stays the raw code, stripped."""
    features, targets = read_parts(spark, path)
    return TwoParts(features, targets, recode("class", fv.CREDIT_TARGET), ws_strip(python_text("Attribute9")),
                    tuple(features_except(features, "row_id", "Attribute9")))


@register(FOLKTABLES)
def folktables(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All survey rows of the default year and states; ``survey_samples`` draws fewer."""
    return survey_samples(read_survey(spark, path))


def survey_samples(df: DataFrame, max_samples: int | None = None, seed: int = fv.RANDOM_STATE) -> DataFrame:
    """Samples out of survey rows; with ``max_samples``, so many of them by hash order."""
    if max_samples is not None:
        df = capped_sample(df, max_samples, "row_id", seed)
    label = threshold_label("PINCP", fv.INCOME_THRESHOLD, "high_income", "low_income")
    features = features_except(df, "PINCP", "row_id", "RAC1P", "SEX")
    return to_samples(df, record_id("row_id"), label, _key(df, "SEX", "RAC1P"), features)


@register(BANK)
def bank_marketing(spark: SparkSession, path: str, seed: int) -> TwoParts:
    features, targets = read_parts(spark, path)
    return TwoParts(features, targets, ws_strip(python_text("y")), _key(features, "age", "job"),
                    tuple(features_except(features, "row_id", "age", "job", "marital")))


@register(HERITAGE)
@register(DIABETES)
def diabetes_readmission(spark: SparkSession, path: str, seed: int) -> TwoParts:
    """Three outcomes become two; rows with another outcome are dropped."""
    features, targets = read_parts(spark, path)
    group = age_bucket("age") if "age" in features.columns else F.lit(fv.JUNIOR)
    return TwoParts(features, targets, recode(ws_strip("readmitted"), fv.READMISSION_TARGET), group,
                    tuple(features_kept(features, fv.READMISSION_FEATURES)))
