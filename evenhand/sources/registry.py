"""Datasets by name: configuration, loader and row text. Users add their own."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.describe import Describe, describe_row
from ..functions.text import record_id
from ..operators.prepare import to_samples
from ..operators.split import stratified_test_split


@dataclass(frozen=True)
class DatasetConfig:
    key: str
    name: str
    dataset_type: str
    sensitive_features: tuple[str, ...]
    target_column: str
    positive_class: str
    negative_class: str
    task_description: str
    describe: Describe = describe_row


@dataclass(frozen=True)
class Loaded:
    """Samples (record_id, ground_truth, sensitive_feature, features) and how to read them."""

    samples: DataFrame
    feature_columns: tuple[str, ...]
    config: DatasetConfig

    def described(self) -> DataFrame:
        """Samples with their row text instead of the single features."""
        text: Column = self.config.describe(self.samples, self.feature_columns)
        return self.samples.select("record_id", "ground_truth", "sensitive_feature",
                                   text.alias("data_description"))


@dataclass(frozen=True)
class TwoParts:
    """A dataset whose targets are a narrow table of their own. It is split by the targets
    alone; only rows that are kept are joined to their features. A target without features
    is a sample with missing ones; features without a target are no sample."""

    features: DataFrame
    targets: DataFrame
    truth: Column
    group: Column
    feature_columns: tuple[str, ...]
    key: str = "row_id"

    def labels(self) -> DataFrame:
        return self.targets.select(self.key, record_id(self.key).alias("record_id"), self.truth.alias("ground_truth")).where(
            F.col("ground_truth").isNotNull())

    def samples(self, labels: DataFrame) -> DataFrame:
        joined = labels.join(self.features, self.key, "left")
        return to_samples(joined, F.col("record_id"), F.col("ground_truth"), self.group, self.feature_columns)


Loader = Callable[[SparkSession, str, int], "DataFrame | TwoParts"]
DATASETS: dict[str, tuple[DatasetConfig, Loader]] = {}


def register(config: DatasetConfig) -> Callable[[Loader], Loader]:
    """Decorator: ``fn(spark, path, seed) -> samples`` becomes a dataset's loader."""

    def add(loader: Loader) -> Loader:
        DATASETS[config.key] = (config, loader)
        return loader

    return add


def dataset_config(name: str) -> DatasetConfig:
    if name not in DATASETS:
        raise ValueError(f"Unknown dataset: {name}")
    return DATASETS[name][0]


def _loaded(name: str, source: DataFrame | TwoParts, choose: Callable[[DataFrame], DataFrame]) -> Loaded:
    if isinstance(source, TwoParts):
        return Loaded(source.samples(choose(source.labels())), source.feature_columns, dataset_config(name))
    return Loaded(choose(source), tuple(source.columns[3:]), dataset_config(name))


def load_all(spark: SparkSession, name: str, path: str, seed: int = fv.RANDOM_STATE) -> Loaded:
    """Every sample of a dataset, before the split."""
    dataset_config(name)
    return _loaded(name, DATASETS[name][1](spark, path, seed), lambda rows: rows)


def load_dataset(
    spark: SparkSession, name: str, path: str, test_size: float = fv.TEST_SIZE, seed: int = fv.RANDOM_STATE
) -> Loaded:
    """The test samples of a dataset: loader, then the exact stratified split. Every label
    is a stratum, also one that is not among the dataset's two classes."""
    dataset_config(name)
    return _loaded(name, DATASETS[name][1](spark, path, seed),
                   lambda rows: stratified_test_split(rows, test_size=test_size, seed=seed))


def foreign_labels(loaded: Loaded) -> DataFrame:
    """Labels of samples that are not among the dataset's classes, with their counts."""
    classes = (loaded.config.positive_class, loaded.config.negative_class)
    return loaded.samples.where(~F.col("ground_truth").isin(*classes)).groupBy("ground_truth").agg(
        F.count(F.lit(1)).alias("count"))


def datasets_table(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """The registry as a dimension table: all of it, or the named datasets in it.
    An unknown name stops the run."""
    picked = [dataset_config(n) for n in names] if names is not None else [c for c, _ in DATASETS.values()]
    rows = [
        (c.key, c.name, c.dataset_type, list(c.sensitive_features), c.target_column,
         c.positive_class, c.negative_class, c.task_description)
        for c in picked
    ]
    return spark.createDataFrame(
        rows, "dataset_name string, name string, dataset_type string, sensitive_features array<string>, "
        "target_column string, positive_class string, negative_class string, task_description string")


def models_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in fv.MODELS.items()],
                                 "model_key string, model_name string, api_provider string")


def with_dataset(rows: DataFrame, key: str = "dataset_name") -> DataFrame:
    """Rows with their dataset's configuration. The registry is code, so it is small."""
    table = F.broadcast(datasets_table(rows.sparkSession))
    return rows.join(table.withColumnRenamed("dataset_name", key), key, "left")
