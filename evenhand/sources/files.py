"""Readers over local copies of the source tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.scan import with_total_before
from ..staging import stage


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with a header and an explicit schema. ``multi_line`` lets quoted fields span
    lines; a file is then read by one task, so leave it off where they do not."""
    return spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option(
        "escape", '"').csv(path)


PARTS = ("features", "targets")


def read_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A two-part dataset: ``<path>/features`` and ``<path>/targets``, both with row_id. Parts that ``write_parts``
    has put into buckets are read by bucket, so their join by row_id shuffles neither."""
    buckets = _buckets(spark, path)
    if not buckets:
        return tuple(spark.read.parquet(f"{path}/{part}") for part in PARTS)
    return tuple(_bucketed(spark, path, part, buckets) for part in PARTS)


def write_parts(features: DataFrame, targets: DataFrame, path: str, buckets: int) -> None:
    """Both parts by the same buckets of row_id, a sorted file for each: choose ``buckets`` so that one fits a task."""
    for part, rows in zip(PARTS, (features, targets)):
        name, place = _table_name(path, part), f"{path}/{part}.{buckets}"
        rows.repartition(buckets, "row_id").write.bucketBy(buckets, "row_id").sortBy("row_id").option("path", place).saveAsTable(name)


def _table_name(path: str, part: str) -> str:
    return f"evenhand_{part}_{hashlib.md5(path.rstrip('/').encode()).hexdigest()[:16]}"


def _buckets(spark: SparkSession, path: str) -> int:
    """The number of buckets in the name of the folder of features; 0 for a plain one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
    return max((int(n.split(".")[1]) for n in names if re.fullmatch(r"features\.\d+", n)), default=0)


def _bucketed(spark: SparkSession, path: str, part: str, buckets: int) -> DataFrame:
    """The catalog of this session may not know a table that another one has written."""
    name, place = _table_name(path, part), f"{path}/{part}.{buckets}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (row_id) SORTED BY (row_id) "
                  f"INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def read_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """One named split of a table partitioned by ``split``; other splits are not read."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def read_survey(spark: SparkSession, path: str, year: int = 2018, states: tuple[str, ...] = ("CA",)) -> DataFrame:
    """Survey rows of a year and some states, by partition pruning."""
    return spark.read.parquet(path).where(
        (F.col("year") == year) & F.col("state").isin(*states)).drop("year", "state")


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds a dense ``row_id`` in file order, for a source that has no key.

    One pass over the source writes its rows, each with its file, block and place; the
    number of rows before each block is then counted in what was written, so blocks and
    rows always agree, however the source is split. Run it once at ingest, on a plain scan.
    """
    placed = stage(df.withColumns({
        "_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
        "_id": F.monotonically_increasing_id(),
    }), "ingest")
    blocks = placed.groupBy("_file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    offsets = with_total_before(blocks, ("_file", "_start"), "_rows", "_before").drop("_rows")
    return placed.join(offsets, ["_file", "_start"]).withColumn(
        "row_id", F.col("_before") + F.col("_id") - F.col("_first")
    ).drop("_file", "_start", "_id", "_first", "_before")


def read_predictions(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTIONS) -> DataFrame:
    """A predictions table; a missing path is an empty table."""
    return _read_or_empty(spark, path, schema, skip_unreadable=False)


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTIONS) -> DataFrame:
    """As ``read_predictions``, but files that cannot be read are left out: their
    records are then scored again."""
    return _read_or_empty(spark, path, schema, skip_unreadable=True)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType, skip_unreadable: bool) -> DataFrame:
    try:
        table = spark.read.schema(schema).option("ignoreCorruptFiles", skip_unreadable).parquet(path)
        return table.select(schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary documents, one JSON object per line, on the explicit schema."""
    return spark.read.schema(schemas.SUMMARY).json(path).select(schemas.SUMMARY.fieldNames())


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Experiment configurations on the explicit schema."""
    return spark.read.schema(schemas.EXPERIMENTS).json(path).select(schemas.EXPERIMENTS.fieldNames())


def read_reasons(spark: SparkSession, path: str) -> DataFrame:
    """Experiments without an analysis, with the reason."""
    return spark.read.schema("experiment_id string, error string").json(path).where(F.col("error").isNotNull())
