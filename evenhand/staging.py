"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else a folder in its warehouse. A cluster has to name a folder that all
    executors share: a warehouse on the driver's own disk will not do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    one_machine = spark.sparkContext.master.split("[")[0] == "local"
    place = spark._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(spark._jsc.hadoopConfiguration())
    if not one_machine and place.getUri().getScheme() == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_work"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder, which is deleted when the session's JVM ends."""
    path = f"{work_folder(spark).rstrip('/')}/evenhand/{name}-{uuid.uuid4().hex[:12]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a small result and read it back: lineage ends, and the planner knows its size."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
