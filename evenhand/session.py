"""A local session with the settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that also hold on a cluster; sizes of partitions are left to AQE there.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(
    cpus: int | str = "*", app: str = "evenhand", partitions: int = 8, **settings: str
) -> SparkSession:
    """``settings`` are further options, with '_' for '.' in their names."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    named = {key.replace("_", "."): value for key, value in settings.items()}
    for key, value in (SETTINGS | named).items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
