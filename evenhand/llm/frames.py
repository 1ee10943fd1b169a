"""Helpers for frames of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends texts to Python in batches of fewer rows than the default, which is made for
    numbers: a batch lies in the memory of the executor's JVM and of its worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_total(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one pass that returns one row."""
    return docs.select(F.octet_length(text).alias("n")).agg(F.sum("n")).first()[0] or 0


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that a model of labels or languages may not learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and one struct ``rest`` of all columns, whatever their names."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"))


def with_rest(columns: str, rows: DataFrame) -> T.StructType:
    """A schema of these columns and the ``rest`` of packed rows."""
    return T.StructType.fromDDL(columns).add("rest", rows.schema["rest"].dataType)
