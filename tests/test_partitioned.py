"""The data source for tables in folders by column values."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evenhand.sources.partitioned import RowGroups, PartitionedTable, read_partitioned

FOLDERS = "year int, state string"


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("survey") / "acs")
    spark.range(600).select(
        "id", (F.col("id") * 1.5).alias("income"), (2018 + F.col("id") % 3).cast("int").alias("year"),
        F.when(F.col("id") % 5 == 0, "New York").when(F.col("id") % 5 == 1, "CA").when(F.col("id") % 5 == 2, "x/y=z").alias("state"),
    ).write.partitionBy("year", "state").parquet(path)
    return path


def test_equal_to_the_own_reader(spark, survey):
    want = spark.read.schema("id long, income double, year int, state string").parquet(survey)
    got = read_partitioned(spark, survey, FOLDERS)
    assert got.schema.simpleString() == want.schema.simpleString()
    for condition in ("true", "year = 2018", "year = 2019 and state in ('CA', 'New York')", "state is null", "state is not null and id < 50",
                      "state = 'x/y=z'", "year > 2018 and state <> 'CA'", "year = 1999", "state is null and state = 'CA'"):
        assert sorted(map(tuple, got.where(condition).collect()), key=str) == sorted(map(tuple, want.where(condition).collect()), key=str)


def test_folders_that_do_not_match_are_not_opened(spark, tmp_path):
    for split in ("train", "test"):
        (tmp_path / f"split={split}").mkdir()
    pq.write_table(pa.table({"n": [1, 2]}), tmp_path / "split=train" / "a.parquet")
    (tmp_path / "split=test" / "b.parquet").write_text("no parquet file")
    (tmp_path / "split=train" / "_SUCCESS").write_text("")
    pq.write_table(pa.table({"n": [1, 2]}), tmp_path / "split=test" / "a.parquet")  # the schema's first file
    rows = read_partitioned(spark, str(tmp_path), "split string")
    assert [r.n for r in rows.where("split = 'train'").collect()] == [1, 2]
    with pytest.raises(Exception, match="b.parquet|magic"):
        rows.where("split = 'test'").collect()


def test_columns_and_missing_columns(spark, tmp_path):
    for k, table in enumerate((pa.table({"a": [1], "b": ["x"], "c": [0.5]}), pa.table({"a": pa.array([2], pa.int32()), "c": [None]}))):
        (tmp_path / f"k={k}").mkdir()
        pq.write_table(table, tmp_path / f"k={k}" / "part.parquet")
    rows = read_partitioned(spark, str(tmp_path), "k int", ["a", "b"])
    assert rows.columns == ["a", "b", "k"]
    assert sorted(map(tuple, rows.collect())) == [(1, "x", 0), (2, None, 1)]
    with pytest.raises(Exception, match="not in"):
        read_partitioned(spark, str(tmp_path), "k int", ["d"]).schema


def test_large_files_are_read_by_row_groups(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    pq.write_table(pa.table({"a": list(range(1000))}), tmp_path / "k=1" / "part.parquet", row_group_size=100)
    source = PartitionedTable({"path": str(tmp_path), "partitions": "k int", "split_bytes": "1"})
    parts = source.reader(source.schema()).partitions()
    assert [(p.first, p.last) for p in parts] == [(i, i + 1) for i in range(10)] and isinstance(parts[0], RowGroups)
    rows = spark.read.format("evenhand").option("partitions", "k int").option("split_bytes", 1).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 10 and rows.agg(F.sum("a")).first()[0] == 499500


def test_nothing_there(spark, tmp_path):
    with pytest.raises(Exception, match="no file"):
        read_partitioned(spark, str(tmp_path), "k int").schema
