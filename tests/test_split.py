import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evenhand.operators import split
from evenhand.operators.split import capped_sample, stratified_test_split, test_quotas as quotas_of


def plain_quotas(counts, size):
    """Test rows per class by the largest-remainder rule, on the train side."""
    total = sum(counts.values())
    train = total - math.ceil(size * total)
    base = {k: c * train // total for k, c in counts.items()}
    order = sorted(counts, key=lambda k: (-(counts[k] * train % total), k))
    for k in order[: train - sum(base.values())]:
        base[k] += 1
    return {k: counts[k] - base[k] for k in counts}


def plain_split(rows, size, seed):
    counts = {}
    for _, label in rows:
        counts[label] = counts.get(label, 0) + 1
    quota, out = plain_quotas(counts, size), set()
    for label, k in quota.items():
        ids = sorted((hashlib.md5(f"{i}_{seed}".encode()).hexdigest(), i) for i, x in rows if x == label)
        out |= {i for _, i in ids[:k]}
    return out


@pytest.mark.parametrize("counts,size", [
    ({"bad": 58, "good": 341}, 0.2), ({"a": 1, "b": 9}, 0.2), ({"a": 3, "b": 3, "c": 3}, 0.5),
    ({"a": 7}, 0.3), ({"x": 2, "y": 2, "z": 1}, 0.25), ({"a": 100000, "b": 1}, 0.1)])
def test_quotas(spark, counts, size):
    df = spark.createDataFrame(list(counts.items()), "stratum string, c long")
    got = {r.stratum: r.k for r in quotas_of(df, size).collect()}
    assert got == plain_quotas(counts, size) and sum(got.values()) == math.ceil(size * sum(counts.values()))


def test_worked_example(spark):
    df = spark.createDataFrame([("bad", 58), ("good", 341)], "stratum string, c long")
    assert {r.stratum: r.k for r in quotas_of(df).collect()} == {"bad": 12, "good": 68}


def random_rows(n, seed):
    rng = random.Random(seed)
    return [(f"rec_{i:06d}", "good" if rng.random() < 0.9 else "bad") for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("classes", [("good", "bad"), None])
def test_split_equals_plain_and_is_stable(spark, levels, classes):
    rows = random_rows(3000, 1)
    df = spark.createDataFrame(rows, "record_id string, ground_truth string")
    expected = plain_split(rows, 0.2, 42)
    for parts in (1, 7):
        test = stratified_test_split(df.repartition(parts), classes=classes, levels=levels)
        got = [r.record_id for r in test.collect()]
        assert set(got) == expected and len(got) == len(expected) == 600


def test_split_leaves_out_missing_and_foreign_labels(spark):
    rows = random_rows(200, 2)
    df = spark.createDataFrame([*rows, ("n1", None), ("n2", "odd")], "record_id string, ground_truth string")
    got = {r.record_id for r in stratified_test_split(df, classes=("good", "bad")).collect()}
    assert got == plain_split(rows, 0.2, 42)


def test_split_when_hashes_share_a_prefix(spark, monkeypatch):
    """All keys under one prefix, as with a much larger table: the rank decides."""
    rows = random_rows(500, 3)
    monkeypatch.setattr(split, "DIGITS", 0)
    df = spark.createDataFrame(rows, "record_id string, ground_truth string")
    got = {r.record_id for r in stratified_test_split(df, classes=("good", "bad")).collect()}
    assert got == plain_split(rows, 0.2, 42)


@pytest.mark.parametrize("large", [1, 20, 100_000])
def test_many_undeclared_classes(spark, monkeypatch, large):
    """All classes small, some of them large, or all large: the same rows. Ties of remainders go by label."""
    monkeypatch.setattr(split, "LARGE_CLASSES", large)
    monkeypatch.setattr(split, "BOUNDS", 16)
    rng = random.Random(8)
    rows = [(f"rec_{i:06d}", "hot" if i % 3 == 0 else f"class_{rng.randrange(900)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "record_id string, ground_truth string").repartition(5)
    got = [r.record_id for r in stratified_test_split(df).collect()]
    expected = plain_split(rows, 0.2, 42)
    assert set(got) == expected and len(got) == len(expected) == 800


@pytest.mark.parametrize("bounds", [1, 16, 256])
def test_every_place_is_found(spark, monkeypatch, bounds):
    """By any number of bounds; places of no row, as none or one too many, give nothing."""
    monkeypatch.setattr(split, "BOUNDS", bounds)
    order = sorted((-(i % 7), f"class_{i:03d}") for i in range(300))
    df = spark.createDataFrame([(x,) for x in order], "_order struct<rem: long, stratum: string>").repartition(3)
    size = F.lit(len(order))
    for n in (None, 0, 1, 2, 43, 150, 299, 300, 301):
        got = [tuple(r[0]) for r in split._nth(df, "_order", size, F.lit(n).cast("long")).collect()]
        assert got == (order[n - 1:n] if n else [])


def test_classes_are_halved_down_to_one_range(spark):
    """No class is compared with all bounds, and not all classes are ranked to find those that get one row more."""
    df = spark.range(2000).select(F.concat(F.lit("class_"), "id").alias("stratum"), (F.col("id") % 5 + 1).alias("c"))
    plan = quotas_of(df)._jdf.queryExecution().executedPlan().toString()
    assert "filter(" not in plan
    assert not re.search(r"Window .*\[_range#\d+\], \[_order#\d+", plan)
    got = {r.stratum: r.k for r in quotas_of(df).collect()}
    assert got == plain_quotas({f"class_{i}": i % 5 + 1 for i in range(2000)}, 0.2)


def test_split_runs_no_job_at_definition(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 50).cast("string").alias("ground_truth"))
    spark.sparkContext.setJobGroup("split-definition", "split")
    stratified_test_split(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("split-definition")
    spark.sparkContext._jsc.clearJobGroup()


def test_split_of_nothing(spark):
    assert stratified_test_split(spark.createDataFrame([], "record_id string, ground_truth string")).count() == 0


def test_copies_of_a_key_stay_together(spark):
    rows = random_rows(300, 5) + [("copy", "good")] * 150
    df = spark.createDataFrame(rows, "record_id string, ground_truth string")
    got = [r.record_id for r in stratified_test_split(df, classes=("good", "bad")).collect()]
    assert got.count("copy") in (0, 150) and len(got) >= 90


def test_other_seed_takes_other_rows(spark):
    rows = random_rows(400, 4)
    df = spark.createDataFrame(rows, "record_id string, ground_truth string")
    got = {r.record_id for r in stratified_test_split(df, seed=7, test_size=0.33, classes=("good", "bad")).collect()}
    assert got == plain_split(rows, 0.33, 7)


@pytest.mark.parametrize("n", [1, 250, 999, 1000, 5000])
def test_capped_sample(spark, n):
    df = spark.range(1000).withColumn("record_id", F.col("id").cast("string"))
    got = {r.record_id for r in capped_sample(df, n).collect()}
    ids = sorted((hashlib.md5(f"{i}_42".encode()).hexdigest(), str(i)) for i in range(1000))
    assert got == {i for _, i in ids[:n]}


def test_wide_rows_are_not_shuffled(spark):
    """The row payload is in no exchange: the choice is a filter on the scan."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("record_id"),
                                  F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("ground_truth"),
                                  F.repeat(F.lit("x"), 50).alias("payload"))
    for out in (stratified_test_split(df, classes=("a", "b")), capped_sample(df, 100)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "payload" in line]
        assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
