"""Filters, user aggregates, sketches and totals that are made of parts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.operators import user_aggregate
from evenhand.operators.bloom import BloomFilter, comparable, filter_of
from evenhand.operators.resume import remaining
from evenhand.operators.scan import with_total_before
from evenhand.operators.sketches import estimated_groups, group_sketches, united
from evenhand.operators.user_aggregate import ThresholdCurve, aggregate, curve_rows

longs = st.lists(st.integers(-2**63, 2**63 - 1), max_size=50)


@settings(max_examples=100, deadline=None)
@given(longs, longs)
def test_filter_never_forgets_and_merges(one, two):
    a, b = BloomFilter.empty(50), BloomFilter.empty(50)
    a.add(np.array(one, np.int64))
    b.add(np.array(two, np.int64))
    both = a.merge(b)
    assert both.may_hold(np.array(one + two, np.int64)).all()
    assert np.array_equal(both.bits, b.merge(a).bits) and np.array_equal(both.merge(a).bits, both.bits)


def test_filter_rejects_most_new_keys(spark):
    done = spark.range(100_000).select((F.col("id") * 2).alias("k")).repartition(5)
    found = filter_of(done, ["k"])
    rows = spark.range(200_000).select(F.col("id").alias("k"))
    hashes = np.array([r[0] for r in rows.select(F.xxhash64("k")).collect()], np.int64)
    maybe = found.may_hold(hashes)
    assert maybe[::2].all() and maybe[1::2].mean() < 0.05


@pytest.mark.parametrize("most_bytes", [1 << 16, 1 << 24])
def test_remaining_with_a_filter_is_the_anti_join(spark, most_bytes):
    """Also where the filter is much too small, with null keys, and with numbers of other widths."""
    samples = spark.range(30_000).select(F.when(F.col("id") % 100 > 0, F.col("id").cast("int")).alias("k"), F.lit("wide text").alias("text"))
    done = spark.range(60_000).where("id % 3 = 0").select("id").unionByName(spark.range(500)).select(F.col("id").alias("k"))
    want = remaining(samples, done, ["k"])
    got = remaining(samples, done, ["k"], filter_of(done, ["k"], most_bytes))
    assert got.groupBy("k").count().exceptAll(want.groupBy("k").count()).count() == 0 and got.count() == want.count()
    assert not comparable(samples, done.select(F.col("k").cast("double")), ["k"])
    other = done.select(F.col("k").cast("double").alias("k"))
    assert remaining(samples, other, ["k"], filter_of(done, ["k"])).count() == want.count()


def test_new_records_are_not_shuffled(spark, tmp_path):
    samples = spark.range(1000).select(F.col("id").alias("record_id"), F.repeat(F.lit("prompt "), 50).alias("prompt"))
    samples.write.parquet(str(tmp_path / "p"))
    done = spark.range(200).withColumnRenamed("id", "record_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = remaining(spark.read.parquet(str(tmp_path / "p")), done, screen=filter_of(done))
        assert found.count() == 800
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    fresh, checked = plan.split("Union", 1)[1].split("Scan parquet", 2)[:2]
    assert "Exchange" not in fresh and "Exchange" in checked + plan
    rejected = spark.read.parquet(str(tmp_path / "p"))
    from evenhand.operators.bloom import maybe_in

    assert rejected.where(maybe_in(filter_of(done), rejected, ["record_id"])).count() < 250


def longest():
    # a class of its own, so that tasks get it by value
    class Longest:
        """The longest text and how many rows there were."""

        columns, result = ("text",), T.StructType().add("longest", "string").add("rows", "long")

        def init(self):
            return None, 0

        def update(self, state, rows):
            return self.merge(state, (max((t for t in rows["text"].to_pylist() if t is not None), key=lambda t: (len(t), t), default=None), len(rows)))

        def merge(self, one, other):
            return max((t for t in (one[0], other[0]) if t is not None), key=lambda t: (len(t), t), default=None), one[1] + other[1]

        def finish(self, state):
            return {"longest": state[0], "rows": state[1]}

    return Longest()


@pytest.mark.parametrize("most", [2, 10_000])
def test_user_aggregate_over_parts(spark, monkeypatch, most):
    monkeypatch.setattr(user_aggregate, "MOST_GROUPS", most)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 3), rng.choice([None, "x", "yy", "zzz"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, text string").repartition(7)
    got = {(r.g, r.k): (r.longest, r.rows) for r in aggregate(df, ["g", "k"], longest()).collect()}
    assert len(got) == 12
    for key, (text, n) in got.items():
        mine = [t for g, k, t in rows if (g, k) == key]
        assert n == len(mine) and text == max((t for t in mine if t), key=lambda t: (len(t), t), default=None)
    plan = aggregate(df, ["g", "k"], longest())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert aggregate(df.limit(0), ["g"], longest()).count() == 0


def test_threshold_curve(spark):
    rng = random.Random(2)
    rows = [("a", rng.random(), rng.random() < 0.4) for _ in range(2000)] + [("b", 0.5, True), ("a", None, True), ("a", 0.1, None), ("a", 7.0, True)]
    found = aggregate(spark.createDataFrame(rows, "g string, s double, p boolean").repartition(6), ["g"], ThresholdCurve("s", "p", bins=10))
    points = {(r.g, round(r.threshold, 6)): r for r in curve_rows(found, ["g"]).collect()}
    known = [(s, p) for g, s, p in rows if g == "a" and s is not None and p is not None]
    for k in range(10):
        r = points["a", k / 10]
        assert r.true_positives == sum(p and s * 10 >= k for s, p in known) and r.false_positives == sum(not p and s * 10 >= k for s, p in known)
    bins = [(min(int(s * 10), 9), p) for s, p in known]
    pos, neg = [b for b, p in bins if p], [b for b, p in bins if not p]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(points["a", 0.0].auc - auc) < 1e-9 and points["b", 0.0].auc is None and points["b", 0.0].fpr is None
    table = pa.table({"s": [0.1], "p": [True]})
    curve = ThresholdCurve("s", "p")
    assert (curve.merge(curve.update(curve.init(), table), curve.init()) == curve.update(curve.init(), table)).all()


def test_sketches_unite_over_days(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).cast("string").alias("experiment_id"), (F.col("id") % 5).alias("day"),
                                      (F.col("id") % 20_000).cast("string").alias("sensitive_feature"))
    sketches = group_sketches(rows, ("experiment_id", "day"))
    for r in estimated_groups(united(sketches)).collect():
        assert abs(r.num_groups - 10_000) < 300
    assert estimated_groups(group_sketches(rows.withColumn("sensitive_feature", F.lit(None).cast("string")))).first().num_groups == 0


def test_totals_before_rows(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 11).alias("v")).repartition(9)
    want, total = {}, 0
    for k, v in sorted((r.k, r.v) for r in rows.collect()):
        want[k], total = total, total + v
    assert {r.k: r.before for r in with_total_before(rows, ["k"], "v", "before").collect()} == want
