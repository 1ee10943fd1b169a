"""The attempt fold: any order, any partition, any number; as a batch and as a stream."""

import datetime as dt
import random
import time

from conftest import collect
from hypothesis import given, settings
from hypothesis import strategies as st

from evenhand import schemas
from evenhand.functions.responses import classify_attempts
from evenhand.operators.attempt_fold import AttemptFold, Entry
from evenhand.operators.attempts import reduce_attempts
from evenhand.streaming.scoring import drain, latest, outcome_stream, response_stream

T0 = dt.datetime(2024, 1, 1)
GOOD = '{"prediction_label": "good", "reasoning": "r"}'

entry = st.tuples(st.integers(1, 6), st.booleans(), st.sampled_from([None, "a", "b"]), st.integers(0, 3))


def fold(rows):
    out = AttemptFold()
    for attempt, stops, error, wait in rows:
        out.add(attempt, Entry(stops, (attempt, "x", None, None, error, wait)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(entry, max_size=12), st.randoms(use_true_random=False), st.integers(0, 12))
def test_folds_merge_in_any_order_and_any_number_of_times(rows, rng, cut):
    want = fold(rows)
    mixed = rows + rows[:3]
    rng.shuffle(mixed)
    left, right = fold(mixed[:cut]), fold(mixed[cut:])
    for a, b in ((left, right), (right, left)):
        both = AttemptFold.load(a.dump())
        both.merge(b)
        both.merge(both)
        assert list(both) == list(want)
    if rows:
        stops = [r[0] for r in rows if r[1]]
        end = min(stops) if stops else max(r[0] for r in rows)
        assert want.outcome().made == end and all(a <= end for a, _ in want)


def responses(spark, rows):
    return spark.createDataFrame(
        [("e", r, "openai", n, "ok" if c else "error", None if c else e, 1, c, T0 + dt.timedelta(minutes=m)) for r, n, c, e, m in rows],
        schemas.RESPONSES)


def test_numbers_that_are_null_negative_or_huge(spark):
    rows = [("null", None, None, "code 429", 1), ("null", None, GOOD, None, 2), ("minus", -70, None, "boom", 1), ("zero", 0, GOOD, None, 1),
            ("huge", 2**31 - 1, GOOD, None, 9), ("huge", 1, None, "boom", 1), ("both", None, None, "boom", 1), ("both", 2, GOOD, None, 2)]
    got = {r["record_id"]: (r["api_success"], r["attempts_made"], r["error_message"], r["wait_seconds"])
           for r in collect(reduce_attempts(classify_attempts(responses(spark, rows))), "record_id")}
    assert got == {"null": (True, 1, None, 0), "minus": (False, 1, "API error: boom", 1), "zero": (True, 1, None, 0),
                   "huge": (True, 2**31 - 1, "API error: boom", 1), "both": (True, 2, "API error: boom", 1)}


def plain(rows):
    """Outcome of one record's (number, content, error, minute) rows."""
    by = {}
    for n, c, e, m in rows:
        n = max(n or 1, 1)
        by[n] = max(by.get(n, (-1,)), (m, c is not None, c, e), key=lambda x: x[:2])
    made = min((n for n, v in by.items() if v[1]), default=max(by))
    errors = [v[3] for n, v in sorted(by.items()) if n <= made and v[1] is False]
    return made, by[made][1], f"API error: {errors[-1]}" if errors else None


def random_log(seed, records=60):
    rng, rows = random.Random(seed), []
    for r in range(records):
        for n in range(1, rng.randint(1, 8) + 1):
            rows.append((f"r{r}", n, GOOD if rng.random() < 0.3 else None, f"e{n}", n))
    return rows + rows[::5]


def check(rows, found):
    got = {r.record_id: (r.attempts_made, r.api_success, r.error_message) for r in found.collect()}
    assert got == {r: plain([x[1:] for x in rows if x[0] == r]) for r in {x[0] for x in rows}}


def test_reduction_shuffles_once_and_joins_nothing(spark):
    rows = random_log(1)
    random.Random(2).shuffle(rows)
    found = reduce_attempts(classify_attempts(responses(spark, rows).repartition(6)))
    check(rows, found)
    read = responses(spark, rows).coalesce(1)
    plan = reduce_attempts(classify_attempts(read))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_batch_is_the_fold(spark):
    """Rows that differ under one number, null keys, and repeated rows: as the fold says."""
    rng, rows = random.Random(6), []
    for k in range(400):
        minute = rng.choice([None, 1, 2])
        rows.append((rng.choice(["a", "b", "c", None]), rng.randint(1, 9), rng.random() < 0.08, minute and T0 + dt.timedelta(minutes=minute),
                     rng.choice(["success", "failed", None]), rng.choice([None, "x", "y"]), None, rng.choice([None, "e1", "e2"]), rng.randint(0, 3)))
    table = spark.createDataFrame(rows + rows[:90], "record_id string, attempt int, stops boolean, ts timestamp, outcome string, "
                                  "prediction_label string, reasoning string, error_message string, wait_seconds int")
    folds = {}
    for record, attempt, stops, ts, *slot in rows:
        micros = ts and int(ts.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6
        folds.setdefault(record, AttemptFold()).add(attempt, Entry(stops, (micros, *slot)))
    got = {r.record_id: tuple(r)[1:] for r in reduce_attempts(table.repartition(5), ["record_id"]).collect()}
    assert got.keys() == folds.keys()
    for record, state in folds.items():
        label, why, success, made, ts, error, wait, outcome = state.outcome().values("success")
        ts = ts and dt.datetime.fromtimestamp(ts / 10**6, dt.timezone.utc).replace(tzinfo=None)
        assert got[record] == (label, why, success, made, ts, error, wait, outcome), record


def test_record_with_a_hundred_thousand_attempts(spark):
    from pyspark.sql import functions as F

    log = spark.range(1, 100_001, 1, 8).select(
        F.lit("e").alias("experiment_id"), F.lit("r").alias("record_id"), F.lit("openai").alias("provider"),
        F.col("id").cast("int").alias("attempt"), F.when(F.col("id") == 90_000, "ok").otherwise("error").alias("status"),
        F.lit("boom").alias("error_text"), F.lit(1).alias("finish_reason"), F.when(F.col("id") == 90_000, GOOD).alias("content"),
        F.lit(T0).alias("ts"))
    got = reduce_attempts(classify_attempts(log)).collect()
    assert [(r.api_success, r.attempts_made, r.wait_seconds) for r in got] == [(True, 90_000, 4)]


def deliver(spark, source, rows):
    responses(spark, rows).coalesce(1).write.mode("append").parquet(source)


def step(spark, tmp_path, **more):
    query = drain(outcome_stream(response_stream(spark, str(tmp_path / "in"), 1), **more), str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    return query


def test_stream_takes_late_and_repeated_rows(spark, tmp_path):
    rows = random_log(3, 20)
    order = rows[::-1]
    third = len(order) // 3
    for k, part in enumerate((order[:third], order[third:2 * third] + order[:5], order[2 * third:])):
        deliver(spark, str(tmp_path / "in"), part)
        if k:
            step(spark, tmp_path)
    check(rows, latest(spark, str(tmp_path / "out")))
    before = spark.read.parquet(str(tmp_path / "out")).count()
    step(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == before


def test_batch_of_a_stream_touches_its_own_records_only(spark, tmp_path):
    deliver(spark, str(tmp_path / "in"), [(f"r{k}", 1, None, "boom", 1) for k in range(300)])
    step(spark, tmp_path)
    deliver(spark, str(tmp_path / "in"), [("r7", 2, GOOD, None, 2), ("new", 1, GOOD, None, 2)])
    query = step(spark, tmp_path)
    progress = query.lastProgress
    assert progress["numInputRows"] == 2 and progress["stateOperators"][0]["numRowsUpdated"] == 2
    rows = spark.read.parquet(str(tmp_path / "out")).where("batch_id = 1").collect()
    assert {(r.record_id, r.attempts_made, r.api_success) for r in rows} == {("r7", 2, True), ("new", 1, True)}


def test_state_of_a_stream_expires(spark, tmp_path):
    deliver(spark, str(tmp_path / "in"), [("r", 1, None, "boom", 1)])
    step(spark, tmp_path, expire_after=0.5)
    time.sleep(1)
    deliver(spark, str(tmp_path / "in"), [("r", 2, GOOD, None, 2)])
    step(spark, tmp_path, expire_after=0.5)
    row = latest(spark, str(tmp_path / "out")).first()
    assert (row.attempts_made, row.error_message, row.wait_seconds) == (2, None, 0)
