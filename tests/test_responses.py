import datetime as dt
import json
import re

import pytest
from conftest import collect
from pyspark.sql import functions as F

from evenhand.functions.fixed_values import MISSHAPEN
from evenhand import schemas
from evenhand.functions.responses import classify_attempts, parse_responses, strict_json
from evenhand.operators.attempts import reduce_attempts, to_predictions

GOOD = '{"prediction_label": "good", "reasoning": "r1"}'
CASES = [  # content, outcome and label for two dialects, for the third
    (GOOD, "good", "good"),
    ('{"prediction_label": " Good ", "reasoning": "r"}', "good", "good"),
    ("```json\n" + GOOD + "\n```", "json_error", "good"),
    ('{"prediction_label": "bad", "reas', "json_error", "bad"),
    ("prediction_label: good, reasoning: because", "good", "good"),
    ('{"prediction_label": ""}', "empty", "empty"),
    ('{"prediction_label": 1}', "api_error", "api_error"),
    ('{"prediction_label": null}', "api_error", "api_error"),
    ("[1]", "api_error", "api_error"),
    ('{"label": "good"}', "empty", "empty"),
    (GOOD + " trailing", "json_error", "good"),
    ("no idea", "json_error", "json_error"),
    (GOOD + GOOD, "json_error", "good"),
    (GOOD + ", " + GOOD, "json_error", "good"),
    ('{"prediction_label": "a", "prediction_label": "b"}', "b", "b"),
    ('{"prediction_label": "a", "score": NaN}', "a", "a"),
    ("{'prediction_label': 'a'}", "json_error", "json_error"),
    ("```json\n{broken}\n``` prediction_label: good", "good", "json_error"),
    ('PREDICTION_LABEL: "good"\nmore', "good", "good"),
    (None, "api_error", "api_error"),
    ("", "json_error", "json_error"),
    ('"text"', "api_error", "api_error"),
    ('  {"prediction_label": "ok"}\n', "ok", "ok"),
]


@pytest.mark.parametrize("provider", ["together", "openai", "gemini"])
def test_response_table(spark, provider):
    df = spark.createDataFrame([(i, c[0], provider) for i, c in enumerate(CASES)], "i int, content string, provider string")
    rows = collect(parse_responses(df).withColumn("i", F.format_string("%03d", "i")), "i")
    got = [r["prediction_label"] or r["outcome"] for r in rows]
    # the plain pattern of two dialects finds no label where a quote follows the key
    assert got == [c[2 if provider == "gemini" else 1] for c in CASES]
    assert all((r["error_message"] is None) == (r["outcome"] == "success") for r in rows)


def test_strict_json_agrees_with_python(spark):
    texts = [c[0] for c in CASES if c[0] is not None] + ["1", "null", "true", "{}", "[]", "[1]]", "1 2", '{"a": [1, {"b": 2}]}',
             '{"a": "x\\u0003end"}', '{"a":1}], [{"b":2}', "\t[1]\r\n", "{\"a\": \"tab\there\"}"]

    def valid(text):
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            return False
        return not (len(re.findall('"prediction_label"', text)) > 1 and isinstance(value, dict)) and "NaN" not in text

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strict_json("t").isNotNull()).collect()]
    assert got == [valid(t) for t in texts]


def test_reasoning_defaults_and_length(spark):
    long = "x" * 300
    cases = [
        (json.dumps({"prediction_label": "a", "reasoning": long}), long),
        ('{"prediction_label": "a"}', "No reasoning provided"),
        ('{"prediction_label": "a", "reasoning": null}', None),
        ("prediction_label: a", "No reasoning"),
        ("prediction_label: a, reasoning: " + long, long),
        ("prediction_label: a\nreasoning: two\nlines", "two\nlines"),
    ]
    df = spark.createDataFrame([(i, c[0], "openai") for i, c in enumerate(cases)], "i int, content string, provider string")
    assert [r["reasoning"] for r in collect(parse_responses(df), "i")] == [c[1] for c in cases]
    quoted = spark.createDataFrame([("prediction_label: a\nreasoning: two\nlines", "gemini")], "content string, provider string")
    assert parse_responses(quoted).first()["reasoning"] == "two"


def test_error_messages(spark):
    cases = [
        *[(text, MISSHAPEN) for text in (
            '{"prediction_label": 1}', '{"prediction_label": null}', '{"prediction_label": [1]}', '{"prediction_label": 1.5}',
            '{"prediction_label": {"a": 1}}', "[1]", "12", "null", '"text"', None)],
        ('{"b": 1, "a": 2}', "Empty prediction (keys: ['b', 'a'])"),
        ("nothing", "JSON decode error: Could not parse response"),
    ]
    df = spark.createDataFrame([(100 + i, c[0], "openai") for i, c in enumerate(cases)], "i int, content string, provider string")
    assert [r["error_message"] for r in collect(parse_responses(df), "i")] == [c[1] for c in cases]


T0 = dt.datetime(2024, 1, 1)


def attempts(spark, rows):
    """rows: (record, provider, attempt, status, error, finish, content)"""
    data = [("e", r, p, a, s, x, f, c, T0 + dt.timedelta(minutes=a)) for r, p, a, s, x, f, c in rows]
    return spark.createDataFrame(data, schemas.RESPONSES)


def test_errors_by_provider(spark):
    texts = ["HTTP 503", "code 429", "Server OVERLOAD", "Resource has been exhausted", "bad finish_reason",
             "Safety first", "was Blocked", "Rate_Limit hit", "boom"]
    expected = {
        "together": ["overloaded"] * 3 + ["api_error"] * 6,
        "gemini": ["api_error", "rate_limited", "api_error", "rate_limited", "blocked", "blocked", "blocked",
                   "api_error", "api_error"],
        "openai": ["api_error", "rate_limited", "api_error", "api_error", "api_error", "api_error", "api_error",
                   "rate_limited", "api_error"],
    }
    for provider, outcome in expected.items():
        df = attempts(spark, [(f"r{i}", provider, 1, "error", t, None, None) for i, t in enumerate(texts)])
        assert [r["outcome"] for r in collect(classify_attempts(df), "record_id")] == outcome, provider


def test_response_level_blocks_hold_for_one_dialect(spark):
    rows = []
    for provider in ("gemini", "openai"):
        rows += [(f"{provider}0", provider, 1, "no_candidates", None, None, None),
                 (f"{provider}1", provider, 1, "ok", None, 3, GOOD), (f"{provider}2", provider, 1, "ok", None, 2, GOOD),
                 (f"{provider}3", provider, 1, "ok", "gone", 1, None), (f"{provider}4", provider, 1, "ok", None, 1, GOOD)]
    got = collect(classify_attempts(attempts(spark, rows)), "record_id")
    assert [r["outcome"] for r in got] == ["blocked"] * 4 + ["success"] + [
        "api_error", "success", "success", "api_error", "success"]
    assert [r["error_message"] for r in got[:4]] == [
        "Response blocked by safety filters (no candidates)", "Response blocked by safety filters (finish_reason=SAFETY)",
        "Response blocked (finish_reason=2, likely safety)", "No valid response parts: gone"]
    assert all(r["stops"] for r in got[:4])


def test_reduction_stops_at_first_success(spark):
    rows = [("a", "openai", 1, "error", "code 429", None, None), ("a", "openai", 2, "ok", None, 1, "no idea"),
            ("a", "openai", 3, "ok", None, 1, GOOD), ("a", "openai", 4, "error", "late", None, None),
            ("b", "gemini", 1, "error", "blocked", None, None), ("b", "gemini", 2, "ok", None, 1, GOOD),
            *[("c", "together", k, "error", "overload", None, None) for k in range(1, 9)],
            ("d", "openai", 1, "ok", None, 1, '{"prediction_label": ""}')]
    got = {r["record_id"]: r for r in collect(reduce_attempts(classify_attempts(attempts(spark, rows))), "record_id")}
    a, b, c, d = got["a"], got["b"], got["c"], got["d"]
    assert (a["prediction_label"], a["reasoning"], a["api_success"], a["attempts_made"]) == ("good", "r1", True, 3)
    assert a["error_message"].startswith("JSON decode error") and a["ts"] == T0 + dt.timedelta(minutes=3)
    assert a["wait_seconds"] == 2 + 1
    assert (b["api_success"], b["attempts_made"], b["error_message"]) == (False, 1, "Content blocked by safety filters")
    assert (c["api_success"], c["attempts_made"], c["wait_seconds"]) == (False, 8, 2 + 4 + 8 + 16)
    assert c["error_message"] == "API overloaded (attempt 8/5)"
    assert (d["api_success"], d["outcome"], d["wait_seconds"]) == (False, "empty", 0)


def test_reduction_equals_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    rows = []
    for r in range(60):
        provider = rng.choice(["together", "gemini", "openai"])
        for k in range(1, rng.randint(1, 9) + 1):
            kind = rng.randrange(5)
            rows.append((f"r{r:02d}", provider, k, *[
                ("error", "code 429", None, None), ("error", "blocked now", None, None), ("ok", None, 1, GOOD),
                ("ok", None, 1, "no idea"), ("ok", None, 1, "{}")][kind]))
    tried = classify_attempts(attempts(spark, rows))
    by_record = {}
    for t in collect(tried, "record_id", "attempt"):
        by_record.setdefault(t["record_id"], []).append(t)
    for got in reduce_attempts(tried.repartition(7)).collect():
        made, error, wait, success = 0, None, 0, False
        for t in by_record[got["record_id"]]:
            made, wait = t["attempt"], wait + t["wait_seconds"]
            error = t["error_message"] or error
            if t["stops"]:
                success = t["outcome"] == "success"
                break
        assert (got["attempts_made"], got["error_message"], got["wait_seconds"], got["api_success"]) == (
            made, error, wait, success)


def test_answer_after_hundreds_of_attempts(spark):
    rows = [("a", "openai", k, "error", "boom", None, None) for k in range(1, 301)]
    rows += [("a", "openai", 301, "ok", None, 1, GOOD), ("a", "openai", 302, "error", "late", None, None)]
    got = reduce_attempts(classify_attempts(attempts(spark, rows)).repartition(5)).collect()
    assert [(r.api_success, r.attempts_made, r.error_message, r.wait_seconds) for r in got] == [
        (True, 301, "API error: boom", 4)]


def test_duplicate_log_rows_count_once(spark):
    rows = [("a", "openai", 1, "ok", None, 1, "no idea")] * 50 + [("a", "openai", 2, "ok", None, 1, GOOD)] * 50
    got = reduce_attempts(classify_attempts(attempts(spark, rows))).collect()
    assert len(got) == 1 and got[0]["attempts_made"] == 2 and got[0]["wait_seconds"] == 1


def test_sample_without_answer_is_a_failed_row(spark):
    samples = spark.createDataFrame([("a", "good", "g"), ("z", "bad", "g")], "record_id string, ground_truth string, sensitive_feature string")
    outcomes = reduce_attempts(classify_attempts(attempts(spark, [("a", "openai", 1, "ok", None, 1, GOOD)])), ("record_id",))
    got = collect(to_predictions(samples, outcomes, "good", "bad"), "record_id")
    assert [(r["prediction"], r["api_success"], r["attempts_made"], r["correct"]) for r in got] == [
        ("good", True, 1, True), (None, False, 0, False)]
