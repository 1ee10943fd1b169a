import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions.describe import describe_credit, describe_row, fill_prompt, prompt_columns
from evenhand.functions.labels import (
    age_bucket, decode, group_key, is_class, is_correct, normalize_label, recode, threshold_label)
from evenhand.functions.text import (
    experiment_id, is_blank, path_safe, python_text, record_id, strip_quotes, ws_strip)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def strings(spark, items):
    return spark.createDataFrame([(x,) for x in items], "x string")


def test_strip_removes_all_python_white_space(spark):
    items = ["\t a b\n", "\xa0x　", " y\x1f", "  ", "", None, "z"]
    assert values(strings(spark, items), ws_strip("x")) == [None if i is None else i.strip() for i in items]


def test_strip_quotes_goes_by_layer(spark):
    items = [' "good" ', "'good'", "\"'good'\"", "'\"good\"'", 'go"od']
    expected = [i.strip().strip('"').strip("'") for i in items]
    assert values(strings(spark, items), strip_quotes(F.col("x"))) == expected


def test_blank_is_null_or_empty_only(spark):
    assert values(strings(spark, [None, "", " "]), is_blank("x")) == [True, True, False]


def test_text_of_missing_and_special_values(spark):
    df = spark.createDataFrame([(None, None, None), (math.nan, True, 3), (math.inf, False, -4), (-math.inf, True, 0)],
                               "d double, b boolean, i int")
    assert values(df, python_text("d", T.DoubleType())) == ["nan", "nan", "Infinity", "-Infinity"]
    assert values(df, python_text("b", T.BooleanType())) == ["nan", "True", "False", "True"]
    assert values(df, python_text("i")) == ["nan", "3", "-4", "0"]


def test_record_ids_widen(spark):
    df = spark.createDataFrame([(0,), (42,), (999999,), (12345678,)], "i long")
    assert values(df, record_id("i")) == ["rec_000000", "rec_000042", "rec_999999", "rec_12345678"]


def test_experiment_id_is_md5_prefix(spark):
    import hashlib

    got = spark.range(1).select(experiment_id(F.lit("a"), F.lit("m/1"), F.lit("t"))).first()[0]
    assert got == hashlib.md5(b"a_m/1_t").hexdigest()[:8]


def test_path_safe(spark):
    assert values(strings(spark, ["2024-01-01T10:20:30.5"]), path_safe("x")) == ["2024-01-01T10-20-30_5"]


def test_recode_leaves_null_and_decode_keeps(spark):
    df = strings(spark, ["a", "b", None])
    assert values(df, recode("x", {"a": "A"})) == ["A", None, None]
    assert values(df, decode("x", {"a": "A"})) == ["A", "b", "nan"]
    ints = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert values(ints, recode("x", {"1": "good", "2": "bad"})) == ["good", "bad", None]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(50000,), (50001,), (None,)], "x int")
    assert values(df, threshold_label("x", 50000, "high", "low")) == ["low", "high", "low"]


def test_age_bucket_matches_by_substring(spark):
    items = ["[0-10)", "[60-70)", "[70-80)", "[90-100)", "[50-60)", None]
    assert values(strings(spark, items), age_bucket("x")) == ["<65", ">=65", ">=65", ">=65", "<65", "<65"]


def test_group_key_shows_missing_part(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert values(df, group_key(F.col("x"), F.col("y"))) == ["a_b", "nan_b", "a_nan"]


def test_normalize_label_table(spark):
    cases = [
        ("good", "bad", None, None), ("good", "bad", "", None), ("good", "bad", "GOOD", "good"),
        ("good", "bad", " good ", "good"), ("good", "bad", "good credit", "good"),
        ("good", "bad", "bad, not good", "good"), ("low_risk", "high_risk", "Low Risk", "low_risk"),
        ("low_risk", "high_risk", "HIGH-RISK", "high_risk"), ("low_risk", "high_risk", "Low", "low"),
        ("readmitted", "not_readmitted", "not readmitted", "not_readmitted"),
        ("readmitted", "not_readmitted", "not readmitted early", "readmitted"),
        ("yes", "no", "unknown", "no"), (">50K", "<=50K", "> 50 k", ">50K"), (">50K", "<=50K", "<=50k", "<=50K"),
        ("good", "bad", "  ", ""),
    ]
    df = spark.createDataFrame(cases, "p string, n string, x string, e string")
    rows = df.select("e", normalize_label("x", F.col("p"), F.col("n")).alias("g"), "x").collect()
    assert [(r.x, r.g) for r in rows] == [(c[2], c[3]) for c in cases]


def test_correct_and_indicator_are_never_null(spark):
    df = spark.createDataFrame(
        [(True, "a", "a"), (True, "a", "b"), (False, "a", "a"), (True, "", ""), (True, None, "a"), (None, "a", "a"),
         (True, "a", None)], "s boolean, p string, t string")
    assert values(df, is_correct("s", "p", "t")) == [True, False, False, False, False, False, False]
    assert values(df, is_class("p", "a")) == [1, 1, 1, 0, 0, 1, 1]


def test_row_text_skips_absent_columns_and_decodes(spark):
    df = spark.createDataFrame([("A11", 12, 7.0), ("A99", None, 2.5)], "Attribute1 string, Attribute2 int, other double")
    got = values(df, describe_credit(df, ["Attribute1", "Attribute2", "gone", "other"]))
    assert got == ["Checking Account Status: checking account < 0 DM\nDuration (months): 12\nother: 7.0",
                   "Checking Account Status: A99\nDuration (months): nan\nother: 2.5"]
    assert values(df, describe_row(df, [])) == ["", ""]


def test_prompts_fill_slots_and_keep_braces(spark):
    df = spark.createDataFrame([("finance", "{record_id} {x}"), ("none", "d")], "dom string, d string")
    system, user = prompt_columns(F.col("dom"), F.lit("judge"), F.lit("P"), F.lit("N"), F.lit("rec_1"), F.col("d"))
    rows = df.select(system.alias("s"), user.alias("u")).collect()
    assert rows[0].s.startswith("You are a financial risk assessment specialist. Your job is to evaluate loan "
                                "applications and judge.")
    assert '{"prediction_label": "<category>", "reasoning": "<brief explanation>"}' in rows[0].s
    assert rows[0].s.endswith("exactly one of: P, N")
    assert "(Record ID: rec_1)" in rows[0].u and "{record_id} {x}" in rows[0].u
    assert rows[1].s is None and rows[1].u is None


def test_template_table_fill(spark):
    df = strings(spark, ["a {n} {{n}} {n}{m}", "{q}"])
    got = values(df, fill_prompt(F.col("x"), n=F.lit("{m}"), m=F.lit("2")))
    assert got == ["a {m} {n} {m}2", "{q}"]
