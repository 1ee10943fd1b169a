import pytest
from conftest import collect
from pyspark.sql import functions as F

from evenhand.operators.compare import compare_cube, compare_summaries, pick_experiments
from evenhand.operators.confusion import confusion_cube, confusion_cube_wide
from evenhand.operators.distribution import (
    approximate_groups, class_distributions, group_sizes, label_counts, largest_first, prediction_summary, totals)
from evenhand.operators.fairness import gaps, group_rates, parity
from evenhand.operators.metrics import METRICS, custom_metrics, long_metrics, metric_frame
from evenhand.operators.prepare import analysis_set
from evenhand.operators.summary import group_rows, summarize
from evenhand.plans.audit import audit

HAND = [("a", "good", "good"), ("a", "good", "bad"), ("a", "bad", "bad"), ("a", "bad", "good"),
        ("b", "good", "good"), ("b", "good", "good"), ("b", "good", "bad")]


def rows(spark, data, experiment="e"):
    return spark.createDataFrame([(experiment, *r) for r in data],
                                 "experiment_id string, sensitive_feature string, ground_truth string, prediction string")


def frame_of(spark, data):
    return {(r["level"], r["sensitive_feature"]): r
            for r in metric_frame(confusion_cube(rows(spark, data))).collect()}


def gaps_of(spark, data):
    out = gaps(long_metrics(metric_frame(confusion_cube(rows(spark, data)))))
    return {r["metric"]: r for r in out.collect()}


def test_hand_computed_frame(spark):
    f = frame_of(spark, HAND)
    a, b, all_ = f["group", "a"], f["group", "b"], f["overall", None]
    assert (a.n, a.accuracy, a.precision, a.recall, a.f1_score) == (4, 0.5, 0.5, 0.5, 0.5)
    assert (b.n, b.precision, b.f1_score) == (3, 1.0, pytest.approx(0.8))
    assert b.accuracy == b.recall == pytest.approx(2 / 3)
    assert (all_.n, all_.accuracy) == (7, pytest.approx(4 / 7))
    assert (all_.precision, all_.f1_score) == (pytest.approx(0.630952, abs=1e-6), pytest.approx(0.590476, abs=1e-6))


def test_hand_computed_gaps(spark):
    g = gaps_of(spark, HAND)
    assert [round(g[m].difference, 6) for m in ("accuracy", "precision", "f1_score")] == [0.166667, 0.5, 0.3]
    assert [round(g[m].ratio, 6) for m in ("accuracy", "precision", "f1_score")] == [0.75, 0.5, 0.625]
    assert all((r.best_group, r.worst_group, r.gap) == ("b", "a", r.difference) for r in g.values())
    assert not any(r.meets_four_fifths for r in g.values())


def test_hand_computed_parity(spark):
    rates = group_rates(confusion_cube(rows(spark, HAND)), "good")
    by = {r.sensitive_feature: r for r in rates.collect()}
    assert (by["a"].selection_rate, by["a"].tpr, by["a"].fpr) == (0.5, 0.5, 0.5)
    assert by["b"].fpr == 0.0 and by["b"].negatives == 0
    p = parity(rates).first()
    assert p.binary and p.demographic_parity_difference == pytest.approx(1 / 6)
    assert p.equalized_odds_difference == 0.5


def test_group_without_positives_has_tpr_zero(spark):
    data = [("a", "bad", "good"), ("a", "bad", "bad"), ("b", "good", "good"), ("b", "bad", "bad")]
    by = {r.sensitive_feature: r for r in group_rates(confusion_cube(rows(spark, data)), "good").collect()}
    assert by["a"].tpr == 0.0 and by["b"].tpr == 1.0


def test_ties_name_the_smallest_group(spark):
    data = [(g, "x", "x") for g in ("c", "b", "a")] + [(g, "x", "y") for g in ("f", "e", "d")]
    g = gaps_of(spark, data)["accuracy"]
    assert (g.best_group, g.worst_group) == ("a", "d")
    same = gaps_of(spark, [("b", "x", "x"), ("a", "x", "x")])["accuracy"]
    assert (same.best_group, same.worst_group, same.difference, same.ratio) == ("a", "a", 0.0, 1.0)


def test_all_zero_accuracy_has_no_ratio(spark):
    g = gaps_of(spark, [("a", "x", "y"), ("b", "x", "y")])["accuracy"]
    assert g.ratio is None and g.difference == 0.0 and g.meets_four_fifths is None


def test_label_predicted_but_never_true_weighs_nothing(spark):
    f = frame_of(spark, [("a", "x", "z"), ("a", "x", "x"), ("a", "y", "z")])["overall", None]
    assert f.precision == pytest.approx(2 / 3 * 1.0) and f.recall == pytest.approx(1 / 3)
    assert f.f1_score == pytest.approx(2 / 3 * (2 * 1 / (1 + 2)))


def test_gate_needs_two_labels_and_the_positive_one(spark):
    def gate(data, positive="good"):
        return parity(group_rates(confusion_cube(rows(spark, data)), positive)).first()

    three = gate([*HAND, ("a", "other", "good")])
    one = gate([("a", "good", "good"), ("b", "good", "bad")])
    absent = gate(HAND, "unseen")
    assert [x.binary for x in (three, one, absent)] == [False] * 3
    assert three.demographic_parity_difference is None and one.equalized_odds_difference is None


def test_metrics_equal_a_plain_computation(spark):
    import random

    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice(["p", "q", "r"]), rng.choice(["p", "q", "s"])) for _ in range(400)]
    f = frame_of(spark, data)
    for key, part in (("a", [d for d in data if d[0] == "a"]), (None, data)):
        got = f["group" if key else "overall", key]
        n, labels = len(part), {t for _, t, _ in part}
        expected = dict.fromkeys(("precision", "recall", "f1_score"), 0.0)
        for label in labels:
            tp = sum(t == p == label for _, t, p in part)
            true, said = sum(t == label for _, t, _ in part), sum(p == label for _, _, p in part)
            expected["precision"] += true / n * (tp / said if said else 0)
            expected["recall"] += true / n * tp / true
            expected["f1_score"] += true / n * 2 * tp / (said + true)
        assert got.accuracy == pytest.approx(sum(t == p for _, t, p in part) / n)
        assert {k: pytest.approx(v) for k, v in expected.items()} == {k: got[k] for k in expected}


def test_invariants(spark):
    cube = confusion_cube(rows(spark, HAND))
    frame = metric_frame(cube).collect()
    assert all(r.recall == pytest.approx(r.accuracy) for r in frame)
    groups = [r for r in frame if r.level == "group"]
    overall = next(r for r in frame if r.level == "overall")
    assert sum(r.n for r in groups) == overall.n == totals(cube).first().total_samples
    assert sum(r.n * r.accuracy for r in groups) / overall.n == pytest.approx(overall.accuracy)
    assert sum(r["percentage"] for r in group_sizes(cube).collect()) == pytest.approx(100.0)


def test_distributions(spark):
    got = collect(class_distributions(confusion_cube(rows(spark, HAND))), "sensitive_feature", "kind", "label")
    b_true = [r for r in got if r["sensitive_feature"] == "b" and r["kind"] == "ground_truth"]
    assert [(r["label"], r["count"], r["percentage"]) for r in b_true] == [("good", 3, 100.0)]
    a_said = [r for r in got if r["sensitive_feature"] == "a" and r["kind"] == "predictions"]
    assert [(r["label"], r["count"], r["percentage"]) for r in a_said] == [("bad", 2, 50.0), ("good", 2, 50.0)]


def test_approximate_groups(spark):
    df = spark.range(5000).select(F.lit("e").alias("experiment_id"), (F.col("id") % 1000).cast("string").alias("sensitive_feature"))
    assert approximate_groups(df).first().num_groups == pytest.approx(1000, rel=0.08)


def test_sizes_largest_first(spark):
    data = [(g, "x", "x") for g in "bbaacd"]
    sizes = largest_first(group_sizes(confusion_cube(rows(spark, data))), "sensitive_feature")
    assert [(r.sensitive_feature, r["count"]) for r in sizes.collect()] == [("a", 2), ("b", 2), ("c", 1), ("d", 1)]


def test_stray_answers_are_one_label_and_never_right(spark):
    data = [("a", "good", f"stray {i}") for i in range(100)] + [("a", "good", "good")]
    seen = custom_metrics(confusion_cube(rows(spark, data)), {"cells": lambda t, p, w: len(t)}, ("good", "bad"))
    assert {r.value for r in seen.collect()} == {2.0}
    both = [("a", "good", "good")] * 5 + [("a", "maybe", "unsure")] * 5 + [("b", "maybe", "maybe"), ("b", "odd", "maybe")]
    right = custom_metrics(confusion_cube(rows(spark, both)), {"accuracy": lambda t, p, w: w[t == p].sum() / w.sum()}, ("good", "bad"))
    assert {r.sensitive_feature: r.value for r in right.collect()} == {"a": 0.5, "b": 0.5, None: 0.5}


def test_wide_cube_equals_row_cube(spark):
    df = spark.createDataFrame([(g, t, p, "bad") for g, t, p in HAND], "g string, t string, p string, q string")
    wide = confusion_cube_wide(df, F.col("g"), F.col("t"), {"m": F.col("p"), "always": F.col("q")})
    tall = confusion_cube(rows(spark, HAND, "m")).unionByName(
        confusion_cube(rows(spark, [(g, t, "bad") for g, t, _ in HAND], "always")))
    order = ("experiment_id", "sensitive_feature", "ground_truth", "prediction")
    assert collect(wide, *order) == collect(tall.select(wide.columns), *order)


def test_custom_function_sees_cells(spark):
    def error_rate(truth, prediction, weight):
        return weight[truth != prediction].sum() / weight.sum()

    got = custom_metrics(confusion_cube(rows(spark, HAND * 50)), {"error": error_rate}, ("good", "bad"))
    assert {r.sensitive_feature: round(r.value, 6) for r in got.collect()} == {"a": 0.5, "b": 0.333333, None: 0.428571}
    assert gaps(got).first().difference == pytest.approx(1 / 6)


PREDICTION_ROWS = [  # group, truth, prediction, success, attempts
    ("a", "good", "good", True, 1), ("a", "bad", "good", True, 2), ("None", "good", "good", True, 1),
    (None, "good", "good", True, 1), ("b", "good", None, True, 1), ("b", None, "good", True, 1),
    ("b", "good", "good", False, 5), ("b", "bad", "bad", True, 1), ("nan", "bad", "bad", True, 1)]


def predictions(spark, experiment="e", data=PREDICTION_ROWS):
    full = [(f"r{i}", t, p, g, experiment, None, s, n, "t", bool(s and p and p == t))
            for i, (g, t, p, s, n) in enumerate(data)]
    from evenhand import schemas

    return spark.createDataFrame(full, schemas.PREDICTIONS)


def experiments(spark, *ids):
    return spark.createDataFrame(
        [(i, "t0", "german_credit", f"model-{i}", f"model-{i}", "together") for i in ids],
        "experiment_id string, timestamp string, dataset_name string, model_name string, model_size string, api_provider string")


def test_analysis_mask(spark):
    kept = collect(analysis_set(predictions(spark)), "record_id")
    assert [r["record_id"] for r in kept] == ["r0", "r1", "r7", "r8"]


def test_prediction_summary(spark):
    s = prediction_summary(predictions(spark)).first()
    assert (s.total_predictions, s.successful_predictions, s.failed_predictions) == (9, 8, 1)
    assert s.accuracy == 5 / 8 and s.mean_attempts == pytest.approx(14 / 9)
    failed = prediction_summary(predictions(spark, data=[("a", "x", None, False, 5)])).first()
    assert (failed.successful_predictions, failed.accuracy) == (0, 0.0)
    counts = {(r.kind, r.label): r["count"] for r in label_counts(predictions(spark)).collect()}
    assert counts == {("prediction", "good"): 6, ("prediction", "bad"): 2,
                      ("ground_truth", "good"): 5, ("ground_truth", "bad"): 3}


def test_audit_of_several_experiments(spark):
    failed = predictions(spark, "dead", [("a", "good", None, False, 5)])
    both = predictions(spark, "e1").unionByName(predictions(spark, "e2", [(g, t, "good", True, 1) for g, t, _ in HAND]))
    result = audit(both.unionByName(failed), experiments(spark, "e1", "e2", "dead"))
    comparison = {r.experiment_id: r for r in result.comparison.collect()}
    assert set(comparison) == {"e1", "e2"} and comparison["e1"].model == "model-e1"
    assert comparison["e2"].demographic_parity_diff == 0.0
    assert [(r.experiment_id, r.error) for r in result.without_success.collect()] == [("dead", "No successful predictions")]
    assert {r.experiment_id: r.num_groups for r in result.totals.collect()} == {"e1": 3, "e2": 2}
    assert result.sizes.count() == 5 and result.prediction_summary.count() == 3
    stored = compare_summaries(result.summaries)
    assert collect(stored.select(*sorted(stored.columns)), "experiment_id") == collect(
        result.comparison.select(*sorted(stored.columns)), "experiment_id")


def test_summary_document(spark):
    cube = confusion_cube(rows(spark, HAND))
    config = experiments(spark, "e").withColumn("positive_class", F.lit("good"))
    d = summarize(cube, config).first().asDict(recursive=True)
    assert (d["total_samples"], d["num_groups"]) == (7, 2)
    assert set(d["overall_metrics"]) == set(METRICS) == set(d["group_summary"])
    assert d["group_summary"]["accuracy"]["best_group"] == "b"
    assert d["binary_metrics"]["equalized_odds_difference"] == 0.5
    by_group = {(r.section, r.metric, r.grp, r.label): (r["count"], r.value) for r in group_rows(cube).collect()}
    assert by_group["group_sizes", None, "a", None] == (4, pytest.approx(400 / 7))
    assert by_group["predictions", None, "b", "bad"][0] == 1
    assert by_group["metrics_by_group", "precision", "b", None] == (None, 1.0)
    assert sum(k[0] == "metrics_by_group" for k in by_group) == 8


def test_zero_ratio_stays_as_null_entry(spark):
    config = experiments(spark, "e").withColumn("positive_class", F.lit("x"))
    d = summarize(confusion_cube(rows(spark, [("a", "x", "y"), ("b", "z", "y")])), config).first()
    assert d.fairness_ratios["accuracy"] is None and "accuracy" in d.fairness_ratios


def test_pick_keeps_list_order_and_first_match(spark):
    table = spark.createDataFrame([("x", "t2", 1), ("x", "t1", 2), ("y", "t1", 3), ("xy", "t1", 4)],
                                  "experiment_id string, timestamp string, v int")
    got = [(r.pos, r.experiment_id, r.v) for r in pick_experiments(table, ["y", "absent", "x", "y"]).collect()]
    assert got == [(0, "y", 3), (2, "x", 2), (3, "y", 3)]


def test_comparison_has_nulls_where_parity_does_not_apply(spark):
    got = compare_cube(confusion_cube(rows(spark, [("a", "x", "x"), ("b", "x", "y")])), "x").first()
    assert got.accuracy == 0.5 and got.demographic_parity_diff is None
