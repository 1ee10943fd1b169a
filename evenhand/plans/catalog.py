"""Registered queries: each operator over the warehouse's whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed_values as fv
from ..functions.describe import describe_row, prompt_columns
from ..functions.labels import age_bucket, decode, group_key, is_class, normalize_label, recode, threshold_label, with_normalized
from ..functions.responses import classify_attempts, parse_responses
from ..functions.text import record_id
from ..operators.attempts import RECORD, reduce_attempts, to_predictions
from ..operators.bloom import filter_of
from ..operators.compare import compare_cube, compare_summaries, pick_experiments
from ..operators.confusion import confusion_cube
from ..operators.distribution import (
    class_distributions, group_sizes, label_counts, largest_first, prediction_summary, totals)
from ..operators.fairness import gaps, group_rates, parity
from ..operators.metrics import METRICS, custom_metrics, long_metrics, metric_frame
from ..operators.prepare import analysis_set, conform, features_except, with_targets
from ..operators.resume import remaining, with_done
from ..operators.runs import batch_status, completed, dataset_rollup, experiment_matrix, progress, without_alias
from ..operators.sketches import estimated_groups, group_sketches, united
from ..operators.split import capped_sample, stratified_test_split
from ..operators.summary import flatten_summary, group_rows, summarize
from ..operators.user_aggregate import ThresholdCurve, aggregate, curve_rows
from ..sources import sinks
from ..sources.commits import CommitLog
from ..sources.files import read_configs, read_csv, read_predictions, read_summaries, read_survey, with_row_id, write_parts
from ..sources.partitioned import read_partitioned
from ..sources.registry import load_dataset, models_table, with_dataset
from ..staging import new_folder, stage
from ..streaming.scoring import drain, latest, outcome_stream, running_summary
from . import bindings as b
from .audit import audit
from .experiment import classify, prompts, rule_classifier

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STAMP = "2024-01-01T00:00:00"


def query(fn: Query) -> Query:
    """Registers a query by its name; a final '_' tells it from the operator it runs."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- metrics ------------------------------------------------------------------


@query
def group_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = b.labelled_docs(spark, d).select(
        F.lit("short").alias("experiment_id"), F.col("lang").alias("sensitive_feature"), "ground_truth",
        b.length_rule(800).alias("prediction"))
    frame = metric_frame(confusion_cube(rows))
    return rounded(frame, "accuracy").select("sensitive_feature", "level", "n", "accuracy")


@query
def weighted_metrics_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metric_frame(b.loan_cube(spark, d)), *METRICS)


@query
def weighted_metrics_many_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metric_frame(b.fine_cube(spark, d)), *METRICS)


@query
def fairness_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = gaps(long_metrics(metric_frame(b.loan_cube(spark, d))))
    return rounded(out, "difference", "ratio", "gap").select(
        "experiment_id", "metric", "num_groups", "difference", "ratio", "gap", "meets_four_fifths")


@query
def best_worst_group(spark: SparkSession, d: str) -> DataFrame:
    out = gaps(long_metrics(metric_frame(b.fine_cube(spark, d))))
    return rounded(out, "best_value", "worst_value").select(
        "experiment_id", "metric", "best_group", "best_value", "worst_group", "worst_value")


@query
def selection_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = group_rates(b.loan_cube(spark, d), "yes")
    return rounded(rates, "selection_rate", "tpr", "fpr").select(
        "experiment_id", "sensitive_feature", "n", "positives", "negatives", "selected",
        "true_positives", "false_positives", "selection_rate", "tpr", "fpr")


@query
def demographic_parity(spark: SparkSession, d: str) -> DataFrame:
    out = parity(group_rates(b.loan_cube(spark, d), "yes"))
    return rounded(out, "demographic_parity_difference", "demographic_parity_ratio").select(
        "experiment_id", "binary", "demographic_parity_difference", "demographic_parity_ratio")


@query
def equalized_odds(spark: SparkSession, d: str) -> DataFrame:
    out = parity(group_rates(b.fine_cube(spark, d), "good"))
    names = ("tpr_difference", "fpr_difference", "equalized_odds_difference")
    return rounded(out, *names).select("experiment_id", "binary", *names)


@query
def parity_gate(spark: SparkSession, d: str) -> DataFrame:
    """Truth with two, three and one label: only the first has parity values."""
    status = F.col("o_orderstatus")
    truths = F.inline(F.array(
        F.struct(F.lit("two").alias("experiment_id"), F.when(status == "F", "F").otherwise("O").alias("ground_truth")),
        F.struct(F.lit("three").alias("experiment_id"), status.alias("ground_truth")),
        F.struct(F.lit("one").alias("experiment_id"), F.lit("F").alias("ground_truth")),
    ))
    rows = b.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("sensitive_feature"),
        F.when(F.col("o_totalprice") >= 250000, "F").otherwise("O").alias("prediction"), truths)
    out = parity(group_rates(confusion_cube(rows), "F"))
    return rounded(out, "demographic_parity_difference", "equalized_odds_difference").select(
        "experiment_id", "binary", "demographic_parity_difference", "equalized_odds_difference")


@query
def group_sizes_(spark: SparkSession, d: str) -> DataFrame:
    return rounded(group_sizes(b.fine_cube(spark, d)), "percentage")


@query
def class_distributions_(spark: SparkSession, d: str) -> DataFrame:
    return rounded(class_distributions(b.loan_cube(spark, d)), "percentage")


@query
def custom_metric(spark: SparkSession, d: str) -> DataFrame:
    """A metric as an expression over label sums, and one as a function of the cells."""
    cube = b.loan_cube(spark, d)
    balanced = {"balanced_accuracy": F.avg(F.try_divide(F.col("tp").cast("double"), F.col("support")))}
    by_sums = long_metrics(metric_frame(cube, extra=balanced), names=list(balanced))

    def kappa(truth: pd.Series, prediction: pd.Series, weight: pd.Series) -> float:
        n = weight.sum()
        seen = weight[truth == prediction].sum() / n
        true, said = weight.groupby(truth).sum(), weight.groupby(prediction).sum()
        chance = (true * said.reindex(true.index).fillna(0)).sum() / (n * n)
        return (seen - chance) / (1 - chance)

    return rounded(by_sums.unionByName(custom_metrics(cube, {"kappa": kappa}, ("yes", "no"))), "value")


@query
def custom_metric_stray(spark: SparkSession, d: str) -> DataFrame:
    """A metric function over truths and answers that both hold labels of neither class."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    truth = F.when(flag == "R", "yes").when(flag == "A", "no").otherwise("maybe")
    said = F.when(line == 7, "unsure").when(line == 6, "maybe").when(F.col("l_quantity") <= 25, "yes").otherwise("no")
    cube = confusion_cube(b.loans(spark, d).select(
        F.lit("stray").alias("experiment_id"), F.col("c_mktsegment").alias("sensitive_feature"),
        truth.alias("ground_truth"), said.alias("prediction")))

    def agreement(true: pd.Series, answer: pd.Series, weight: pd.Series) -> float:
        return weight[true == answer].sum() / weight.sum()

    return rounded(custom_metrics(cube, {"agreement": agreement}, ("yes", "no")), "value")


# --- predictions tables -------------------------------------------------------


@query
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    """A user aggregate that is no function of the cube: length as a score of quality, by language."""
    curves = aggregate(b.labelled_docs(spark, d).select("lang", "n_chars", (F.col("quality") == 1).alias("good")), ["lang"],
                       ThresholdCurve("n_chars", "good", 0, 4000, 16))
    return rounded(curve_rows(curves, ["lang"]), "tpr", "fpr", "auc")


@query
def group_sketch_store(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of parts by return flag and day, stored; united over the days, the number of parts is within five per
    cent of the count."""
    rows, path = b.table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_partkey"), new_folder(spark, "sketches")
    group_sketches(rows, ["l_returnflag", "l_shipdate"], "l_partkey").write.mode("append").parquet(path)
    stored = estimated_groups(united(spark.read.parquet(path), ["l_returnflag"]))
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    return stored.join(exact, "l_returnflag").select(
        "l_returnflag", "parts", (F.abs(F.col("num_groups") - F.col("parts")) <= 0.05 * F.col("parts")).alias("within"))


@query
def analysis_filter(spark: SparkSession, d: str) -> DataFrame:
    return analysis_set(b.doc_predictions(spark, d)).select(
        "experiment_id", "record_id", "sensitive_feature", "ground_truth", "prediction", "correct")


@query
def prediction_summary_(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prediction_summary(b.doc_predictions(spark, d)), "accuracy", "mean_attempts")


@query
def label_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Truth and prediction as 0/1 of the positive class; a missing label is 0."""
    return b.doc_predictions(spark, d).select(
        "experiment_id", "record_id", is_class("ground_truth", "good").alias("truth"),
        is_class("prediction", "good").alias("predicted"))


@query
def prediction_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return label_counts(b.doc_predictions(spark, d))


@query
def analysis_totals(spark: SparkSession, d: str) -> DataFrame:
    return totals(confusion_cube(analysis_set(b.doc_predictions(spark, d))))


@query
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return confusion_cube(analysis_set(b.doc_predictions(spark, d)))


@query
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = compare_cube(b.loan_cube(spark, d), "yes").withColumn("timestamp", F.lit(STAMP))
    picked = pick_experiments(rows, ["taxwise", "absent", "careful"]).drop("timestamp")
    return rounded(picked, "accuracy", "accuracy_difference", "accuracy_ratio",
                   "demographic_parity_diff", "equalized_odds_diff")


def _doc_experiments(predictions: DataFrame) -> DataFrame:
    return predictions.select("experiment_id").distinct().select(
        "experiment_id", F.lit(STAMP).alias("timestamp"), F.lit("german_credit").alias("dataset_name"),
        F.col("experiment_id").alias("model_name"), F.col("experiment_id").alias("model_size"),
        F.lit("together").alias("api_provider"), F.lit("good").alias("positive_class"))


@query
def summary_document(spark: SparkSession, d: str) -> DataFrame:
    predictions = b.doc_predictions(spark, d)
    cube = stage(confusion_cube(analysis_set(predictions)), "cube")
    documents = stage(summarize(cube, _doc_experiments(predictions)), "documents")
    return rounded(flatten_summary(documents).unionByName(group_rows(cube)), "value")


@query
def summary_store(spark: SparkSession, d: str) -> DataFrame:
    """Summaries written as JSON, read back by schema, and compared."""
    predictions = b.doc_predictions(spark, d)
    path = new_folder(spark, "summaries")
    cube = stage(confusion_cube(analysis_set(predictions)), "cube")
    sinks.write_summaries(summarize(cube, _doc_experiments(predictions)), path)
    picked = pick_experiments(compare_summaries(read_summaries(spark, path)), ["long", "absent", "short"], "model")
    return rounded(picked, "accuracy", "accuracy_difference", "accuracy_ratio",
                   "demographic_parity_diff", "equalized_odds_diff")


# --- artefacts, written and read back ------------------------------------------


@query
def predictions_store(spark: SparkSession, d: str) -> DataFrame:
    """The predictions artefact; the second write replaces the first."""
    path = new_folder(spark, "predictions")
    for _ in range(2):
        sinks.write_predictions(b.doc_predictions(spark, d), path)
    return read_predictions(spark, path)


@query
def analysis_store(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "analysis")
    sinks.write_analysis(analysis_set(b.doc_predictions(spark, d)), path)
    return read_predictions(spark, path).select(
        "experiment_id", "record_id", "sensitive_feature", "ground_truth", "prediction", "correct")


@query
def label_counts_store(spark: SparkSession, d: str) -> DataFrame:
    path, counts = new_folder(spark, "label_counts"), label_counts(b.doc_predictions(spark, d))
    sinks.write_by_experiment(counts, path)
    return spark.read.schema(counts.schema).json(path).select(counts.columns)


@query
def prediction_summary_store(spark: SparkSession, d: str) -> DataFrame:
    path, summary = new_folder(spark, "prediction_summary"), prediction_summary(b.doc_predictions(spark, d))
    sinks.write_by_experiment(summary, path)
    return rounded(spark.read.schema(summary.schema).json(path).select(summary.columns), "accuracy", "mean_attempts")


@query
def group_rows_store(spark: SparkSession, d: str) -> DataFrame:
    """What a summary says by group, as stored rows."""
    path = new_folder(spark, "group_rows")
    sinks.write_by_experiment(group_rows(confusion_cube(analysis_set(b.doc_predictions(spark, d)))), path)
    names = schemas.GROUP_ROWS.fieldNames()
    return rounded(spark.read.schema(schemas.GROUP_ROWS).json(path).select(names), "value")


@query
def unanalysed_store(spark: SparkSession, d: str) -> DataFrame:
    """Experiments without a row to analyse, with the reason."""
    path, rows = new_folder(spark, "unanalysed"), b.doc_predictions(spark, d)
    failed = rows.where("experiment_id = 'short'").withColumns(
        {"experiment_id": F.lit("failed"), "api_success": F.lit(False)})
    both = rows.unionByName(failed)
    sinks.write_by_experiment(audit(both, _doc_experiments(both)).without_success, path)
    return spark.read.schema("error string, experiment_id string").json(path).select("experiment_id", "error")


@query
def comparison_store(spark: SparkSession, d: str) -> DataFrame:
    path, scores = new_folder(spark, "comparison"), (
        "accuracy", "accuracy_difference", "accuracy_ratio", "demographic_parity_diff", "equalized_odds_diff")
    rows = compare_cube(b.loan_cube(spark, d), "yes").withColumn("dataset", F.lit("loans"))
    sinks.write_comparison(rounded(rows, *scores), path)
    stored = spark.read.option("header", True).csv(path)
    return stored.select("experiment_id", "dataset", *[F.col(c).cast("double") for c in scores])


@query
def batch_summary_store(spark: SparkSession, d: str) -> DataFrame:
    """Rollup and progress of a batch under the path-safe time of the run."""
    path, rollup = new_folder(spark, "runs"), dataset_rollup(b.run_table(spark, d))
    sinks.write_batch_summary(progress(rollup), path, STAMP)
    stored = spark.read.schema(
        "current_dataset string, completed_datasets long, total_datasets long, completed_so_far long, "
        "failed_so_far long, stamp string").json(path)
    return stored


@query
def config_store(spark: SparkSession, d: str) -> DataFrame:
    """Configurations of the matrix of sources and models, written twice, a folder per dataset and experiment."""
    layout = sinks.Layout(new_folder(spark, "audits"))
    sources = b.table(spark, d, "documents").select(F.col("source").alias("dataset_name")).distinct()
    matrix = experiment_matrix(sources.withColumn("dataset_type", F.lit("finance")), STAMP)
    for _ in range(2):
        sinks.write_configs(matrix, layout.configs)
    return read_configs(spark, layout.configs).drop("model_size")


@query
def layout_store(spark: SparkSession, d: str) -> DataFrame:
    """The artefacts of two experiments below one base folder; of each kind the rows of one experiment are read back."""
    layout, rows = sinks.Layout(new_folder(spark, "audits")), b.doc_predictions(spark, d)
    sinks.write_predictions(rows, layout.predictions)
    sinks.write_analysis(analysis_set(rows), layout.analysis)
    sinks.write_by_experiment(label_counts(rows), layout.label_counts)
    sinks.write_by_experiment(prediction_summary(rows), layout.prediction_summaries)
    kinds = {"predictions": read_predictions(spark, layout.predictions), "analysis": read_predictions(spark, layout.analysis),
             "label_counts": spark.read.json(layout.label_counts), "prediction_summaries": spark.read.json(layout.prediction_summaries)}
    counts = [df.where("experiment_id = 'short'").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows")) for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def largest_groups(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest groups of a report."""
    sizes = group_sizes(b.fine_cube(spark, d)).where("experiment_id = 'short'")
    return rounded(largest_first(sizes, "sensitive_feature").limit(10), "percentage")


@query
def datasets_without_alias(spark: SparkSession, d: str) -> DataFrame:
    names = {"AUTOMOBILE": "german_credit", "BUILDING": "compas", "FURNITURE": "folktables", "HOUSEHOLD": "heritage_health"}
    rows = b.table(spark, d, "customer").select("c_custkey", recode("c_mktsegment", names).alias("dataset_name"))
    return without_alias(rows).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))


@query
def models_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the name and provider of their model."""
    keys = F.array(*[F.lit(k) for k in fv.MODELS])
    runs = b.table(spark, d, "orders").select(
        F.get(keys, (F.col("o_orderkey") % (len(fv.MODELS) + 1)).cast("int")).alias("model_key"))
    return runs.join(F.broadcast(models_table(spark)), "model_key", "left").groupBy(
        "model_key", "model_name", "api_provider").agg(F.count(F.lit(1)).alias("n"))


# --- preparation --------------------------------------------------------------


@query
def target_recode(spark: SparkSession, d: str) -> DataFrame:
    """Recode with a value left out of the dictionary, then drop what has no target."""
    target = recode("o_orderstatus", {"F": "readmitted", "O": "not_readmitted"})
    return b.table(spark, d, "orders").select(
        record_id("o_orderkey").alias("record_id"), target.alias("ground_truth")).dropna(subset=["ground_truth"])


@query
def threshold_target(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "customer").select("c_custkey", threshold_label(
        "c_acctbal", 5000, "high_income", "low_income").alias("ground_truth"))


def _age_range() -> Column:
    low = F.floor(F.col("o_totalprice") / 50000) * 10
    return F.concat(F.lit("["), low.cast("string"), F.lit("-"), (low + 10).cast("string"), F.lit(")"))


@query
def age_bucket_(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "orders").select(
        "o_orderkey", _age_range().alias("age"), age_bucket(_age_range()).alias("age_group"))


@query
def group_key_(spark: SparkSession, d: str) -> DataFrame:
    """Composite key with a missing part: it shows as 'nan'."""
    customers = b.table(spark, d, "customer")
    nations = b.table(spark, d, "nation")
    part = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", group_key(F.col("n_name"), part).alias("sensitive_feature"))


@query
def code_decode(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"ECONOMY": "low budget", "PROMO": "special offer", "SMALL": "small size"}
    brands = {f"Brand#{i}": f"house brand {i}" for i in range(1, 13)}
    return b.table(spark, d, "part").select(
        "p_partkey", decode("p_type", kinds).alias("kind"), decode("p_brand", brands).alias("brand"))


@query
def row_description(spark: SparkSession, d: str) -> DataFrame:
    parts = b.table(spark, d, "part")
    features = [*features_except(parts, "p_partkey"), "absent"]
    text = describe_row(parts, features, {"p_type": "Kind"}, {"p_type": {"PROMO": "special offer"}})
    return parts.select(record_id("p_partkey").alias("record_id"), text.alias("data_description"))


def _dataset_of(segment: str) -> Column:
    """Segments stand for datasets; one of them is in no registry."""
    names = {"AUTOMOBILE": "german_credit", "BUILDING": "compas", "FURNITURE": "folktables",
             "HOUSEHOLD": "diabetes_readmission"}
    return F.coalesce(recode(segment, names), F.lit("unknown"))


@query
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    customers = b.table(spark, d, "customer")
    described = customers.select(
        record_id("c_custkey").alias("record_id"), _dataset_of("c_mktsegment").alias("dataset_name"),
        describe_row(customers, ["c_name", "c_nationkey", "c_acctbal"]).alias("data_description"))
    system, user = prompt_columns(*[F.col(c) for c in (
        "dataset_type", "task_description", "positive_class", "negative_class", "record_id", "data_description")])
    return with_dataset(described).select(
        "record_id", system.alias("system_prompt"), user.alias("user_prompt"))


@query
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = with_dataset(b.table(spark, d, "customer").select(_dataset_of("c_mktsegment").alias("dataset_name")))
    return rows.groupBy("dataset_name", "name", "dataset_type", "positive_class", "negative_class").agg(
        F.count(F.lit(1)).alias("n"))


@query
def feature_target_join(spark: SparkSession, d: str) -> DataFrame:
    """Features and targets by key; a part that no line sells has no target."""
    features = b.table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name", "p_size")
    targets = b.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_id")).agg(
        F.max("l_quantity").alias("target"))
    return with_targets(features, targets)


@query
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    samples = b.table(spark, d, "orders").select(
        record_id("o_orderkey").alias("record_id"),
        F.when(F.col("o_orderstatus") == "F", "readmitted").otherwise("not_readmitted").alias("ground_truth"))
    return stratified_test_split(samples, classes=("readmitted", "not_readmitted"))


@query
def stratified_split_open(spark: SparkSession, d: str) -> DataFrame:
    """Strata that are not known beforehand."""
    samples = b.table(spark, d, "part").select(
        record_id("p_partkey").alias("record_id"), F.col("p_brand").alias("ground_truth"))
    return stratified_test_split(samples, test_size=0.15, seed=7, levels=2)


@query
def stratified_split_many(spark: SparkSession, d: str) -> DataFrame:
    """Half as many strata as there are orders: most hold two rows, one holds a third of all."""
    pair = F.expr("o_orderkey div 2")
    samples = b.table(spark, d, "orders").select(
        record_id("o_orderkey").alias("record_id"),
        F.when(pair % 3 == 0, "frequent").otherwise(pair.cast("string")).alias("ground_truth"))
    return stratified_test_split(samples)


@query
def capped_sample_(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "orders").select(record_id("o_orderkey").alias("record_id"), "o_totalprice")
    return capped_sample(rows)


# --- answers ------------------------------------------------------------------


@query
def parse_response(spark: SparkSession, d: str) -> DataFrame:
    return parse_responses(b.doc_responses(spark, d)).select(
        "doc_id", "provider", "outcome", "prediction_label", "reasoning", "error_message")


@query
def classify_error(spark: SparkSession, d: str) -> DataFrame:
    return classify_attempts(b.event_attempts(spark, d)).select(
        *RECORD, "attempt", "outcome", "error_message", "stops", "wait_seconds")


@query
def reduce_event_attempts(spark: SparkSession, d: str) -> DataFrame:
    return reduce_attempts(classify_attempts(b.event_attempts(spark, d)))


@query
def reduce_attempts_(spark: SparkSession, d: str) -> DataFrame:
    return reduce_attempts(classify_attempts(b.turns_as_attempts(b.table(spark, d, "conversations"))))


@query
def backoff_budget(spark: SparkSession, d: str) -> DataFrame:
    outcomes = reduce_attempts(classify_attempts(b.event_attempts(spark, d)))
    return outcomes.groupBy("experiment_id", "outcome").agg(
        F.count(F.lit(1)).alias("records"), F.sum("attempts_made").alias("attempts"),
        F.sum("wait_seconds").alias("wait_seconds"))


@query
def normalize_label_(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return with_normalized(orders, "o_orderpriority", "Urgent", "not_specified").drop("o_orderpriority")


@query
def normalize_part_names(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(
        "p_partkey", normalize_label("p_name", "Red_Widget", "BOLT").alias("prediction"),
        normalize_label("p_brand", "brand#1", "brand#2").alias("brand"))


@query
def answered_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples with their answers: a document nobody answered is a failed row."""
    samples = b.table(spark, d, "documents").select(
        record_id("doc_id").alias("record_id"), F.col("lang").alias("sensitive_feature"),
        F.when(F.col("n_chars") >= 800, "good").otherwise("bad").alias("ground_truth"))
    outcomes = reduce_attempts(
        classify_attempts(b.turns_as_attempts(b.table(spark, d, "conversations"))), ("record_id",))
    return to_predictions(samples, outcomes, "good", "bad").select(
        "record_id", "ground_truth", "sensitive_feature", "prediction", "api_success", "attempts_made", "correct")


@query
def pluggable_scorer(spark: SparkSession, d: str) -> DataFrame:
    """A user's classifier over rendered prompts."""
    from ..sources.loaders import FOLKTABLES

    customers = b.table(spark, d, "customer")
    described = customers.select(
        record_id("c_custkey").alias("record_id"),
        describe_row(customers, ["c_mktsegment", "c_nationkey"]).alias("data_description"))
    rule = rule_classifier(lambda prompt: "high_income" if "BUILDING" in prompt or "_1" in prompt else "low_income")
    return classify(prompts(described, FOLKTABLES), rule, "scored", STAMP).select(
        "record_id", "experiment_id", "prediction_label", "api_success", "attempts_made")


# --- resume and runs ----------------------------------------------------------


@query
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents still without a label; those that a Bloom filter of the labels does not know are not joined."""
    docs, labels = b.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), b.table(spark, d, "labels")
    return remaining(docs, labels, ["doc_id"], filter_of(labels, ["doc_id"]))


def _todo(spark: SparkSession, d: str) -> DataFrame:
    new = b.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    return remaining(new, b.table(spark, d, "labels"), ["doc_id"]).select(
        record_id("doc_id").alias("record_id"), F.col("lang").alias("sensitive_feature"),
        b.length_rule(800).alias("prediction_label"), F.lit("short").alias("experiment_id"),
        F.lit(True).alias("api_success"), F.lit(1).alias("attempts_made"))


@query
def resume_union(spark: SparkSession, d: str) -> DataFrame:
    """Checkpointed and new rows on one schema, though their columns differ."""
    return with_done(b.doc_predictions(spark, d), _todo(spark, d))


def _per_experiment(rows: DataFrame) -> DataFrame:
    return rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("rows"))


@query
def checkpoint_store(spark: SparkSession, d: str) -> DataFrame:
    """Commits rows of two experiments to a checkpoint, a part of them twice, resumes, and reads it; then nothing is
    left to do."""
    log = CommitLog(spark, new_folder(spark, "checkpoint"))
    for name in b.THRESHOLDS:
        run = log.begin(name)
        mine = conform(b.doc_predictions(spark, d).where(F.col("experiment_id") == name))
        for _ in range(2):
            run.add(mine, "labelled")
    again = log.begin("short")
    todo = remaining(_todo(spark, d), again.done(schemas.PREDICTIONS))
    again.add(conform(todo, rename={"prediction_label": "prediction"}))
    after = log.read(schemas.PREDICTIONS)
    left = remaining(b.table(spark, d, "documents").select(record_id("doc_id").alias("record_id")), after)
    return _per_experiment(after).unionByName(left.agg(F.lit("left").alias("experiment_id"), F.count(F.lit(1)).alias("rows")))


@query
def checkpoint_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Scores all documents in parts, breaks off a second scoring, then scores all anew: rows by state of
    the checkpoint and prediction."""
    log = CommitLog(spark, new_folder(spark, "replaced"))
    docs = b.table(spark, d, "documents").select(
        record_id("doc_id").alias("record_id"), "n_chars", F.lit("short").alias("experiment_id"), (F.col("doc_id") % 3).alias("part"))

    def scored(limit: int, name: str, parts: Sequence[int], finish: bool) -> DataFrame:
        run = log.begin("short", resume=False)
        for part in parts:
            run.add(conform(docs.where(F.col("part") == part).withColumn("prediction", b.length_rule(limit))), str(part))
        if finish:
            run.finish()
        return log.read(schemas.PREDICTIONS).groupBy(F.lit(name).alias("state"), "prediction").agg(F.count(F.lit(1)).alias("rows"))

    first = scored(800, "first", (0, 1, 2), True)
    return first.unionByName(scored(1500, "broken off", (0, 2), False)).unionByName(scored(1500, "anew", (0, 1, 1, 2), True))


@query
def experiment_matrix_(spark: SparkSession, d: str) -> DataFrame:
    """The default models over the sources of the documents, with their test sizes."""
    sources = b.table(spark, d, "documents").groupBy(F.col("source").alias("dataset_name")).agg(
        F.count(F.lit(1)).alias("samples"))
    matrix = experiment_matrix(sources.withColumn("dataset_type", F.lit("finance")), STAMP)
    return matrix.drop("model_size").withColumn(
        "test_rows", F.ceil(F.col("samples") * F.col("test_size")).cast("long"))


@query
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    rollup = dataset_rollup(b.run_table(spark, d))
    return rollup.select(
        "dataset", "completed_models", "failed_models", F.array_join("experiment_ids", ",").alias("experiment_ids"),
        F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["model"], r["status"])), ",").alias("results"),
        "comparable")


@query
def completed_runs(spark: SparkSession, d: str) -> DataFrame:
    return completed(b.run_table(spark, d))


@query
def run_status(spark: SparkSession, d: str) -> DataFrame:
    return rounded(batch_status(b.run_table(spark, d)), "success_rate")


@query
def progress_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return progress(dataset_rollup(b.run_table(spark, d)))


# --- streams ------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = b.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query
def incremental_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of conversations as a stream with state; run twice, same outcomes."""
    out, checkpoint = new_folder(spark, "outcomes"), new_folder(spark, "outcomes-progress")
    for _ in range(2):
        drain(outcome_stream(b.turns_as_attempts(_stream(spark, d, "conversations"))), out, checkpoint).awaitTermination()
    return latest(spark, out)


@query
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    """The prediction summary as a stream over order lines."""
    limits = F.inline(F.array(*[
        F.struct(F.lit(name).alias("experiment_id"), F.lit(limit).alias("limit")) for name, limit in
        {"low": 10.0, "high": 40.0}.items()]))
    rows = _stream(spark, d, "lineitem").select("*", limits).select(
        "experiment_id", (F.col("l_linestatus") == "F").alias("api_success"),
        ((F.col("l_linestatus") == "F") & (F.col("l_quantity") >= F.col("limit"))).alias("correct"),
        F.col("l_linenumber").alias("attempts_made"))
    out, checkpoint = new_folder(spark, "totals"), new_folder(spark, "totals-progress")
    drain(running_summary(rows), out, checkpoint, "complete").awaitTermination()
    return rounded(latest(spark, out, ["experiment_id"]), "accuracy", "mean_attempts")


# --- sources ------------------------------------------------------------------


@query
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with quotes and line breaks, through a CSV file and back."""
    path = new_folder(spark, "csv")
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "text")
    sinks.export_csv(docs, path)
    return read_csv(spark, path, docs.schema, multi_line=True).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query
def partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """Year and state partitions; only the asked ones are read."""
    path = new_folder(spark, "survey")
    orders = b.table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("state"))
    orders.repartition("year", "state", F.expr("o_orderkey div 1000000")).write.partitionBy(
        "year", "state").mode("append").parquet(path)
    return read_survey(spark, path, 1997, ("F", "P"))


@query
def dense_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in file order for a table whose key is not used."""
    rows = with_row_id(b.table(spark, d, "customer"))
    return rows.select(record_id("row_id").alias("record_id"), "c_name")


# --- loaders, each over its layout built from the warehouse ---------------------


def _loaded(spark: SparkSession, name: str, path: str) -> DataFrame:
    return load_dataset(spark, name, path).described()


def _write_parts(features: DataFrame, targets: DataFrame, spark: SparkSession) -> str:
    path = new_folder(spark, "parts")
    features.write.parquet(f"{path}/features")
    targets.write.parquet(f"{path}/targets")
    return path


@query
def load_credit(spark: SparkSession, d: str) -> DataFrame:
    parts = b.table(spark, d, "part")
    size = F.col("p_size")
    features = parts.select(
        F.col("p_partkey").alias("row_id"),
        F.when(size < 20, "A11").when(size < 40, "A12").otherwise("A19").alias("Attribute1"),
        size.alias("Attribute2"),
        F.when(F.col("p_type") == "PROMO", "A40").otherwise("A410").alias("Attribute4"),
        F.concat(F.lit(" "), F.col("p_type"), F.lit("\t")).alias("Attribute9"))
    targets = parts.select(F.col("p_partkey").alias("row_id"),
                           F.when(F.col("p_retailprice") > 1000, 1).otherwise(2).alias("class"))
    path = new_folder(spark, "parts")
    write_parts(features, targets, path, 8)
    return _loaded(spark, "german_credit", path)


@query
def load_adult(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "adult")
    nations = b.table(spark, d, "nation")
    rows = b.table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("workclass"), F.col("c_nationkey").alias("age"),
        F.when(F.col("c_acctbal") > 0, F.col("n_name")).alias("race"),
        F.when(F.col("c_acctbal") > 5000, "Male").otherwise("Female").alias("sex"),
        F.when(F.col("c_acctbal") > 4000, " >50K.").otherwise("<=50K ").alias("income"),
        F.when(F.col("c_acctbal") > 9000, "test").otherwise("train").alias("split"))
    rows.write.mode("append").partitionBy("split").parquet(path)
    return _loaded(spark, "adult_income", path)


@query
def load_compas(spark: SparkSession, d: str) -> DataFrame:
    """From a CSV file without a key: rows are numbered in file order."""
    path = new_folder(spark, "compas")
    late = F.to_date("o_orderdate") >= F.lit("1998-01-01").cast("date")
    b.table(spark, d, "orders").select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "African-American").when(F.col("o_orderstatus") == "O", "Caucasian")
        .otherwise("Other").alias("race"),
        F.when(F.col("o_totalprice") > 200000, "Male").otherwise("Female").alias("sex"),
        F.year("o_orderdate").alias("age"), F.col("o_custkey").alias("priors_count"),
        F.col("o_orderpriority").alias("c_charge_degree"), late.cast("int").alias("two_year_recid"),
    ).orderBy("o_orderkey").write.mode("append").option("header", True).csv(path)
    return _loaded(spark, "compas", path)


@query
def load_bank(spark: SparkSession, d: str) -> DataFrame:
    docs = b.labelled_docs(spark, d)
    features = docs.select(
        F.col("doc_id").alias("row_id"), F.expr("n_chars div 500").alias("age"), F.col("lang").alias("job"),
        F.col("source").alias("marital"), F.col("n_chars").alias("balance"))
    targets = docs.select(F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, " yes").otherwise("no").alias("y"))
    return _loaded(spark, "bank_marketing", _write_parts(features, targets, spark))


@query
def load_bank_three_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label that is neither class is a stratum like the others."""
    docs = b.labelled_docs(spark, d)
    features = docs.select(
        F.col("doc_id").alias("row_id"), F.expr("n_chars div 500").alias("age"), F.col("lang").alias("job"),
        F.col("source").alias("marital"), F.col("n_chars").alias("balance"))
    label = F.when(F.col("toxic") == 1, "unknown").when(F.col("quality") == 1, "yes").otherwise("no")
    targets = docs.select(F.col("doc_id").alias("row_id"), label.alias("y"))
    return _loaded(spark, "bank_marketing", _write_parts(features, targets, spark))


@query
def load_folktables(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "acs")
    b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("double").alias("AGEP"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(2.0).alias("SEX"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("RAC1P"),
        (F.col("o_totalprice") / 4).alias("PINCP"), F.lit(2018).alias("year"),
        F.when(F.col("o_totalprice") > 480000, "NV").otherwise("CA").alias("state"),
    ).write.mode("append").partitionBy("year", "state").parquet(path)
    return _loaded(spark, "folktables", path)


@query
def survey_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one year and two states by the data source: the conditions choose folders."""
    path = new_folder(spark, "source")
    b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("PINCP"), "o_orderpriority", F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "F", "CA").when(F.col("o_orderstatus") == "O", "NV").alias("state"),
    ).write.mode("append").partitionBy("year", "state").parquet(path)
    rows = read_partitioned(spark, path, "year int, state string", ["row_id", "PINCP"])
    return rows.where((F.col("year") == 1996) & F.col("state").isin("CA", "NV") & (F.col("PINCP") > 1000)).select(
        "row_id", F.round("PINCP", 2).alias("PINCP"), "year", "state")


@query
def load_diabetes(spark: SparkSession, d: str) -> DataFrame:
    orders = b.table(spark, d, "orders")
    features = orders.select(
        F.col("o_orderkey").alias("row_id"), _age_range().alias("age"), F.col("o_orderpriority").alias("race"),
        F.col("o_custkey").alias("num_medications"), F.year("o_orderdate").alias("time_in_hospital"))
    outcome = recode("o_orderstatus", {"F": "<30", "O": " NO", "P": ">30"})
    targets = orders.select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_totalprice") > 10000, outcome).alias("readmitted"))
    return _loaded(spark, "heritage_health", _write_parts(features, targets, spark))


