"""The audit's tables built from a warehouse of generic tables.

Each function takes (spark, folder) and reads the whole tables it needs. Models
under audit are rules on a row's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import group_key, is_correct, recode
from ..functions.text import experiment_id, record_id
from ..operators.confusion import confusion_cube_wide

THRESHOLDS = {"short": 800, "long": 1500}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("yes")).otherwise(F.lit("no"))


# --- loans: one row per order line, three rules as models ---------------------

LOAN_MODELS = {
    "careful": lambda: (F.col("l_discount") >= 0.05) & (F.col("l_quantity") <= 25),
    "broad": lambda: (F.col("l_discount") >= 0.03) & (F.col("l_quantity") <= 30),
    "taxwise": lambda: F.col("l_tax") <= 0.03,
}


def loans(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the segment of their customer. The small pair joins first."""
    buyers = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "c_mktsegment")
    lines = table(spark, folder, "lineitem")
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))


def loan_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Cube of the three loan models; their predictions share one pass."""
    return confusion_cube_wide(
        loans(spark, folder), F.col("c_mktsegment"), yes_no(F.col("l_returnflag") == "R"),
        {name: yes_no(rule()) for name, rule in LOAN_MODELS.items()})


# --- documents: quality labels against a length rule --------------------------


def labelled_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, folder, "labels").join(docs, "doc_id").withColumn(
        "ground_truth", recode("quality", {"1": "good", "0": "bad"}))


def length_rule(limit: int) -> Column:
    return F.when(F.col("n_chars") >= limit, "good").otherwise("bad")


def fine_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Many small groups, language with source, under two length rules."""
    return confusion_cube_wide(
        labelled_docs(spark, folder), group_key(F.col("lang"), F.col("source")), F.col("ground_truth"),
        {name: length_rule(limit) for name, limit in THRESHOLDS.items()})


def doc_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Ten-column predictions of two models, with failures and missing values.

    A toxic text is a failed call; a very short one has no prediction; one source
    gives the group as the text 'None' and one not at all.
    """
    models = F.inline(F.array(*[
        F.struct(F.lit(name).alias("experiment_id"), F.lit(limit).alias("limit"))
        for name, limit in THRESHOLDS.items()
    ]))
    rows = labelled_docs(spark, folder).select("*", models)
    prediction = F.when(F.col("n_chars") >= F.col("limit"), "good").when(F.col("n_chars") >= 150, "bad")
    success = F.col("toxic") == 0
    return rows.select(
        record_id("doc_id").alias("record_id"), "ground_truth", prediction.alias("prediction"),
        F.when(F.col("source") == "src7", "None").when(F.col("source") != "src11", F.col("lang"))
        .alias("sensitive_feature"),
        "experiment_id", F.lit(None).cast("string").alias("reasoning"), success.alias("api_success"),
        F.least(F.lit(5), F.lit(1) + F.expr("n_chars div 1000")).cast("int").alias("attempts_made"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        is_correct(success, prediction, "ground_truth").alias("correct"),
    )


# --- raw model answers --------------------------------------------------------


def answer(label: str | Column, reasoning: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.to_json(F.struct(label.alias("prediction_label"), reasoning.alias("reasoning")))


def doc_responses(spark: SparkSession, folder: str) -> DataFrame:
    """A response per document, its whole text as reasoning; the source decides the
    shape of the answer, the language the provider."""
    text, kind = F.col("text"), F.expr("cast(substring(source, 4) as int)")
    good = answer("good", text)
    fence = F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```\nbye"))
    bad, quoted = answer("bad", text), F.to_json(F.array(text))
    reason = F.concat(F.lit(',"reasoning":'), F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"), F.lit("}"))
    shapes = [
        good, answer(" Good ", text), fence, F.left(bad, F.length(bad) - 2),
        F.concat(F.lit("prediction_label: good, reasoning: "), text),
        answer("", text), F.concat(F.lit('{"prediction_label":1'), reason), F.concat(F.lit('{"prediction_label":null'), reason),
        quoted, F.concat(F.lit('{"label":"good"'), reason), F.concat(good, F.lit(" trailing")), text,
    ]
    content = F.when(kind == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        content = content.when(kind == i, shape)
    provider = F.when(F.col("lang") == "en", "together").when(F.col("lang") == "de", "openai").otherwise("gemini")
    return table(spark, folder, "documents").select(
        "doc_id", provider.alias("provider"), content.otherwise(answer(F.col("lang"), text)).alias("content"))


def event_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Call attempts: a record is a user's day, its events in order are the attempts.

    Events are numbered within a minute of a record; what came before is a sum over at
    most 1,440 counts. So a busy record is not sorted in one task.
    """
    record, kind = ["user_id", "_day"], F.col("event_type")
    events = table(spark, folder, "events").withColumns({
        "_day": F.to_date("ts"), "_minute": (F.hour("ts") * 60 + F.minute("ts"))})
    counts = events.groupBy(*record, "_minute").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*record).orderBy("_minute")) - F.col("_n"))
    within = F.row_number().over(Window.partitionBy(*record, "_minute").orderBy("ts", "event_id"))
    ranked = events.join(before.drop("_n"), [*record, "_minute"]).withColumn(
        "attempt", (F.col("_before") + within).cast("int"))
    return ranked.select(
        F.lit("events").alias("experiment_id"),
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("record_id"),
        F.when(kind == "error", "gemini").when(F.col("value") > 50, "openai").otherwise("together").alias("provider"),
        "attempt",
        F.when(kind.isin("view", "error"), "error").otherwise("ok").alias("status"),
        F.when(kind == "view", F.concat(F.lit("HTTP 429 "), F.col("props")))
        .when(kind == "error", F.when(F.col("value") > 20, "request blocked").otherwise("internal failure"))
        .alias("error_text"),
        F.lit(1).alias("finish_reason"),
        F.when(kind == "purchase", answer("Yes", F.col("props"))).when(kind == "click", F.col("props"))
        .when(kind == "signup", F.lit('{"prediction_label": " "}')).alias("content"),
        "ts",
    )


def turns_as_attempts(turns: DataFrame) -> DataFrame:
    """Conversations as call logs: a conversation is a record, a turn an attempt.

    Works on a batch and on a stream. Assistant turns are answers, others errors.
    """
    text, said = F.col("text"), F.length("text")
    provider = F.element_at(
        F.array(F.lit("together"), F.lit("gemini"), F.lit("openai")), (F.col("conv_id") % 3 + 1).cast("int"))
    return turns.select(
        F.lit("turns").alias("experiment_id"), record_id("conv_id").alias("record_id"), provider.alias("provider"),
        (F.col("turn") + 1).cast("int").alias("attempt"),
        F.when(F.col("role") == "assistant", "ok").otherwise("error").alias("status"),
        F.when(F.col("role") == "system", "safety stop")
        .when(said > 250, "HTTP 429 Too Many Requests").when(said > 150, "server overload")
        .otherwise(F.concat(F.lit("reset: "), text)).alias("error_text"),
        F.when(said > 1400, 3).otherwise(1).alias("finish_reason"),
        F.when(F.col("role") == "assistant",
               F.when(said < 200, text)
               .when(said < 400, F.concat(F.lit("Prediction_Label: bad, reasoning: "), text))
               .otherwise(answer("GOOD", text))).alias("content"),
        F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("ts"),
    )


def run_table(spark: SparkSession, folder: str) -> DataFrame:
    """Runs out of orders: priority as dataset, status as model; a run failed if its
    mean price is high."""
    orders = table(spark, folder, "orders")
    stats = orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))
    return stats.select(
        experiment_id(F.col("dataset"), F.col("model"), F.lit("r1")).alias("experiment_id"), "dataset", "model",
        F.when(F.col("mean_price") < 251000, "completed").otherwise("failed").alias("status"), "n")
