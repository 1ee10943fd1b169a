"""The fairness summary: a document per experiment, and long rows for all that goes by group.

Groups and their labels are as many as the data has, so they are rows of a table, never
entries of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .confusion import BY
from .distribution import class_distributions, group_sizes, totals
from .fairness import gaps, group_rates, parity
from .metrics import GROUP, METRICS, OVERALL, PER_GROUP, long_metrics, metric_frame

_KEY = BY[0]


def _entries(key: str, value: Column) -> Column:
    """Aggregate: one row per metric as a map, in key order. A NULL value leaves its row out."""
    rows = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(key).alias("k"), value.alias("v"))))
    return F.map_from_entries(F.array_sort(
        rows, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))


def _scores() -> Column:
    return F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])


def summarize(
    cube: DataFrame, experiments: DataFrame, positive: str | None = None,
) -> DataFrame:
    """One summary document per experiment, on ``schemas.SUMMARY``.

    ``experiments`` has the configuration columns, and ``positive_class`` unless the
    class is given. Experiments without analysed rows have no document. The cube is
    read several times: stage it first where it is costly.
    """
    config = experiments.select(
        _KEY, "timestamp", F.col("dataset_name").alias("dataset"), F.col("model_name").alias("model"),
        "model_size", "api_provider",
        (F.col("positive_class") if positive is None else F.lit(positive)).alias("_positive"))
    size = totals(cube)
    frame = metric_frame(cube)
    overall = frame.where(F.col("level") == OVERALL).select(_KEY, _scores().alias("overall_metrics"))

    gap = gaps(long_metrics(frame)).groupBy(_KEY).agg(
        _entries("metric", F.col("difference")).alias("fairness_differences"),
        # a ratio of 0 to 0 is kept as a NULL entry
        _entries("metric", F.struct("ratio")).alias("_ratios"),
        _entries("metric", F.struct("best_group", "best_value", "worst_group", "worst_value", "gap"))
        .alias("group_summary"),
    ).withColumn("fairness_ratios", F.transform_values("_ratios", lambda _, v: v["ratio"]))

    rates = group_rates(cube.join(config.select(_KEY, "_positive"), _KEY), F.col("_positive"))
    odds = parity(rates).select(_KEY, F.struct(
        "demographic_parity_difference", "equalized_odds_difference").alias("binary_metrics"))

    document = config.join(size, _KEY)
    for part in (overall, gap, odds):
        document = document.join(part, _KEY, "left")
    return document.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SUMMARY.fields])


def _row(section: str, metric: Column | None = None, group: Column | None = None, label: Column | None = None,
         count: Column | None = None, value: Column | None = None) -> list[Column]:
    text = F.lit(None).cast("string")
    return [
        F.col(_KEY), F.lit(section).alias("section"),
        *[(text if c is None else c).alias(n) for n, c in (("metric", metric), ("grp", group), ("label", label))],
        (F.lit(None) if count is None else count).cast("long").alias("count"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
    ]


def flatten_summary(documents: DataFrame) -> DataFrame:
    """A summary document as rows (experiment, section, metric, group, label, count, value)."""

    def exploded(map_column: str) -> DataFrame:
        return documents.select(_KEY, F.explode(map_column).alias("k", "v"))

    k, v = F.col("k"), F.col("v")
    out = documents.select(*_row("total_samples", count=F.col("total_samples"), value=F.col("num_groups")))
    for section in ("overall_metrics", "fairness_differences", "fairness_ratios"):
        out = out.unionByName(exploded(section).select(*_row(section, k, value=v)))
    named = exploded("group_summary")
    for which in ("best", "worst"):
        out = out.unionByName(named.select(*_row(which, k, v[f"{which}_group"], value=v[f"{which}_value"])))
    for name in ("demographic_parity_difference", "equalized_odds_difference"):
        out = out.unionByName(documents.select(*_row(
            "binary_metrics", F.lit(name), value=F.col("binary_metrics")[name])))
    return out


def group_rows(cube: DataFrame) -> DataFrame:
    """All that a summary says by group, as rows of the same form: sizes, shares of labels
    (sections ground_truth and predictions) and metrics."""
    sizes = group_sizes(cube).select(*_row(
        "group_sizes", group=F.col(GROUP), count=F.col("count"), value=F.col("percentage")))
    shares = class_distributions(cube)
    labels = shares.select(F.col("kind"), *_row(
        "", group=F.col(GROUP), label=F.col("label"), count=F.col("count"), value=F.col("percentage"))
    ).withColumn("section", F.col("kind")).drop("kind")
    per_group = long_metrics(metric_frame(cube)).where(F.col("level") == PER_GROUP)
    metrics = per_group.select(*_row("metrics_by_group", F.col("metric"), F.col(GROUP), value=F.col("value")))
    return sizes.unionByName(labels).unionByName(metrics)
