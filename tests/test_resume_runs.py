import hashlib

import pytest
from conftest import collect
from pyspark.sql import functions as F

from evenhand import schemas
from evenhand.functions import fixed_values as fv
from evenhand.operators.prepare import conform, features_except, features_kept, with_targets
from evenhand.operators.resume import remaining, with_done
from evenhand.operators.runs import (
    batch_status, completed, dataset_rollup, experiment_matrix, progress, run_results, without_alias)
from evenhand.sources import sinks
from evenhand.sources.files import (
    _table_name, read_checkpoint, read_configs, read_csv, read_parts, read_predictions, read_split, read_summaries, read_survey, with_row_id,
    write_parts)
from evenhand.sources.registry import (
    DATASETS, DatasetConfig, dataset_config, datasets_table, foreign_labels, load_all, load_dataset, models_table, register,
    with_dataset)


def prediction(record, experiment="e", success=True):
    return (record, "good", "good", "g", experiment, "why, \"so\"", success, 1, "t", success)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PREDICTIONS)


def test_remaining_skips_failed_rows_too(spark):
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")
    done = table(spark, prediction("a"), prediction("b", success=False), prediction("b", success=False))
    assert [r.record_id for r in remaining(samples, done).collect()] == ["c"]


def test_union_is_on_one_schema(spark):
    new = spark.createDataFrame([("z", "bad", True)], "record_id string, prediction_label string, api_success boolean")
    both = with_done(table(spark, prediction("a")), new)
    assert both.schema.fieldNames() == schemas.PREDICTIONS.fieldNames()
    assert {r.record_id: r.prediction for r in both.collect()} == {"a": "good", "z": "bad"}


def test_conform_fills_orders_and_casts(spark):
    odd = spark.createDataFrame([(3, "x", 1)], "attempts_made long, extra string, record_id int")
    out = conform(odd)
    assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in schemas.PREDICTIONS]
    assert out.first().record_id == "1" and out.first().correct is None


def test_feature_lists(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "row_id int, b int, a int, y int")
    assert features_except(df, "y", "row_id") == ["b", "a"]
    assert features_kept(df, ["a", "gone", "b"]) == ["a", "b"]


def test_parts_join_keeps_both_sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, f string")
    right = spark.createDataFrame([(2, "y"), (3, "z")], "row_id int, t string")
    assert [tuple(r) for r in with_targets(left, right).orderBy("row_id").collect()] == [
        (1, "a", None), (2, "b", "y"), (3, None, "z")]


def test_matrix_and_defaults(spark):
    datasets = without_alias(datasets_table(spark))
    assert datasets.count() == 6 and fv.ALIAS_DATASET in DATASETS
    rows = experiment_matrix(datasets, "s1").collect()
    assert len(rows) == 18 and len({r.experiment_id for r in rows}) == 18
    one = next(r for r in rows if r.dataset_name == "compas" and "405B" in r.model_name)
    assert one.experiment_id == hashlib.md5(f"compas_{one.model_name}_s1".encode()).hexdigest()[:8]
    assert (one.temperature, one.max_tokens, one.test_size, one.random_state) == (0.0, 2000, 0.2, 42)
    assert (one.api_provider, one.dataset_type) == ("together", "criminal_justice")
    picked = experiment_matrix(datasets, "s1", ["GPT_4O"], test_size=0.5).collect()
    assert len(picked) == 6 and picked[0].api_provider == "openai" and picked[0].test_size == 0.5
    with pytest.raises(ValueError):
        experiment_matrix(datasets, "s1", ["nope"])


def test_run_rollups(spark):
    experiments = experiment_matrix(datasets_table(spark).where("dataset_name in ('compas', 'folktables')"), "s")
    ids = {(r.dataset_name, r.model_name): r.experiment_id for r in experiments.collect()}
    ran = [i for (d, m), i in ids.items() if d == "compas" or "8B" in m]
    summary = spark.createDataFrame([(i, 10, 9, 1, 0.5) for i in ran],
                                    "experiment_id string, total_predictions long, successful_predictions long, "
                                    "failed_predictions long, accuracy double")
    runs = run_results(summary, experiments, {ran[0]: "late failure"})
    assert runs.columns == schemas.RUN_RESULTS.fieldNames()
    status = batch_status(runs).first()
    assert (status.total_experiments, status.completed, status.failed) == (6, 3, 3) and status.success_rate == 50.0
    assert completed(runs).count() == 3
    rollup = {r.dataset: r for r in dataset_rollup(runs).collect()}
    assert (rollup["compas"].completed_models, rollup["compas"].comparable) == (2, True)
    assert (rollup["folktables"].failed_models, rollup["folktables"].comparable) == (2, False)
    steps = progress(dataset_rollup(runs)).orderBy("completed_datasets").collect()
    assert [(s.current_dataset, s.completed_datasets, s.total_datasets, s.completed_so_far) for s in steps] == [
        ("compas", 1, 2, 2), ("folktables", 2, 2, 3)]
    assert [r.error for r in runs.where(F.col("experiment_id") == ran[0]).collect()] == ["late failure"]


def test_sinks_round_trip(spark, tmp_path):
    layout = sinks.Layout(str(tmp_path / "out"))
    assert read_predictions(spark, layout.predictions).count() == 0
    sinks.append_checkpoint(table(spark, prediction("a"), prediction("b", "f")), layout.checkpoints)
    sinks.append_checkpoint(table(spark, prediction("c")), layout.checkpoints)
    back = read_checkpoint(spark, layout.checkpoints)
    assert back.columns == schemas.PREDICTIONS.fieldNames()
    assert collect(back, "record_id") == collect(
        table(spark, prediction("a"), prediction("b", "f"), prediction("c")), "record_id")
    scanned = back.where("experiment_id = 'f'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment_id" in scanned
    sinks.export_csv(back, f"{tmp_path}/csv")
    assert collect(read_csv(spark, f"{tmp_path}/csv", schemas.PREDICTIONS), "record_id") == collect(back, "record_id")


def test_unreadable_checkpoint_files_are_left_out(spark, tmp_path):
    path = tmp_path / "ck"
    sinks.append_checkpoint(table(spark, prediction("a")), str(path))
    (path / "experiment_id=e" / "part-broken.parquet").write_bytes(b"not a parquet file")
    assert [r.record_id for r in read_checkpoint(spark, str(path)).collect()] == ["a"]
    with pytest.raises(Exception):
        read_predictions(spark, str(path)).collect()


def test_comparison_sink_replaces_only_its_dataset(spark, tmp_path):
    def rows(dataset, value):
        return spark.createDataFrame([("e", "m", dataset, value)], "experiment_id string, model string, dataset string, accuracy double")

    path = str(tmp_path / "cmp")
    for dataset, value in (("a", 0.1), ("b", 0.2), ("a", 0.3)):
        sinks.write_comparison(rows(dataset, value), path)
    back = spark.read.option("header", True).csv(path)
    assert {r.dataset: float(r.accuracy) for r in back.collect()} == {"a": 0.3, "b": 0.2}


def test_batch_summary_and_configs(spark, tmp_path):
    layout = sinks.Layout(str(tmp_path))
    sinks.write_batch_summary(spark.createDataFrame([(1, 2)], "completed int, failed int"), layout.runs, "2024-01-01T01:02:03.4")
    assert spark.read.json(layout.runs).first().stamp == "2024-01-01T01-02-03_4"
    datasets = datasets_table(spark).select("dataset_name", "dataset_type")
    sinks.write_configs(experiment_matrix(datasets, "s"), layout.configs)
    assert read_configs(spark, layout.configs).count() == 21
    sinks.write_configs(experiment_matrix(datasets.where("dataset_name = 'compas'"), "s"), layout.configs)
    assert read_configs(spark, layout.configs).count() == 21


def test_summaries_read_by_schema(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"experiment_id": "e", "overall_metrics": {"accuracy": 0.5}, "odd": 1}\n')
    d = read_summaries(spark, str(tmp_path)).first()
    assert d.overall_metrics == {"accuracy": 0.5} and d.binary_metrics is None


def test_partition_scans_prune(spark, tmp_path):
    df = spark.range(40).select("id", (F.col("id") % 2 + 2018).cast("int").alias("year"),
                                F.element_at(F.array(F.lit("CA"), F.lit("NV")), (F.col("id") % 4 > 1).cast("int") + 1).alias("state"))
    df.write.partitionBy("year", "state").parquet(f"{tmp_path}/s")
    out = read_survey(spark, f"{tmp_path}/s")
    assert out.count() == 10 and "PartitionFilters: [isnotnull(year" in out._jdf.queryExecution().executedPlan().toString()
    df.select("id", F.when(F.col("id") < 30, "train").otherwise("test").alias("split")).write.partitionBy("split").parquet(f"{tmp_path}/h")
    assert read_split(spark, f"{tmp_path}/h").count() == 30


def test_row_ids_follow_file_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.csv").write_text("v\n" + "\n".join(f"{i}-{j}" for j in range(5)) + "\n")
    out = with_row_id(read_csv(spark, str(tmp_path), "v string")).orderBy("row_id").collect()
    assert [(r.row_id, r.v) for r in out] == [(5 * i + j, f"{i}-{j}") for i in range(3) for j in range(5)]


def test_row_ids_across_splits_of_a_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("v\n" + "\n".join(str(j) for j in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = read_csv(spark, str(tmp_path), "v int")
        assert df.rdd.getNumPartitions() > 3
        assert with_row_id(df).where("row_id <> v").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_ids_when_the_split_size_changes_after_definition(spark, tmp_path):
    (tmp_path / "big.csv").write_text("v\n" + "\n".join(str(j) for j in range(5000)) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        numbered = with_row_id(read_csv(spark, str(tmp_path), "v int"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1300")
        assert numbered.where("row_id = v").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_registry(spark, tmp_path):
    with pytest.raises(ValueError, match="Unknown dataset: nope"):
        dataset_config("nope")
    with pytest.raises(ValueError, match="Unknown dataset"):
        datasets_table(spark, ["compas", "nope"])
    assert [r.dataset_name for r in datasets_table(spark, ["heritage_health"]).collect()] == ["heritage_health"]
    assert models_table(spark).count() == len(fv.MODELS)
    named = with_dataset(spark.createDataFrame([("compas",), ("none",)], "dataset_name string"))
    assert {r.dataset_name: r.positive_class for r in named.collect()} == {"compas": "low_risk", "none": None}

    @register(DatasetConfig("toy", "Toy", "finance", ("g",), "y", "yes", "no", "judge toys"))
    def toy(session, path, seed):
        return session.range(100).select(
            F.format_string("rec_%06d", "id").alias("record_id"),
            F.when(F.col("id") < 70, "yes").otherwise("no").alias("ground_truth"),
            F.lit("g").alias("sensitive_feature"), F.col("id").alias("size"))

    try:
        assert foreign_labels(load_all(spark, "toy", "")).count() == 0
        loaded = load_dataset(spark, "toy", "")
        assert loaded.samples.groupBy("ground_truth").count().collect() and loaded.samples.count() == 20
        assert loaded.feature_columns == ("size",)
        row = loaded.described().orderBy("record_id").first()
        assert row.data_description == f"size: {int(row.record_id[4:])}"
    finally:
        DATASETS.pop("toy")


def test_two_part_reader(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "row_id").write.parquet(f"{tmp_path}/features")
    spark.range(2).select(F.col("id").alias("row_id"), F.lit("y").alias("class")).write.parquet(f"{tmp_path}/targets")
    assert with_targets(*read_parts(spark, str(tmp_path))).count() == 3


def test_bucketed_parts_join_without_a_shuffle(spark, tmp_path):
    """Also in a session whose catalog does not know the tables."""
    ids = spark.range(500).withColumnRenamed("id", "row_id")
    features, targets = ids.withColumn("x", F.col("row_id") * 2), ids.where("row_id % 5 > 0").withColumn("y", F.col("row_id") % 3)
    path = str(tmp_path / "parts")
    write_parts(features, targets, path, 4)
    want = sorted((r, 2 * r, r % 3) for r in range(500) if r % 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for session in (spark, spark.newSession()):
            session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            left, right = read_parts(session, path)
            joined = right.join(left, "row_id", "left").select("row_id", "x", "y")
            assert sorted(map(tuple, joined.collect())) == want
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            session.sql(f"DROP TABLE {_table_name(path, 'features')}")
            session.sql(f"DROP TABLE {_table_name(path, 'targets')}")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
