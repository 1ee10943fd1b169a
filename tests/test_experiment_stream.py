import datetime as dt

import pytest
from conftest import collect
from pyspark.sql import functions as F

from evenhand import schemas
from evenhand.functions.responses import classify_attempts
from evenhand.operators.attempts import reduce_attempts
from evenhand.functions.fixed_values import MODELS
from evenhand.plans.audit import audit
from evenhand.plans.batch import compare_stored, reaudit, run_batch
from evenhand.plans.experiment import rule_classifier, run_experiment
from evenhand.plans import experiment
from evenhand.sources.files import read_predictions, read_summaries
from evenhand.sources.registry import load_dataset
from evenhand.sources.sinks import Layout
from evenhand.streaming.scoring import attempt_stream, drain, latest, outcomes, response_stream, running_summary

T0 = dt.datetime(2024, 1, 1)
GOOD = '{"prediction_label": "good", "reasoning": "r"}'


def credit_files(spark, path, n=200):
    ids = spark.range(n).withColumnRenamed("id", "row_id")
    ids.select("row_id", F.when(F.col("row_id") % 2 == 0, "A11").otherwise("A14").alias("Attribute1"),
               F.col("row_id").cast("int").alias("Attribute2"),
               F.concat(F.lit(" A9"), (F.col("row_id") % 3 + 1).cast("string")).alias("Attribute9")
               ).write.parquet(f"{path}/features")
    ids.select("row_id", F.when(F.col("row_id") % 10 < 7, 1).otherwise(2).alias("class")).write.parquet(f"{path}/targets")
    return str(path)


def rule():
    return rule_classifier(lambda prompt: "Good credit" if "no checking account" in prompt else "BAD")


def test_experiment_end_to_end_and_resume(spark, tmp_path):
    path, layout = credit_files(spark, tmp_path / "in"), Layout(str(tmp_path / "out"))
    run = lambda c: run_experiment(spark, "german_credit", path, "m", "s1", layout, c)
    first = collect(run(rule()), "record_id")
    assert len(first) == 40 and {r["prediction"] for r in first} == {"good", "bad"}
    for r in first:
        number = int(r["record_id"][4:])
        assert r["prediction"] == ("bad" if number % 2 == 0 else "good")
        assert r["sensitive_feature"] == f"A9{number % 3 + 1}" and r["reasoning"] == "rule"
        assert r["correct"] == (r["prediction"] == r["ground_truth"]) and r["attempts_made"] == 1

    def must_not_run():
        def call(*_):
            raise AssertionError("everything is done already")

        return call

    assert collect(run(must_not_run), "record_id") == first
    experiments = spark.createDataFrame(
        [(first[0]["experiment_id"], "t", "german_credit", "m", "m", "together")],
        "experiment_id string, timestamp string, dataset_name string, model_name string, model_size string, api_provider string")
    result = audit(run(must_not_run), experiments)
    assert result.totals.first().total_samples == 40 and result.comparison.count() == 1


def test_experiment_resumes_where_it_stopped(spark, tmp_path):
    path, layout = credit_files(spark, tmp_path / "in"), Layout(str(tmp_path / "out"))
    samples = load_dataset(spark, "german_credit", path).samples
    some = [r.record_id for r in samples.orderBy("record_id").limit(15).collect()]
    eid = __import__("hashlib").md5(b"german_credit_m_s1").hexdigest()[:8]
    responses = spark.createDataFrame(
        [(eid, r, "openai", 1, "ok", None, 1, GOOD, T0) for r in some], schemas.RESPONSES)
    out = run_experiment(spark, "german_credit", path, "m", "s1", layout, responses=responses)
    got = {r.record_id: r for r in out.collect()}
    assert len(got) == 40 and sum(r.api_success for r in got.values()) == 15
    assert all(got[r].prediction == "good" and got[r].timestamp.startswith("2024-01-01T00:00") for r in some)
    again = run_experiment(spark, "german_credit", path, "m", "s1", layout, rule())
    assert again.count() == 40 and again.where("api_success").count() == 15


def test_experiment_in_rounds(spark, tmp_path):
    path, layout = credit_files(spark, tmp_path / "in", 100), Layout(str(tmp_path / "out"))
    whole = run_experiment(spark, "german_credit", path, "m", "s1", Layout(str(tmp_path / "one")), rule())
    parts = run_experiment(spark, "german_credit", path, "m", "s1", layout, rule(), rounds=3, tasks=2)
    assert parts.count() == 20 and collect(parts, "record_id") == collect(whole, "record_id")


def test_experiment_with_responder_retries_open_records(spark, tmp_path):
    """Each record is asked until it answers or is blocked; a second run asks for nothing."""
    path, calls = credit_files(spark, tmp_path / "in", 60), tmp_path / "calls"
    calls.mkdir()

    def responder():
        def respond(system, user, record):
            seen = len(list(calls.glob(f"{record}-*")))
            (calls / f"{record}-{seen}").touch()
            number = int(record[4:])
            if number % 3 == 0 and seen < 2:
                raise RuntimeError("code 429")
            if number % 3 == 1:
                return {"content": "no idea"}
            return {"content": '{"prediction_label": "Bad", "reasoning": "r"}'}

        return respond

    layout = Layout(str(tmp_path / "out"))
    run = lambda: run_experiment(spark, "german_credit", path, "m", "s1", layout, make_responder=responder,
                                 provider="openai", tasks=2)
    got = {r.record_id: r for r in run().collect()}
    assert len(got) == 12
    for record, r in got.items():
        kind = int(record[4:]) % 3
        assert (r.api_success, r.attempts_made, r.prediction) == [
            (True, 3, "bad"), (False, 5, None), (True, 1, "bad")][kind]
        assert len(list(calls.glob(f"{record}-*"))) == r.attempts_made
    before = len(list(calls.iterdir()))
    assert run().count() == 12 and len(list(calls.iterdir())) == before


def test_batch_of_experiments(spark, tmp_path):
    """One model raises: its run fails, the others are audited and compared."""
    paths, layout = {"german_credit": credit_files(spark, tmp_path / "in", 100)}, Layout(str(tmp_path / "out"))

    def maker(model):
        def broken():
            raise RuntimeError("no such model")

        lenient = rule_classifier(lambda prompt: "good")
        return {"LLAMA_8B": rule(), "LLAMA_70B": lenient}.get(names[model], broken)

    names = {v[0]: k for k, v in MODELS.items()}
    runs = {names[r.model]: r for r in run_batch(spark, paths, "s1", layout, maker).collect()}
    assert [runs[k].status for k in ("LLAMA_8B", "LLAMA_70B", "LLAMA_405B")] == ["completed", "completed", "failed"]
    assert "no such model" in runs["LLAMA_405B"].error and runs["LLAMA_8B"].successful_predictions == 20
    assert runs["LLAMA_70B"].accuracy == 0.7
    ids = [runs["LLAMA_70B"].experiment_id, runs["LLAMA_405B"].experiment_id, runs["LLAMA_8B"].experiment_id]
    compared = compare_stored(spark, layout, ids).collect()
    assert [r.experiment_id for r in compared] == [ids[0], ids[2]] and compared[0].accuracy == 0.7
    assert compared[0].demographic_parity_diff == 0.0
    stored = spark.read.option("header", True).csv(layout.comparisons)
    assert {r.experiment_id for r in stored.collect()} == {ids[0], ids[2]}
    assert spark.read.json(f"{layout.runs}/status").first().success_rate > 66
    assert reaudit(spark, layout).totals.count() == 2
    again = {names[r.model]: r.status for r in run_batch(spark, paths, "s1", layout, lambda m: rule()).collect()}
    assert set(again.values()) == {"completed"}
    assert read_summaries(spark, layout.summaries).count() == 3
    assert read_predictions(spark, layout.predictions).count() == 60
    assert spark.read.json(layout.prediction_summaries).count() == 3
    assert spark.read.json(layout.group_rows).where("section = 'group_sizes'").count() == 9


def test_batch_loads_a_dataset_once_and_reports_what_has_no_analysis(spark, tmp_path, monkeypatch):
    paths, layout, loads = {"german_credit": credit_files(spark, tmp_path / "in", 100)}, Layout(str(tmp_path / "out")), []
    load = experiment.load_dataset
    monkeypatch.setattr(experiment, "load_dataset", lambda *a: loads.append(a[1]) or load(*a))
    runs = run_batch(spark, paths, "s1", layout, lambda m: nobody(), models=("LLAMA_8B", "LLAMA_70B"))
    assert loads == ["german_credit"]
    assert {r.status for r in runs.collect()} == {"completed"}
    reasons = spark.read.json(layout.unanalysed).collect()
    assert len(reasons) == 2 and {r.error for r in reasons} == {"No successful predictions"}


def nobody():
    def make():
        return lambda *_: {"api_success": False}

    return make


def test_run_without_resume_replaces_its_predictions(spark, tmp_path):
    path, layout = credit_files(spark, tmp_path / "in", 100), Layout(str(tmp_path / "out"))
    run = lambda c, **more: run_experiment(spark, "german_credit", path, "m", "s1", layout, c, **more)
    assert run(nobody()).where("api_success").count() == 0
    assert run(rule()).where("api_success").count() == 0
    again = run(rule(), resume=False, rounds=2)
    assert again.count() == again.where("api_success").count() == 20


def test_audit_refuses_a_damaged_file(spark, tmp_path):
    paths, layout = {"german_credit": credit_files(spark, tmp_path / "in", 60)}, Layout(str(tmp_path / "out"))
    run_batch(spark, paths, "s1", layout, lambda m: rule(), models=("LLAMA_8B",))
    damaged = next((tmp_path / "out" / "checkpoints" / "data").glob("*/*/part-*.parquet"))
    stray = damaged.parent.parent / "stray"
    stray.mkdir()
    (stray / "part-0.parquet").write_bytes(b"no commit names this file")
    assert reaudit(spark, layout).totals.count() == 1
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    damaged.write_bytes(b"PAR1 this is no table PAR1")
    with pytest.raises(Exception, match="(?i)parquet|footer|corrupt"):
        reaudit(spark, layout).totals.collect()


def response_rows():
    rows = []
    for i in range(30):
        for k in range(1, i % 6 + 2):
            last = k == i % 6 + 1
            rows.append(("e", f"r{i:02d}", ["together", "gemini", "openai"][i % 3], k, "ok" if last else "error",
                         None if last else "code 429", 1, GOOD if last else None, T0 + dt.timedelta(minutes=k)))
    return rows


def test_stream_equals_batch_and_rerun_adds_nothing(spark, tmp_path):
    """Attempts of a record come in different files, out of order."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = response_rows()
    batch = spark.createDataFrame(rows, schemas.RESPONSES)
    expected = collect(reduce_attempts(classify_attempts(batch)), "record_id")

    def deliver(part):
        spark.createDataFrame(part, schemas.RESPONSES).coalesce(1).write.mode("append").parquet(source)

    def step():
        drain(attempt_stream(response_stream(spark, source, 1)), out, progress, "append").awaitTermination()

    deliver(rows[::3])
    deliver(rows[1::3])
    step()
    deliver(rows[2::3])
    step()
    assert collect(outcomes(spark, out).select(*expected[0]), "record_id") == expected
    before = spark.read.parquet(out).count()
    step()
    assert spark.read.parquet(out).count() == before


def test_running_summary_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    flat = "experiment_id string, api_success boolean, correct boolean, attempts_made int"
    for part in ([("e", True, True, 1), ("f", False, False, 5)], [("e", True, False, 2)]):
        spark.createDataFrame(part, flat).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(flat).option("maxFilesPerTrigger", 1).parquet(source)
    drain(running_summary(stream), str(tmp_path / "o"), str(tmp_path / "c"), "complete").awaitTermination()
    got = {r.experiment_id: r for r in latest(spark, str(tmp_path / "o"), ["experiment_id"]).collect()}
    assert (got["e"].total_predictions, got["e"].accuracy, got["e"].mean_attempts) == (2, 0.5, 1.5)
    assert (got["f"].successful_predictions, got["f"].accuracy) == (0, 0.0)
