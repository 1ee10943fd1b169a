"""The commit log: crashes, repeated parts, runs at the same time, and generations."""

import pytest
from pyspark.sql import functions as F

from evenhand import schemas, staging
from evenhand.operators.resume import remaining
from evenhand.plans.batch import run_batch
from evenhand.plans.experiment import run_experiment
from evenhand.sources import commits
from evenhand.sources.commits import CommitLog
from evenhand.sources.files import read_reasons
from evenhand.sources.sinks import Layout
from test_experiment_stream import credit_files, nobody, rule

ROWS = "record_id string, prediction string"


def rows(spark, ids, prediction="a"):
    return spark.createDataFrame([(i, prediction) for i in ids], ROWS)


def content(log, **more):
    return sorted((r.record_id, r.prediction) for r in log.read(schemas.struct(record_id=schemas._S, prediction=schemas._S), **more).collect())


def test_part_counts_once_and_unfinished_folders_are_not_seen(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    run = log.begin("e")
    assert content(log) == []
    assert run.add(rows(spark, "xy"), "0") and not run.add(rows(spark, "xy"), "0")
    run._folder(rows(spark, "z"))  # a crash before its commit
    assert content(log) == [("x", "a"), ("y", "a")]
    assert log.vacuum() == 0 and log.vacuum(older_than=-10) == 1
    assert run.add(rows(spark, "z"), "1") and len(content(log)) == 3


def test_new_generation_is_seen_when_it_is_finished(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    log.begin("e").add(rows(spark, "xy"))
    log.begin("f").add(rows(spark, "q"))
    anew = log.begin("e", resume=False)
    anew.add(rows(spark, "x", "b"), "0")
    late = log.begin("e")  # resumes the old generation meanwhile
    late.add(rows(spark, "z"))
    assert content(log, experiments=["e"]) == [("x", "a"), ("y", "a"), ("z", "a")]
    anew.add(rows(spark, "y", "b"), "1")
    anew.finish()
    late.add(rows(spark, "w"), "1")
    assert content(log) == [("q", "a"), ("x", "b"), ("y", "b")]
    log.begin("e").add(rows(spark, "z", "b"))
    assert content(log, experiments=["e"]) == [("x", "b"), ("y", "b"), ("z", "b")]


def test_runs_at_the_same_time_leave_each_record_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    one, two = log.begin("e"), log.begin("e")
    assert one.add(rows(spark, "xyz", "one")) and two.add(rows(spark, "wxyv", "two"))
    one.add(rows(spark, "u", "one"), "1")
    assert content(log) == [("u", "one"), ("v", "two"), ("w", "two"), ("x", "one"), ("y", "one"), ("z", "one")]


def test_two_commits_never_share_a_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    before = log.state()
    assert log.commit(log.state(), op="add", experiment="e", generation="first", run="r", part="0", folder="data/e/a")
    assert not log.commit(before, op="add", experiment="e", generation="first", run="s", part="0", folder="data/e/b")
    assert [a["run"] for a in log.state().adds] == ["r"]
    assert all(not n.startswith(".") for n in log._names("_log") if not n.endswith(".crc"))


def test_snapshots_say_what_the_log_says(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT", 3)
    log, state = CommitLog(spark, str(tmp_path)), None
    for k in range(8):
        state = log.state()
        op = {"op": "switch"} if k == 4 else {"op": "add", "run": "r", "part": str(k % 7), "folder": f"data/e/{k}"}
        assert log.commit(state, experiment="e", generation="first" if k < 3 else "g", **op)
    assert len([n for n in log._names("_log") if n.endswith(".snapshot")]) == 2
    assert vars(log.state()) == vars(state)
    assert [a["folder"] for a in state.live()] == ["data/e/3", "data/e/5", "data/e/6", "data/e/7"]


def classifier(label, fail_at=()):
    def make():
        def call(system, user, record, attempts):
            if record in fail_at:
                raise RuntimeError("connection lost")
            return {"prediction_label": label, "api_success": True}

        return call

    return make


def test_resume_off_with_many_rounds_replaces_and_a_crash_loses_nothing(spark, tmp_path):
    path, layout = credit_files(spark, tmp_path / "in", 60), Layout(str(tmp_path / "out"))
    run = lambda make, **more: run_experiment(
        spark, "german_credit", path, "m", "s1", layout, make, rounds=5, **more)
    first = [r.record_id for r in run(classifier("good")).collect()]
    assert len(first) == len(set(first)) == 12
    with pytest.raises(Exception, match="connection lost"):
        run(classifier("bad", fail_at=first[5:7]), resume=False)
    kept = CommitLog(spark, layout.checkpoints).read(schemas.PREDICTIONS).collect()
    assert sorted(r.record_id for r in kept) == sorted(first) and {r.prediction for r in kept} == {"good"}
    again = run(classifier("bad"), resume=False).collect()
    assert sorted(r.record_id for r in again) == sorted(first) and {r.prediction for r in again} == {"bad"}
    assert run(classifier("good")).count() == 12


def test_crash_between_parts_costs_the_rest_only(spark, tmp_path):
    path, layout = credit_files(spark, tmp_path / "in", 100), Layout(str(tmp_path / "out"))
    run = lambda make: run_experiment(spark, "german_credit", path, "m", "s1", layout, make, rounds=4)
    every = [r.record_id for r in run_experiment(
        spark, "german_credit", path, "m", "s1", Layout(str(tmp_path / "other")), rule()).orderBy(F.xxhash64("record_id")).collect()]
    last = max(every, key=lambda r: int(spark.range(1).select(F.pmod(F.xxhash64(F.lit(r)), F.lit(4))).first()[0]))
    with pytest.raises(Exception, match="connection lost"):
        run(classifier("good", fail_at=[last]))
    done = CommitLog(spark, layout.checkpoints).read(schemas.PREDICTIONS).count()
    assert 0 < done < 20
    after = run(classifier("bad")).groupBy("prediction").count().collect()
    assert {r.prediction: r["count"] for r in after} == {"good": done, "bad": 20 - done}


def test_reason_goes_when_a_later_run_succeeds(spark, tmp_path):
    paths, layout = {"german_credit": credit_files(spark, tmp_path / "in", 60)}, Layout(str(tmp_path / "out"))
    batch = lambda maker, **more: run_batch(spark, paths, "s1", layout, maker, models=("LLAMA_8B",), **more)
    batch(lambda m: nobody())
    assert [r.error for r in read_reasons(spark, layout.unanalysed).collect()] == ["No successful predictions"]
    batch(lambda m: rule(), resume=False)
    assert read_reasons(spark, layout.unanalysed).count() == 0
    assert remaining(spark.read.json(layout.configs), spark.read.json(layout.summaries), ["experiment_id"]).count() == 0


def test_cluster_has_to_name_a_shared_folder(spark):
    class Elsewhere:
        """A session of a cluster that names no folder."""

        _jvm, _jsc = spark._jvm, spark._jsc
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: {
            "spark.sql.warehouse.dir": "file:/warehouse"}.get(key, default))})()

    with pytest.raises(ValueError, match="all executors share"):
        staging.work_folder(Elsewhere())
    Elsewhere.sparkContext.master = "local[8]"
    assert staging.work_folder(Elsewhere()) == "file:/warehouse/_work"
