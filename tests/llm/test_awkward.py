"""All operators and stages: whole results on awkward rows, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from evenhand.llm import (
    decontaminate, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, substring_dedup,
    token_counts, token_files)
from evenhand.staging import new_folder

from .conftest import FOLDER


def benchmark(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet")


def labels(docs):
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 2).cast("int")).alias("quality"))


def files(spark, docs):
    folder = new_folder(spark, "ids")
    return token_files.read_token_files(folder, token_files.write_token_files(docs, folder))


OPERATORS = {
    "substring": lambda s, d: substring_dedup.substring_dedup(d),
    "language": lambda s, d: language_id.identify(d, language_id.learn(d)),
    "tokens": lambda s, d: token_counts.token_counts(d),
    "license": lambda s, d: license_scan.scan(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "packing": lambda s, d: packing.pack_documents(d),
    "quality": lambda s, d: quality_classifier.score(d, quality_classifier.learn(d, labels(d))),
    "files": files,
    "contamination": lambda s, d: decontaminate.contamination(d, benchmark(s)),
}


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, awkward, name):
    out = OPERATORS[name](spark, awkward)
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert set(ids) == {r[0] for r in awkward.select("doc_id").collect()}
    if name != "packing":
        assert len(ids) == awkward.count()
    if "rest" in out.columns:
        assert plain(out.select("rest.*").select(*[f"`{c}`" for c in awkward.columns]).collect()) == plain(awkward.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_and_null_ids(spark, repeated, name):
    out = OPERATORS[name](spark, repeated)
    if name == "packing":
        assert out.where("start = 0").count() == repeated.count()
    else:
        assert plain(out.select("doc_id").collect()) == plain(repeated.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


def test_empty_benchmark_and_labels(spark, awkward):
    none = decontaminate.contamination(awkward, benchmark(spark).limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0
    assert quality_classifier.learn(awkward, labels(awkward).limit(0)) is None
    assert {r[0] for r in quality_classifier.score(awkward, None).select("score").collect()} == {0.5}
    assert language_id.learn(awkward.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r[0] for r in language_id.identify(awkward, None).select("lang_pred").collect()} == {"und"}


@pytest.mark.parametrize("kind", ["awkward", "repeated", "empty"])
@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages(spark, request, kind, name):
    docs = request.getfixturevalue(kind)
    out = dict(pipeline.STAGES)[name](spark, docs, FOLDER)
    if name != "packing":
        assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert bool(rows) == (kind != "empty")


def test_language_stage_rejects_only_unknown(spark, awkward):
    kept = {r.doc_id for r in pipeline.known_language(spark, awkward, FOLDER).collect()}
    assert {0, 1, 2, 5, 6} & kept == set()
    assert {3, 4, 7, 11, 17, 18} <= kept


def test_pipeline_on_a_folder(spark):
    out = pipeline.run(spark, FOLDER)
    sequences = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sequences.where("n > 2048").count() == 0
    assert out.count() > 0
