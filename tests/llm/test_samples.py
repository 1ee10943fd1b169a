"""Bounds of the samples that are collected for learning."""

from pyspark.sql import functions as F

from evenhand.llm import language_id, quality_classifier


def test_an_id_with_many_rows_brings_no_more_than_the_bound(spark, monkeypatch):
    docs = spark.range(300).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    collected = []

    def counted(rows, fn, schema, **more):
        found = whole(rows, fn, schema, **more)
        collected.append(found.count())
        return found

    whole = quality_classifier.map_slabs
    monkeypatch.setattr(quality_classifier, "map_slabs", counted)
    assert quality_classifier.learn(docs, labels, per_label=20, may_learn=F.lit(True)) is not None
    assert collected == [40]


def test_every_language_is_learned_however_many_there_are(spark, monkeypatch):
    docs = spark.range(5000).select(
        (F.col("id") * 4).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"),
        F.concat(F.lit("l"), (F.when(F.col("id") < 2100, F.col("id") % 1050).otherwise(0)).cast("string")).alias("lang"))
    for most in (8192, 64):
        monkeypatch.setattr(language_id, "MOST_DOCUMENTS", most)
        sample = language_id.learning_sample(docs, F.lit(True))
        counts = {lang: sum(x == lang for _, x in sample) for lang in ("l0", "l7", "l1049")}
        assert len({lang for _, lang in sample}) == 1050 and max(counts.values()) == max(1, most // 1050)
    net = language_id.train([t for t, _ in sample], [lang for _, lang in sample], steps=1)
    assert len(net.languages) == 1050
    found = language_id.identify(docs.limit(20), net).select("lang_pred", "score").collect()
    assert len(found) == 20 and all(r.lang_pred in net.languages and 0 < r.score <= 1 for r in found)
