"""A corpus pipeline of the operators in evenhand.llm.

Language identification, near-deduplication, substring deduplication, benchmark decontamination
and packing, each over all that the stage before it kept. All but the last return the columns
of documents. Languages are learned from the documents that the first stage is given, and
benchmark items are read from the folder.

Null and empty texts, or texts without letters, go in the first stage, as they have no language.
An empty table gives empty results. Rows that share an id are one document in the second stage, of which rows with the same text
stay once. So do rows with a null id and the same text; they are not linked with other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.decontaminate import contamination
from evenhand.llm.frames import documents
from evenhand.llm.language_id import UNKNOWN, identify, learn
from evenhand.llm.near_dedup import near_duplicates
from evenhand.llm.packing import pack_documents
from evenhand.llm.substring_dedup import substring_dedup
from evenhand.staging import stage

OVER_CHANCE = 1.2
"""Of n languages the best has 1/n at least; texts in none of them come near that."""

NEAR_PERCENT = 80
"""Near copies share four fifths of their shingles of five words; 85 is the rule of op5 alone."""


def restored(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``rest``, but for those changed; types stay."""
    return found.select(*[
        changed.get(f.name, F.col(f"rest.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def least_score(languages: int) -> float:
    """``OVER_CHANCE`` times 1/n for n languages, but never more than for four: of two or three a clean
    short text may have little more than a half."""
    return OVER_CHANCE / max(4, languages)


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is known. Mixed documents stay; others lose nothing either."""
    net = learn(docs)
    least = least_score(len(net.languages) if net else 0)
    return restored(identify(docs, net).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates, which are linked at a
    similarity of ``NEAR_PERCENT`` hundredths."""
    dropped = near_duplicates(docs, percent=NEAR_PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return once_each(docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]), docs)


def once_each(left: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of ``left`` for each id (null is one of them) and text; of rows that differ in other
    columns the least as JSON. Only ids and texts that repeat in ``docs`` are grouped."""
    keyed = lambda df: df.select(
        F.col("doc_id").alias("own"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("print"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rest"))
    again = stage(keyed(docs).groupBy("own", "print").count().where("count > 1").select(
        F.col("own").alias("other"), F.col("print").alias("same")), "repeated")
    if not again.head(1):
        return left
    rows, matches = keyed(left), F.col("own").eqNullSafe(F.col("other")) & (F.col("print") == F.col("same"))
    once = rows.join(again, matches, "left_anti").select("rest")
    first = rows.join(again, matches, "left_semi").groupBy("own", "print").agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
    return restored(once.unionAll(first.select("rest")), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without words of repeated passages. A document without any keeps its text as it
    is; one of which nothing is left goes."""
    found = substring_dedup(docs).where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    return restored(found, docs, text=F.when(cut, F.col("kept")).otherwise(F.col("rest.text")),
                    n_chars=F.when(cut, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars")))


def uncontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in windows of benchmark items."""
    found = contamination(docs, documents(spark, folder, "benchmark"))
    return restored(found.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces with their token ids, ready to be laid into sequences of 2048."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", uncontaminated),
    ("packing", packed_sequences),
]
ORACLE_SQL = None
"""SQL can express neither a trained network nor token ids."""


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder. Between two stages the result is written and
    read again, so a lost executor repeats one stage at most."""
    docs = documents(spark, folder)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
