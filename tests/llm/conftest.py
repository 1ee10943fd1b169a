"""Small tables with every awkward case, and plain versions of what operators must find."""

import random
import re

import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Names that operators use inside.
CLASHING = ("block", "rest", "node", "words", "kept", "n", "hit", "slice", "draw", "letters", "score", "n_words", "a.b c", "x:y")


def words(text, pattern=SPACED, lower=False):
    return pattern.findall(text.translate(LOWER) if lower and text else text or "")


def awkward_rows():
    rng = random.Random(5)
    vocabulary = ["der", "the", "Über", "naïve", "x1", "it's", "日本", "a|b", "of", "and", "<b>", "ß", "General", "Public", "License"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, text, other = make(60), make(300), make(200)
    edited = text.split(" ")
    edited[150] = "changed"
    texts = [
        None, "", "   \n\t ", "a", "one two", "!!! ??? ...", "12 34 56", passage, passage, make(40) + " " + passage, passage + "\n" + make(30),
        text, text.upper(), text, " ".join(edited), other, other + " tail", make(20000), "same " * 500, make(19), make(20), make(12),
        "line one here\nline one here\n\nline two\nline one here", "no\x00nul \x85 \xa0   here", "All rights reserved. CC-BY cc by",
        "the GNU General Public License, version 3", "x" * 30000, "<|endoftext|> marks <|endoftext|>", "🙂 emoji ´´ 'quoted' we'll",
    ]
    return [(i, t) for i, t in enumerate(texts)]


def _frame(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in CLASHING]])
    full = [(i, t, None if (i or 0) % 5 == 0 else ("de", "en")[(i or 0) % 2], None, None if t is None else len(t), *["c"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, copies, passages, and columns with clashing names."""
    return _frame(spark, awkward_rows())


@pytest.fixture(scope="session")
def repeated(spark):
    """Every row twice, and rows with a null id or with the id of another text."""
    return _frame(spark, awkward_rows() * 2 + [(None, "a null id has words here"), (None, None), (7, "another text of number seven")])


@pytest.fixture(scope="session")
def empty(spark):
    return _frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def by_id(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
