"""Targets, groups and labels: recoding, bucketing and normalisation as Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import JUNIOR, SENIOR, SENIOR_MARKS
from .text import col, is_blank, python_text, ws_strip

_SEPARATORS = " _-"


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Dictionary recode; a value that is not in the dictionary becomes NULL."""
    return literal_map(mapping)[col(c).cast("string")]


def decode(c: Column | str, mapping: Mapping[str, str], dtype: T.DataType | None = None) -> Column:
    """Dictionary lookup; a value that is not in the dictionary stays as it is."""
    c = col(c)
    return F.coalesce(literal_map(mapping)[c.cast("string")], python_text(c, dtype))


def threshold_label(c: Column | str, limit: float, above: str, otherwise: str) -> Column:
    """'above' when the value is greater than the limit, also 'otherwise' for NULL."""
    return F.when(col(c) > F.lit(limit), F.lit(above)).otherwise(F.lit(otherwise))


def age_bucket(age_range: Column | str) -> Column:
    """Two age groups from a range text such as '[70-80)'."""
    text = F.coalesce(col(age_range).cast("string"), F.lit("nan"))
    senior = F.lit(False)
    for mark in SENIOR_MARKS:
        senior = senior | F.contains(text, F.lit(mark))
    return F.when(senior, F.lit(SENIOR)).otherwise(F.lit(JUNIOR))


def group_key(*parts: Column) -> Column:
    """Composite group key 'a_b'. A missing part shows as 'nan' (concat_ws would skip it)."""
    texts: list[Column] = []
    for part in parts:
        texts += [F.lit("_"), F.coalesce(part, F.lit("nan"))]
    return F.concat(*texts[1:])


def contains_any(c: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def _bare(c: Column) -> Column:
    return F.translate(c, _SEPARATORS, "")


def _class_of(label: Column, text: Column, bare: Column, positive: Column | str, negative: Column | str) -> Column:
    classes = [F.lit(c) if isinstance(c, str) else c for c in (positive, negative)]
    out = F.when(is_blank(label), F.lit(None).cast("string"))
    for c in classes:
        out = out.when(text == F.lower(c), c)
    for c in classes:
        out = out.when(bare == _bare(F.lower(c)), c)
    for c in classes:
        out = out.when(F.contains(bare, _bare(F.lower(c))), c)
    return out.otherwise(text)


def normalize_label(label: Column | str, positive: Column | str, negative: Column | str) -> Column:
    """Map a free-text label onto one of two classes.

    Tried in turn: equality, equality without separators, containment; each for
    the positive class first. Text that fits neither class stays, lower-cased.
    """
    text = F.lower(ws_strip(label))
    return _class_of(col(label), text, _bare(text), positive, negative)


def with_normalized(
    df: DataFrame, label: str, positive: Column | str, negative: Column | str, out: str = "prediction"
) -> DataFrame:
    """``normalize_label`` as a column of a table. The stripped texts are computed once
    per row, where the plain expression works them out again in each of its branches."""
    staged = df.withColumn("_text", F.lower(ws_strip(label))).withColumn("_bare", _bare(F.col("_text")))
    found = _class_of(F.col(label), F.col("_text"), F.col("_bare"), positive, negative)
    return staged.withColumn(out, found).drop("_text", "_bare")


def is_correct(success: Column | str, label: Column | str, truth: Column | str) -> Column:
    """A successful call with a non-empty label equal to the truth; never NULL."""
    return F.coalesce(col(success) & ~is_blank(label) & (col(label) == col(truth)), F.lit(False))


def is_class(c: Column | str, name: Column | str) -> Column:
    """1 for the given class, 0 for every other label."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.coalesce((col(c) == name).cast("int"), F.lit(0))
