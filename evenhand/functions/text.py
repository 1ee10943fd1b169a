"""Text helpers: Python-compatible stripping, casting and formatting as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What Python's str.strip() removes; Spark's bare trim() removes the space only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_strip(c: Column | str) -> Column:
    """Strip Unicode white space at both ends (linear, no regex)."""
    return F.trim(col(c), F.lit(WHITESPACE))


def strip_quotes(c: Column) -> Column:
    """White space, then double quotes, then single quotes."""
    return F.trim(F.trim(ws_strip(c), F.lit('"')), F.lit("'"))


def is_blank(c: Column | str) -> Column:
    """True for NULL and for the empty string (not for white space)."""
    return F.coalesce(col(c), F.lit("")) == ""


def python_text(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Text of a value; a missing value is 'nan', truth values are 'True' and 'False'.
    Numbers are shown as Spark shows them."""
    c = col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(c.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit("nan"))
    return F.coalesce(c.cast("string"), F.lit("nan"))


def record_id(row_id: Column | str) -> Column:
    """rec_000042; ids of more than six digits widen."""
    digits = col(row_id).cast("string")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.concat(F.lit("rec_"), padded)


def experiment_id(dataset: Column, model: Column, stamp: Column) -> Column:
    """First eight hex digits of md5('dataset_model_stamp')."""
    return F.left(F.md5(F.concat_ws("_", dataset, model, stamp)), F.lit(8))


def path_safe(stamp: Column | str) -> Column:
    """A timestamp text usable in a path: ':' to '-' and '.' to '_'."""
    return F.translate(col(stamp), ":.", "-_")


def fill_template(template: Column, slots: dict[str, Column]) -> Column:
    """Fill {name} slots in one pass; '{{' and '}}' are literal braces.

    Slots are cut out of the template before any value goes in, so a value that
    itself holds '{name}' or braces comes through unchanged.
    """
    literal = F.replace(F.replace(template, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    parts = F.split(literal, r"(?=\{)|(?<=\})")

    def one(part: Column) -> Column:
        out = F.replace(F.replace(part, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
        for name, value in slots.items():
            out = F.when(part == F.lit("{" + name + "}"), value).otherwise(out)
        return out

    return F.array_join(F.transform(parts, one), "")
