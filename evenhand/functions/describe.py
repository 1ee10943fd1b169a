"""Rows as text: 'name: value' lines, and the prompts built from them."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import CREDIT_CODES, CREDIT_NAMES, PROMPTS
from .labels import decode
from .text import fill_template, python_text

Describe = Callable[[DataFrame, Sequence[str]], Column]


def describe_row(
    df: DataFrame,
    features: Sequence[str],
    names: Mapping[str, str] | None = None,
    codes: Mapping[str, Mapping[str, str]] | None = None,
) -> Column:
    """One 'name: value' line per feature, in the given order.

    ``names`` renames features, ``codes`` decodes their values; features that the
    table does not have are left out.
    """
    names, codes = names or {}, codes or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    lines = []
    for name in features:
        if name not in types:
            continue
        value = F.col(f"`{name}`")
        shown = (decode(value, codes[name], types[name]) if name in codes
                 else python_text(value, types[name]))
        lines.append(F.concat(F.lit(f"{names.get(name, name)}: "), shown))
    return F.concat_ws("\n", *lines) if lines else F.lit("")


def describe_credit(df: DataFrame, features: Sequence[str]) -> Column:
    return describe_row(df, features, CREDIT_NAMES, CREDIT_CODES)


def prompt_columns(
    domain: Column,
    task: Column,
    positive: Column,
    negative: Column,
    record_id: Column,
    description: Column,
) -> tuple[Column, Column]:
    """(system_prompt, user_prompt) for a domain given as data; unknown domain gives NULL."""
    filled = []
    for part, slots in (
        (0, {"task_description": task, "positive_class": positive, "negative_class": negative}),
        (1, {"record_id": record_id, "data_description": description}),
    ):
        text = F.lit(None).cast("string")
        for name, templates in PROMPTS.items():
            text = F.when(domain == F.lit(name), _static_fill(templates[part], slots)).otherwise(text)
        filled.append(text)
    return filled[0], filled[1]


def _static_fill(template: str, slots: Mapping[str, Column]) -> Column:
    """A template known at plan time becomes one concat of literals and slots."""
    pieces: list[Column] = []
    for text, slot, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if slot is not None:
            pieces.append(slots[slot])
    return F.concat(*pieces)


def fill_prompt(template: Column, **slots: Column) -> Column:
    """Fill a template that is itself a column (a user's own template table)."""
    return fill_template(template, slots)
