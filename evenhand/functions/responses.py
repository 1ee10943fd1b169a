"""Model responses as Columns: strict JSON, fenced JSON, pattern fallback, errors.

Every step is a built-in expression. ``classify_attempts`` lays the steps out as
successive projections, so a parse or a pattern runs once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .labels import contains_any
from .text import col, strip_quotes, ws_strip

SUCCESS, EMPTY, UNPARSEABLE, FAILED = "success", "empty", "json_error", "api_error"
OVERLOADED, RATE_LIMITED, BLOCKED = "overloaded", "rate_limited", "blocked"

# Control characters cannot stand unescaped in JSON, so a text cannot hold this by accident.
_END = "\x03end"
_END_JSON = '"\\u0003end"'

# Python's \s, \w and $ semantics: Unicode classes, '$' before a final \n only.
_FLAGS = "(?idU)"
_DOTALL = "(?sidU)"


def strict_json(text: Column | str) -> Column:
    """The text as one JSON value (VARIANT), or NULL when it is not exactly one.

    Spark's parsers stop at the end of the first value and ignore the rest. So the
    text is put into an array before an end mark: only if the array is
    [value, mark] was the text one whole value.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), col(text), F.lit("," + _END_JSON + "]")))
    whole = (F.try_variant_get(wrapped, "$[1]", "string") == F.lit(_END)) & (
        F.try_variant_get(wrapped, "$[2]", "variant").isNull())
    return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))


def lenient_object(text: Column | str) -> Column:
    """Second reading of an object VARIANT cannot hold: a repeated key (the last one
    wins) or a NaN number. NULL when the text is not one whole JSON object."""
    wrapped = F.from_json(
        F.concat(F.lit("["), col(text), F.lit(',{"prediction_label":' + _END_JSON + "}]")),
        "array<struct<prediction_label:string,reasoning:string>>",
        {"allowSingleQuotes": "false"},
    )
    whole = (F.size(wrapped) == 2) & (F.get(wrapped, F.lit(1))["prediction_label"] == F.lit(_END))
    return F.when(whole, F.get(wrapped, F.lit(0)))


def _extract(text: Column, pattern: str, flags: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, flags + pattern, group), F.lit(""))


def _is_object(text: Column) -> Column:
    """Whether a valid JSON text is an object."""
    return F.left(ws_strip(text), F.lit(1)) == "{"


def parse_responses(df: DataFrame, content: str = "content", provider: str = "provider") -> DataFrame:
    """Adds ``outcome``, ``prediction_label``, ``reasoning`` and ``error_message``.

    outcome is success, empty, json_error or api_error. The provider picks the
    dialect: one of the three knows fenced JSON and quoted patterns.
    """
    text, fenced = F.col(content), F.col(provider) == fv.GEMINI
    keep = df.columns

    def pattern(plain: str, quoted: str, flags: str) -> Column:
        return F.when(fenced, _extract(text, quoted, flags)).otherwise(_extract(text, plain, flags))

    # 1. strict JSON, then for one dialect the body of a fence
    step = df.withColumn("_doc", strict_json(text))
    step = step.withColumn("_alt", F.when(F.col("_doc").isNull(), lenient_object(text)))
    unread = F.col("_doc").isNull() & F.col("_alt").isNull()
    step = step.withColumn("_fence", F.when(
        unread & fenced, _extract(text, fv.FENCE_PATTERN, "(?sdU)")))
    step = step.withColumn("_body", F.coalesce(F.col("_fence"), text))
    step = step.withColumn("_doc", F.coalesce("_doc", F.when(
        F.col("_fence").isNotNull(), strict_json(F.col("_fence")))))
    step = step.withColumn("_alt", F.coalesce("_alt", F.when(
        F.col("_doc").isNull() & F.col("_fence").isNotNull(), lenient_object(F.col("_fence")))))

    # 2. patterns, only where there is neither JSON nor a fence
    loose = F.col("_doc").isNull() & F.col("_alt").isNull() & F.col("_fence").isNull()
    step = step.withColumn("_found", F.when(
        loose, pattern(fv.LABEL_PATTERN, fv.QUOTED_LABEL_PATTERN, _FLAGS)))
    step = step.withColumn("_why", F.when(
        F.col("_found").isNotNull(),
        pattern(fv.REASON_PATTERN, fv.QUOTED_REASON_PATTERN, _DOTALL)))

    # 3. label and reasoning of whichever reading holds
    step = step.withColumn("_value", F.try_variant_get("_doc", "$.prediction_label", "variant"))
    step = step.withColumn("_reason", F.try_variant_get("_doc", "$.reasoning", "variant"))
    misshapen = (
        F.when(F.col("_doc").isNotNull() & ~_is_object(F.col("_body")), True)
        .when(F.schema_of_variant("_value") != "STRING", True)
        .when(text.isNull(), True)
    )
    step = step.withColumn("_bad", misshapen)
    alt = F.col("_alt")
    raw_label = (
        F.when(F.col("_doc").isNotNull(), F.coalesce(F.try_variant_get("_value", "$", "string"), F.lit("")))
        .when(alt.isNotNull(), F.coalesce(alt["prediction_label"], F.lit("")))
        .when(F.col("_found").isNotNull(), strip_quotes(F.col("_found")))
    )
    step = step.withColumn("_label", F.when(F.col("_bad").isNull(), F.lower(ws_strip(raw_label))))
    outcome = (
        F.when(F.col("_bad").isNotNull(), FAILED)
        .when(F.col("_label").isNull(), UNPARSEABLE)
        .when(F.col("_label") == "", EMPTY)
        .otherwise(SUCCESS)
    )
    why = (
        F.when(F.col("_doc").isNotNull(), F.coalesce(
            F.try_variant_get("_reason", "$", "string"),
            F.when(F.col("_reason").isNull(), fv.NO_REASONING_PROVIDED)))
        .when(alt.isNotNull(), F.coalesce(alt["reasoning"], F.lit(fv.NO_REASONING_PROVIDED)))
        .otherwise(F.coalesce(ws_strip(F.col("_why")), F.lit(fv.NO_REASONING)))
    )
    keys = (
        F.when(F.col("_found").isNotNull(), F.array(F.lit("prediction_label"), F.lit("reasoning")))
        .otherwise(F.array_distinct(F.json_object_keys(F.col("_body"))))
    )
    listed = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
    error = (
        F.when(F.col("outcome") == FAILED, F.lit(fv.MISSHAPEN))
        .when(F.col("outcome") == UNPARSEABLE, F.lit(fv.UNPARSEABLE))
        .when(F.col("outcome") == EMPTY, F.concat(F.lit("Empty prediction (keys: ["), listed, F.lit("])")))
    )
    step = step.withColumn("outcome", outcome)
    won = F.col("outcome") == SUCCESS
    # One row in, one row out. The generator keeps a later filter on these columns from
    # being pushed below, where it would repeat the whole parse for each use of a step.
    return step.select(*keep, F.inline(F.array(F.struct(
        "outcome",
        F.when(won, F.col("_label")).alias("prediction_label"),
        F.when(won, why).alias("reasoning"),
        error.alias("error_message"),
    ))))


def error_outcome(provider: Column, error_text: Column) -> Column:
    """Class of a call that raised, by the wording its provider uses."""
    low = F.lower(error_text)
    together = F.when(
        contains_any(error_text, ("503", "429")) | F.contains(low, F.lit("overload")), OVERLOADED)
    gemini = F.when(
        contains_any(error_text, ("429", "Resource has been exhausted")), RATE_LIMITED
    ).when(
        F.contains(error_text, F.lit("finish_reason")) | contains_any(low, ("safety", "blocked")), BLOCKED)
    openai = F.when(
        F.contains(error_text, F.lit("429")) | F.contains(low, F.lit("rate_limit")), RATE_LIMITED)
    return F.coalesce(
        F.when(provider == fv.TOGETHER, together)
        .when(provider == fv.GEMINI, gemini)
        .when(provider == fv.OPENAI, openai),
        F.lit(FAILED),
    )


def error_text(outcome: Column, text: Column, attempt: Column, max_attempts: int) -> Column:
    """The message kept for a call that raised."""
    count = F.concat(F.lit(" (attempt "), attempt.cast("string"), F.lit(f"/{max_attempts})"))
    return (
        F.when(outcome == OVERLOADED, F.concat(F.lit("API overloaded"), count))
        .when(outcome == RATE_LIMITED, F.concat(F.lit("API rate limited"), count))
        .when(outcome == BLOCKED, F.lit(fv.BLOCKED_CONTENT))
        .otherwise(F.concat(F.lit("API error: "), F.coalesce(text, F.lit(""))))
    )


def response_block(provider: Column, status: Column, finish_reason: Column, content: Column,
                   detail: Column) -> Column:
    """Message of a response that came back blocked or without text, else NULL.

    Only one dialect has this; such a response ends the record, without a retry.
    """
    return F.when(provider == fv.GEMINI, F.when(status == "no_candidates", fv.BLOCKED_NO_CANDIDATES)
                  .when((status == "ok") & (finish_reason == 3), fv.BLOCKED_SAFETY)
                  .when((status == "ok") & (finish_reason == 2), fv.BLOCKED_FINISH)
                  .when((status == "ok") & content.isNull(),
                        F.concat(F.lit(fv.NO_PARTS), F.coalesce(detail, F.lit("")))))


def wait_seconds(outcome: Column, attempt: Column, max_attempts: int) -> Column:
    """Back-off after an attempt: 2, 4, 8, 16 s after a rate limit, 1 s after other
    errors, none after an empty label, a stop or the last attempt."""
    return F.when(attempt >= max_attempts, F.lit(0)).when(
        outcome.isin(OVERLOADED, RATE_LIMITED), F.pow(F.lit(2.0), attempt).cast("int")
    ).when(outcome.isin(UNPARSEABLE, FAILED), F.lit(1)).otherwise(F.lit(0))


def classify_attempts(responses: DataFrame, max_attempts: int = fv.MAX_ATTEMPTS) -> DataFrame:
    """One classified row per attempt: outcome, label, reasoning, error and back-off.

    Input columns as in ``schemas.RESPONSES``; status is ok, error or no_candidates.
    """
    status, provider = F.col("status"), F.col("provider")
    blocked = response_block(provider, status, F.col("finish_reason"), F.col("content"), F.col("error_text"))
    staged = responses.withColumn("_blocked", blocked).withColumn(
        "_raised", F.when(status == "error", error_outcome(provider, F.col("error_text"))))
    parsed = parse_responses(staged)
    out = parsed.withColumn("outcome", F.when(F.col("_blocked").isNotNull(), BLOCKED).otherwise(
        F.coalesce("_raised", "outcome")))
    won = F.col("outcome") == SUCCESS
    message = F.coalesce(
        F.col("_blocked"),
        F.when(status == "error", error_text(
            F.col("outcome"), F.col("error_text"), F.col("attempt"), max_attempts)),
        F.col("error_message"),
    )
    return out.withColumns({
        "error_message": F.when(~won, message),
        "prediction_label": F.when(won, F.col("prediction_label")),
        "reasoning": F.when(won, F.col("reasoning")),
        "stops": F.col("outcome").isin(SUCCESS, BLOCKED),
        "wait_seconds": wait_seconds(F.col("outcome"), F.col("attempt"), max_attempts),
    }).drop("_blocked", "_raised")
