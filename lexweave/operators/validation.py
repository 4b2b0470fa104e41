"""Validation of model output in stages; the first failing stage gives the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.constants import REVIEW_THRESHOLD
from lexweave.functions.intelligence import (
    json_kind, parse_json, read_intelligence, review_status, rule_violations, schema_issues,
)
from lexweave.functions.text import let


def json_error(value: Column) -> Column:
    kind = json_kind(value)
    return F.when(kind.isNull(), "Invalid JSON").when(
        kind != "dict", F.concat(F.lit("Expected JSON object, got "), kind))


def attach_run_metadata(df: DataFrame, model: Column, stamp: Column,
                        prompt_tokens: Column, completion_tokens: Column) -> DataFrame:
    """Model, time and cumulated tokens of the run, as columns of the record."""
    return df.withColumns({
        "extraction_model": model, "extraction_timestamp": stamp,
        "prompt_tokens": prompt_tokens, "completion_tokens": completion_tokens,
    })


def judge(df: DataFrame, raw: str = "raw", threshold: float = REVIEW_THRESHOLD,
          strict: bool = True) -> DataFrame:
    """Adds ``intelligence``, ``error``, ``stage`` and ``status`` to rows of model output.

    The prompt does not ask the model for run metadata (model, time, tokens)
    although the declared shape has it. ``strict`` demands it of the output all
    the same; otherwise it is left to :func:`attach_run_metadata`.

    All findings of a row are fields of one bound expression, so the text is
    parsed once and a later filter on ``stage`` carries that expression once.
    """
    return with_verdict(df, verdict_column(raw, threshold, strict))


def verdict_column(raw: str, threshold: float = REVIEW_THRESHOLD, strict: bool = True) -> Column:
    """The findings as one struct; build it once to judge several tables."""
    return let(parse_json(F.col(raw)), lambda v: _verdict(v, threshold, strict))


def with_verdict(df: DataFrame, verdict: Column) -> DataFrame:
    judged = df.withColumn("_verdict", verdict)
    return judged.withColumns({
        name: F.col(f"_verdict.{name}") for name in ("intelligence", "error", "stage", "status")
    }).drop("_verdict")


def _verdict(value: Column, threshold: float, strict: bool) -> Column:
    bad_json = json_error(value)
    none = F.array().cast("array<string>")
    issues = F.when(bad_json.isNull(), schema_issues(value, strict)).otherwise(none)

    def shaped(found: Column) -> Column:
        fits = bad_json.isNull() & (F.size(found) == 0)
        return let(F.when(fits, read_intelligence(value)), lambda intel: ruled(found, intel))

    def ruled(found: Column, intel: Column) -> Column:
        broken = F.when(intel.isNotNull(), rule_violations(intel)).otherwise(none)
        return let(broken, lambda rules: finding(found, intel, rules))

    def finding(found: Column, intel: Column, rules: Column) -> Column:
        good = intel.isNotNull() & (F.size(rules) == 0)
        error = F.coalesce(
            bad_json,
            F.when(F.size(found) > 0, F.concat(F.lit("Schema validation failed: "), F.array_join(found, "; "))),
            F.when(F.size(rules) > 0, F.concat(F.lit("Business rule violations: "), F.array_join(rules, "; "))),
        )
        stage = (
            F.when(bad_json.isNotNull(), "json").when(F.size(found) > 0, "schema")
            .when(F.size(rules) > 0, "rules").otherwise("ok")
        )
        return F.struct(
            F.when(good, intel).alias("intelligence"), error.alias("error"), stage.alias("stage"),
            F.when(good, review_status(intel.holding_confidence, threshold)).alias("status"))

    return let(issues, shaped)


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records and quarantine."""
    return (judged.filter(F.col("stage") == "ok").drop("error", "stage"),
            judged.filter(F.col("stage") != "ok").drop("intelligence", "status"))
