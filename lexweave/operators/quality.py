"""Declared rules of the tables, counted as violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.constants import (
    CITATION_TYPES, CONFLICT_STATUSES, COURT_LEVELS, DISPOSITIONS, EXTRACTION_STATUSES,
    JOB_STATUSES, PRECEDENTIAL_STATUSES,
)


@dataclass(frozen=True)
class Rule:
    """``broken`` is true on a violating row; null counts as no violation, so a column that must be filled has ``required`` too."""

    name: str
    broken: Column


def required(column: str) -> Rule:
    return Rule(f"{column} required", F.col(column).isNull())


def non_empty(column: str) -> Rule:
    return Rule(f"{column} non-empty", F.coalesce(F.length(column) == 0, F.lit(True)))


def member(column: str, choices: Sequence[str]) -> Rule:
    return Rule(f"{column} in set", ~F.col(column).isin(*choices))


def within(column: str, low: float, high: float) -> Rule:
    return Rule(f"{column} in range", ~F.col(column).between(low, high))


def at_least(column: str, low: float) -> Rule:
    return Rule(f"{column} at least {low:g}", F.col(column) < low)


def _present(df: DataFrame, rules: Sequence[tuple[str, Rule]]) -> list[Rule]:
    return [rule for column, rule in rules if column in df.columns]


def table_rules(table: str, df: DataFrame) -> list[Rule]:
    """Declared row rules of a table, for the columns that ``df`` has."""
    rules: dict[str, list[tuple[str, Rule]]] = {
        "opinions": [
            ("opinion_id", required("opinion_id")),
            ("court_id", non_empty("court_id")),
            ("court_level", required("court_level")),
            ("court_level", member("court_level", COURT_LEVELS)),
            ("case_name", non_empty("case_name")),
            ("date_filed", required("date_filed")),
            ("precedential_status", required("precedential_status")),
            ("precedential_status", member("precedential_status", PRECEDENTIAL_STATUSES)),
            ("raw_text", non_empty("raw_text")),
            ("citation_count", at_least("citation_count", 0)),
        ],
        "extractions": [
            ("opinion_id", required("opinion_id")),
            ("holding", non_empty("holding")),
            ("holding_confidence", within("holding_confidence", 0.0, 1.0)),
            ("disposition", required("disposition")),
            ("disposition", member("disposition", DISPOSITIONS)),
            ("disposition_confidence", within("disposition_confidence", 0.0, 1.0)),
            ("status", required("status")),
            ("status", member("status", EXTRACTION_STATUSES)),
            ("prompt_tokens", at_least("prompt_tokens", 0)),
            ("completion_tokens", at_least("completion_tokens", 0)),
        ],
        "citations": [
            ("citing_opinion_id", required("citing_opinion_id")),
            ("citation_string", non_empty("citation_string")),
            ("citation_type", required("citation_type")),
            ("citation_type", member("citation_type", CITATION_TYPES)),
            ("citation_context", non_empty("citation_context")),
            ("paragraph_context", non_empty("paragraph_context")),
        ],
        "conflicts": [
            ("topic", non_empty("topic")),
            ("court_a", non_empty("court_a")),
            ("court_b", non_empty("court_b")),
            ("description", non_empty("description")),
            ("confidence", within("confidence", 0.0, 1.0)),
            ("status", required("status")),
            ("status", member("status", CONFLICT_STATUSES)),
        ],
        "chunks": [
            ("chunk_index", at_least("chunk_index", 0)),
            ("text", non_empty("text")),
            ("start_char", at_least("start_char", 0)),
            ("end_char", at_least("end_char", 0)),
        ],
        "jobs": [("status", required("status")), ("status", member("status", JOB_STATUSES))],
    }
    return _present(df, rules[table])


def constraint_report(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Violations per rule: one scan, one aggregation, then one row per rule."""
    wide = df.agg(*[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, r in enumerate(rules)
    ])
    return wide.select(F.lit(table).alias("table_name"), F.explode(rows).alias("r")).select(
        "table_name", "r.rule", "r.violations")


def link_report(
    df: DataFrame, table: str, column: str, parent: DataFrame, parent_table: str, key: str,
) -> DataFrame:
    """Rows whose ``column`` names no row of ``parent``; null is no link. Equal links are counted before the join."""
    links = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    lost = links.join(parent.select(key), key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return lost.select(
        F.lit(table).alias("table_name"), F.lit(f"{column} in {parent_table}").alias("rule"), "violations")


def uniqueness_report(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of every key."""
    extra = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(", ".join(keys) + " unique").alias("rule"), "violations")
