"""Scores, ages and code tables as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.constants import (
    AGE_WITHOUT_RECENCY, AUTHORITIES_FOR_ALL, EVIDENCE_WEIGHTS, TOPICS_FOR_ALL,
    COURT_CODE_LEVEL, DEFAULT_LEVEL_RANK, DEFAULT_LEVEL_WEIGHT, LEVEL_RANK, LEVEL_WEIGHT,
    SOURCE_STATUS,
)


def lookup(table: dict, key: Column, default) -> Column:
    """Small fixed table as a map literal; missing keys give ``default``."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def court_level(code: Column, short_name: Column) -> Column:
    """Level from the type code; the court's short name overrules it."""
    code, name = F.coalesce(code, F.lit("")), F.lower(F.coalesce(short_name, F.lit("")))
    return (
        F.when(name.contains("supreme") & ~F.lower(code).contains("state"), "supreme")
        .when(name.contains("circuit") | name.contains("appeals"), "appellate")
        .otherwise(lookup(COURT_CODE_LEVEL, code, "specialized"))
    )


def precedential_status(label: Column) -> Column:
    return lookup(SOURCE_STATUS, F.coalesce(label, F.lit("Unknown")), "unknown")


def iso_date(text: Column) -> Column:
    """Date in the first ten characters, null when missing or malformed."""
    head = F.substring(text, 1, 10)
    return F.coalesce(
        F.try_to_date(F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), head), "yyyy-MM-dd"),
        F.try_to_date(F.when(head.rlike(r"^[0-9]{8}\z"), head), "yyyyMMdd"),
    )


def id_from_ref(ref: Column) -> Column:
    """Number at the end of a reference: an id, or a path whose last part is one."""
    tail = F.element_at(F.split(F.regexp_replace(ref, "/+$", ""), "/"), -1)
    return tail.try_cast("bigint")


def age_years(as_of: Column, day: Column) -> Column:
    return F.datediff(as_of, day) / F.lit(365.25)


def authority_score(cites: Column, rank: Column, age: Column) -> Column:
    """Half citation count, then court rank and recency; no date, no recency."""
    recency = F.greatest(F.lit(0.0), 1.0 - age / 30.0) * 0.2
    return (
        F.least(cites / 10.0, F.lit(1.0)) * 0.5
        + rank / 100.0 * 0.3
        + F.coalesce(recency, F.lit(0.0))
    )


def level_rank(level: Column) -> Column:
    return lookup(LEVEL_RANK, level, DEFAULT_LEVEL_RANK)


def level_weight(level: Column) -> Column:
    return lookup(LEVEL_WEIGHT, level, DEFAULT_LEVEL_WEIGHT)


def conflict_evidence(
    opposing: Column, conflicting: Column, topics: Column, cites: Column, weight_a: Column, weight_b: Column,
) -> Column:
    """Weighted evidence for a conflict, without the ages."""
    return (
        F.when(opposing, EVIDENCE_WEIGHTS["opposing"]).otherwise(0.0)
        + F.when(conflicting, EVIDENCE_WEIGHTS["conflicting"]).otherwise(0.0)
        + F.least(topics / TOPICS_FOR_ALL, F.lit(1.0)) * EVIDENCE_WEIGHTS["topics"]
        + F.least(cites / AUTHORITIES_FOR_ALL, F.lit(1.0)) * EVIDENCE_WEIGHTS["authorities"]
        + (weight_a + weight_b) / 2.0 * EVIDENCE_WEIGHTS["levels"]
    )


def with_recency(evidence: Column, age_a: Column, age_b: Column) -> Column:
    """Evidence and the weight of the mean age, at most 1; it falls as the ages rise."""
    mean_age = (age_a + age_b) / 2.0
    recency = F.greatest(F.lit(0.0), 1.0 - mean_age / AGE_WITHOUT_RECENCY) * EVIDENCE_WEIGHTS["age"]
    return F.least(evidence + F.coalesce(recency, F.lit(0.0)), F.lit(1.0))


def conflict_confidence(
    opposing: Column, conflicting: Column, topics: Column, cites: Column,
    weight_a: Column, weight_b: Column, age_a: Column, age_b: Column,
) -> Column:
    """Weighted evidence for a conflict, at most 1, to four places."""
    evidence = conflict_evidence(opposing, conflicting, topics, cites, weight_a, weight_b)
    return F.round(with_recency(evidence, age_a, age_b), 4)
