"""Lookups on stored tables; predicates reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.ranking import page, top_per_group


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def batch_lookup(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the single column of ``wanted``."""
    ids = wanted.select(F.col(wanted.columns[0]).alias(column))
    return df.join(ids, column, "left_semi")


def list_by_court(
    opinions: DataFrame, court_id: str, date_after: str | None = None,
    date_before: str | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """A page of a court's opinions, newest first, ties by id."""
    out = opinions.filter(F.col("court_id") == court_id)
    if date_after is not None:
        out = out.filter(F.col("date_filed") >= F.lit(date_after).cast("date"))
    if date_before is not None:
        out = out.filter(F.col("date_filed") <= F.lit(date_before).cast("date"))
    return page(out, [F.desc("date_filed"), F.col("opinion_id")], limit, offset)


def search_filter(
    court_level: str | None = None, court_ids: list[str] | None = None,
    jurisdiction: str | None = None, date_after: str | None = None, date_before: str | None = None,
) -> Column:
    """Conjunction of the given conditions; true when none is given."""
    parts = []
    if court_level is not None:
        parts.append(F.col("court_level") == court_level)
    if court_ids:
        parts.append(F.col("court_id").isin(court_ids))
    if jurisdiction is not None:
        parts.append(F.col("jurisdiction") == jurisdiction)
    if date_after is not None:
        parts.append(F.col("date_filed") >= F.lit(date_after).cast("date"))
    if date_before is not None:
        parts.append(F.col("date_filed") <= F.lit(date_before).cast("date"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def list_pending(extractions: DataFrame, limit: int = 50) -> DataFrame:
    waiting = extractions.filter(F.col("status") == "pending")
    return page(waiting, [F.col("created_at"), F.col("extraction_id")], limit)


def extractions_of(extractions: DataFrame, opinion_id: int) -> DataFrame:
    """All extractions of an opinion, newest first."""
    return extractions.filter(F.col("opinion_id") == opinion_id).orderBy(
        F.desc("created_at"), F.desc("extraction_id"))


def outgoing_edges(citations: DataFrame, opinion_id: int, limit: int = 200, offset: int = 0) -> DataFrame:
    return page(citations.filter(F.col("citing_opinion_id") == opinion_id),
                [F.col("citation_id")], limit, offset)


def incoming_edges(citations: DataFrame, opinion_id: int, limit: int = 200, offset: int = 0) -> DataFrame:
    return page(citations.filter(F.col("cited_opinion_id") == opinion_id),
                [F.col("citation_id")], limit, offset)


def edge_pages(citations: DataFrame, end: str, limit: int = 200, offset: int = 0) -> DataFrame:
    """One page of the edges of every opinion at once.

    ``end`` is the column that names the opinion: citing for outgoing edges, cited
    for incoming ones. Edges come in order of their id.
    """
    known = citations.filter(F.col(end).isNotNull())
    ranked = top_per_group(known, [end], [F.col("citation_id")], offset + limit, rank="_place")
    return ranked.filter(F.col("_place") > offset).drop("_place")


def count_opinions(opinions: DataFrame, court_id: str | None = None) -> DataFrame:
    rows = opinions if court_id is None else opinions.filter(F.col("court_id") == court_id)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def count_by_court(opinions: DataFrame) -> DataFrame:
    return opinions.groupBy("court_id").agg(F.count(F.lit(1)).alias("n"))
