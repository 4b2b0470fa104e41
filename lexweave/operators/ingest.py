"""Landed records to stored opinions: metadata, text choice, quarantine, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.constants import OPINION_URL, TEXT_FIELDS
from lexweave.functions.scoring import court_level, iso_date, precedential_status
from lexweave.functions.segments import chunk_count
from lexweave.functions.text import (
    is_blank, normalize_whitespace, strip_html, unescape_and_normalize,
)


def _opinion_url(opinion_id: Column) -> Column:
    before, after = OPINION_URL.split("{}")
    return F.concat(F.lit(before), opinion_id.cast("string"), F.lit(after))


def normalize_metadata(records: DataFrame) -> DataFrame:
    """Metadata of joined opinion, cluster and court records, with an ``error`` column.

    Expects ``opinion_id``, ``cluster_id``, ``court_id``, ``full_name``,
    ``short_name``, ``court_code``, ``case_name``, ``date_filed`` (text),
    ``precedential_status``, ``citation_count``, ``judges``. A missing id or an
    unusable date is an error; a missing name, count or judge list has a default.
    """
    day = iso_date(F.col("date_filed"))
    error = (
        F.when(F.col("opinion_id").isNull() | F.col("cluster_id").isNull(),
               "Missing id in opinion or cluster data")
        .when(F.coalesce(F.length("date_filed") == 0, F.lit(True)),
              "Missing date_filed in opinion data")
        .when(day.isNull(), "Invalid date_filed format")
    )
    name = F.coalesce(
        F.nullif(F.col("full_name"), F.lit("")), F.col("short_name"), F.lit("Unknown Court"))
    return records.withColumns({
        "court_id": F.coalesce(F.col("court_id"), F.lit("unknown")),
        "jurisdiction": F.coalesce(F.col("court_id"), F.lit("unknown")),
        "court_name": name,
        "court_level": court_level(F.col("court_code"), F.col("short_name")),
        "case_name": F.coalesce(F.col("case_name"), F.lit("Unknown Case")),
        "date_filed": day,
        "precedential_status": precedential_status(F.col("precedential_status")),
        "citation_count": F.coalesce(F.col("citation_count"), F.lit(0)),
        "judges": F.coalesce(F.col("judges"), F.lit("")),
        "source_url": _opinion_url(F.col("opinion_id")),
        "error": error,
    }).drop("full_name", "short_name", "court_code")


def with_best_text(records: DataFrame, output: str = "raw_text") -> DataFrame:
    """First non-blank representation, cleaned as its kind needs; none gives ''.

    The choice is made before cleaning, so each row passes the decoder once.
    """
    fields = [f for f in TEXT_FIELDS if f in records.columns]
    picked = F.coalesce(*[F.when(~is_blank(F.col(f)), F.col(f)) for f in fields], F.lit(""))
    plain = ~is_blank(F.col("plain_text")) if "plain_text" in fields else F.lit(False)
    rows = records.withColumn("_raw", picked).withColumn("_plain", plain)
    rows = rows.withColumn("_markup", strip_html(F.when(~F.col("_plain"), F.col("_raw"))))
    rows = rows.withColumn("_body", F.coalesce("_markup", "_raw"))
    rows = rows.withColumn("_body", unescape_and_normalize(F.col("_body"), ~F.col("_plain")))
    return rows.withColumn(output, normalize_whitespace(F.col("_body"))).drop(
        "_raw", "_plain", "_markup", "_body")


def split_errors(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable opinions and quarantined rows; empty text joins the errors."""
    judged = records.withColumn(
        "error", F.coalesce("error", F.when(F.col("raw_text") == "", "No text available")))
    return judged.filter(F.col("error").isNull()).drop("error"), judged.filter(
        F.col("error").isNotNull())


def opinion_rows(good: DataFrame) -> DataFrame:
    """Columns of the opinions table; the landed opinion id is the unique source key."""
    return good.select(
        F.col("opinion_id").alias("courtlistener_id"), "court_id", "court_level", "case_name",
        "date_filed", "precedential_status", "raw_text", "citation_count", "judges",
        "jurisdiction", "source_url",
    )


def ingest_report(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Fetched, stored, skipped, error and chunk counts per court in one pass.

    ``records`` are fetched records with ``raw_text`` and ``error``. A record is
    skipped when its id is stored already or came earlier in the run, where
    courts come in order of their id.
    """
    judged = records.withColumn(
        "error", F.coalesce("error", F.when(F.col("raw_text") == "", "No text available")))
    counted = judged.select(
        "court_id", "opinion_id", F.col("error").isNotNull().alias("bad"),
        F.when(F.col("error").isNull(), chunk_count(F.col("raw_text")))
        .otherwise(0).alias("chunks"),
    )
    per_id = counted.groupBy("court_id", "opinion_id").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if("bad").alias("errors"),
        F.sum("chunks").alias("chunks"))
    known = existing.select(F.col("courtlistener_id").alias("opinion_id")).distinct().withColumn(
        "known", F.lit(True))
    usable = F.col("fetched") - F.col("errors")
    turn = F.row_number().over(
        Window.partitionBy("opinion_id").orderBy(F.desc(F.least(usable, F.lit(1))), "court_id"))
    stored = F.when(F.col("known").isNull() & (usable > 0) & (F.col("turn") == 1), 1).otherwise(0)
    return (
        per_id.join(known, "opinion_id", "left").withColumn("turn", turn)
        .withColumn("stored", stored).withColumn("skipped", usable - stored)
        .groupBy("court_id")
        .agg(*[F.sum(c).cast("bigint").alias(c)
               for c in ("fetched", "stored", "skipped", "errors", "chunks")])
    )
