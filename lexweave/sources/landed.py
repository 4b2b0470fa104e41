"""Landed source records: court, cluster and opinion files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.scoring import id_from_ref, iso_date
from lexweave.operators.ranking import top_per_group


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Landed records with a declared schema, never an inferred one."""
    return spark.read.schema(schema).format(fmt).load(path)


def court_quota(max_opinions: int, courts: int) -> int:
    return max(max_opinions // courts, 1) if courts else 0


def source_clusters(
    clusters: DataFrame, court_ids: Sequence[str] | None = None, date_after: str | None = None,
    date_before: str | None = None, per_court: int | None = None,
) -> DataFrame:
    """Clusters of the courts in an inclusive date range, newest first per court."""
    out = clusters
    if court_ids is not None:
        out = out.filter(F.col("court_id").isin(list(court_ids)))
    day = iso_date(F.col("date_filed"))
    if date_after is not None:
        out = out.filter(day >= F.lit(date_after).cast("date"))
    if date_before is not None:
        out = out.filter(day <= F.lit(date_before).cast("date"))
    if per_court is None:
        return out
    order = [day.desc_nulls_last(), F.col("cluster_id")]
    return top_per_group(out, ["court_id"], order, per_court)


def explode_sub_opinions(clusters: DataFrame, refs: Column) -> DataFrame:
    """One row per opinion reference; a cluster without any stands for itself."""
    own = F.array(F.col("cluster_id").cast("string"))
    some = F.when(F.size(F.coalesce(refs, F.array().cast("array<string>"))) == 0, own).otherwise(refs)
    return clusters.withColumn("_ref", F.explode(some)).withColumn(
        "opinion_id", id_from_ref(F.col("_ref"))).filter(F.col("opinion_id").isNotNull()).drop("_ref")


def source_lookup(refs: DataFrame, opinions: DataFrame, courts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opinion and court record of every reference, and the references not landed.

    ``refs`` carries ``opinion_id`` and ``court_id``. An unknown court yields a
    record made of its id alone.
    """
    found = refs.join(opinions, "opinion_id").join(courts, "court_id", "left")
    missing = refs.join(opinions.select("opinion_id"), "opinion_id", "left_anti")
    return found, missing
