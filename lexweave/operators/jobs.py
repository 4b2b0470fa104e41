"""Extraction jobs: results, counters, states and usage from tables and event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.constants import LATENCY_BUCKETS, SECONDS_PER_OPINION
from lexweave.operators.ranking import latest_per_key

PREVIEW = 80


def latest_extraction(extractions: DataFrame) -> DataFrame:
    """Newest extraction of every opinion, ties by the larger id."""
    return latest_per_key(extractions, "opinion_id", [F.desc("created_at"), F.desc("extraction_id")])


def job_results(jobs: DataFrame, extractions: DataFrame, opinions: DataFrame) -> DataFrame:
    """Each opinion of every job in list order with its newest extraction.

    An opinion without one is reported as pending.
    """
    items = jobs.select("job_id", F.posexplode("opinion_ids").alias("pos", "opinion_id"))
    newest = latest_extraction(extractions)
    names = opinions.select("opinion_id", "case_name")
    joined = items.join(newest, "opinion_id", "left").join(names, "opinion_id", "left")
    return joined.withColumn(
        "case_name", F.when(F.col("extraction_id").isNull(), "pending").otherwise(F.col("case_name"))
    ).withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn(
        "preview", F.substring("holding", 1, PREVIEW))


def job_counters(items: DataFrame) -> DataFrame:
    """Processed and failed items per job, and the status these lead to.

    ``outcome`` is 'ok' for a stored row, placeholder rows included, and 'failed'
    for an item that raised.
    """
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_opinions"),
        F.count_if(F.col("outcome") == "ok").alias("processed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    ).withColumn("status", final_status(F.col("failed"), F.col("total_opinions")))


def final_status(failed: Column, total: Column) -> Column:
    return F.when(failed < total, "completed").otherwise("failed")


def job_state(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """State of every job from its item events.

    No event: queued. Fewer events than items: running. All items: completed or
    failed, and only then an end time. The start is that of the first event.
    """
    seen = events.groupBy("job_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("_last"),
        F.count_if(F.col("outcome") == "ok").alias("processed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"))
    return declared_states(jobs, seen)


def declared_states(jobs: DataFrame, counters: DataFrame) -> DataFrame:
    """State of every declared job from counters that a table or a stream has brought up to date.

    The number of items is what the request declared, never what was seen so far.
    """
    seen = counters.select("job_id", "started_at", "_last", "processed", "failed")
    rows = jobs.select("job_id", "total_opinions").join(seen, "job_id", "left").withColumns({
        "processed": F.coalesce("processed", F.lit(0)), "failed": F.coalesce("failed", F.lit(0))})
    return with_state(rows)


def with_state(rows: DataFrame) -> DataFrame:
    done = F.col("processed") + F.col("failed")
    ended = done >= F.col("total_opinions")
    status = (
        F.when(F.col("started_at").isNull(), "queued")
        .when(~ended, "running")
        .otherwise(final_status(F.col("failed"), F.col("total_opinions")))
    )
    return rows.withColumns({
        "status": status,
        "completed_at": F.when(ended & F.col("started_at").isNotNull(), F.col("_last")),
    }).drop("_last")


def increment_counters(jobs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Job counters plus the summed deltas; jobs without one stay as they are."""
    sums = deltas.groupBy("job_id").agg(
        F.sum("processed_delta").alias("_p"), F.sum("failed_delta").alias("_f"))
    return jobs.join(sums, "job_id", "left").withColumns({
        "processed": F.col("processed") + F.coalesce("_p", F.lit(0)),
        "failed": F.col("failed") + F.coalesce("_f", F.lit(0)),
    }).drop("_p", "_f")


def token_usage(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"))


def estimated_seconds(opinion_ids: Column) -> Column:
    return F.size(opinion_ids) * F.lit(SECONDS_PER_OPINION)


def event_counts(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def event_histogram(
    events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Cumulative histogram per label set: all buckets in one aggregation.

    The last bucket has no bound and counts everything.
    """
    wide = events.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias(f"b{len(bounds)}"), F.sum(value).alias("total"))
    buckets = F.array(*[
        F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n"))
        for i, b in enumerate([*map(float, bounds), "+Inf"])
    ])
    return wide.select(*labels, "total", F.explode(buckets).alias("b")).select(
        *labels, "b.le", "b.n", "total")
