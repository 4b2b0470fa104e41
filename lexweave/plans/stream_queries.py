"""Streams over the given event log, run to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import runs
from lexweave.operators.jobs import declared_states
from lexweave.plans.catalog import query
from lexweave.plans.ingest_queries import REFS_SQL, _refs
from lexweave.plans.job_queries import REQUEST_ID, STATE_COLUMNS, STATE_SQL, declared_jobs, requests
from lexweave.plans.model_queries import CORRECTIVE, DEFAULT_MODEL, PROVIDERS, SYSTEM, USER, asked_sql
from lexweave.runtime import new_path
from lexweave.streaming import ingest as si
from lexweave.streaming import jobs as sj


def _item_stream(c, label):
    """The items of the event log, landed as files and read as a stream, one file per batch."""
    path = new_path(c.spark, label)
    items = c.view("v_job_items")
    items.repartition(3, "event_id").write.parquet(path)
    return sj.file_stream(c.spark, path, items.schema, files_per_batch=1)


@query("stream_counters", """
    SELECT job_id, count(*) AS total_opinions, count(CASE WHEN outcome = 'ok' THEN 1 END) AS processed, count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed
    FROM v_job_items GROUP BY job_id""")
def stream_counters(c):
    out = new_path(c.spark, "counters")
    sj.counter_stream(_item_stream(c, "items"), out, new_path(c.spark, "checkpoint"))
    return sj.latest_counters(c.spark, out).select("job_id", "total_opinions", "processed", "failed")


@query("stream_job_state", STATE_SQL)
def stream_job_state(c):
    """Counters kept by the stream, judged by the totals that the requests declare."""
    out = new_path(c.spark, "states")
    declared = declared_jobs(c)
    sj.counter_stream(_item_stream(c, "items"), out, new_path(c.spark, "checkpoint"), declared)
    return declared_states(declared, sj.latest_counters(c.spark, out)).select(*STATE_COLUMNS)


@query("stream_events", """
    SELECT CAST(floor(event_id / 10) AS BIGINT) AS job_id, count(*) AS total_opinions FROM events GROUP BY 1""")
def stream_events(c):
    """The given event file itself as a stream source."""
    events = sj.file_stream(c.spark, c.path("events"), c.table("events").schema)
    items = events.select(
        F.floor(F.col("event_id") / 10).cast("bigint").alias("job_id"), "ts", F.lit("ok").alias("outcome"))
    out = new_path(c.spark, "events")
    sj.counter_stream(items, out, new_path(c.spark, "checkpoint"))
    return sj.latest_counters(c.spark, out).select("job_id", "total_opinions")


_LANG_MODEL = "CASE lang WHEN 'en' THEN 'claude-x' WHEN 'de' THEN 'gpt-y' END"


@query("job_stream", f"""
    SELECT job_id, opinion_id, priority, 5.0::DOUBLE * n AS estimated_seconds, coalesce(model, 'gpt-x') AS extraction_model,
      CASE WHEN kind >= 2 THEN 'failed' WHEN share < 3 THEN 'needs_review' ELSE 'completed' END AS status,
      CASE WHEN kind >= 2 THEN 'Extraction failed' ELSE CASE WHEN model LIKE 'claude%' THEN 'anthropic' ELSE 'openai' END || ' on ' || cited END AS holding
    FROM (SELECT *, {_LANG_MODEL} AS model, CASE lang WHEN 'en' THEN 'high' WHEN 'fr' THEN 'low' ELSE 'normal' END AS priority,
            count(*) OVER (PARTITION BY job_id) AS n FROM (SELECT doc_id AS opinion_id, lang, {REQUEST_ID} AS job_id FROM documents)) d
    JOIN ({asked_sql("''")}) USING (opinion_id)""")
def job_stream(c):
    """Requests processed as they arrive, each by the model that it names."""
    asked = requests(c).withColumns({
        "priority": F.when(F.col("lang") == "en", "high").when(F.col("lang") == "fr", "low").otherwise("normal"),
        "extraction_model": F.expr(_LANG_MODEL)})
    path, out = new_path(c.spark, "requests"), new_path(c.spark, "outcomes")
    asked.repartition(2, "job_id").write.parquet(path)
    opinions = c.view("v_opinions")

    def run_items(items):
        return runs.extract_items(items, opinions, PROVIDERS, DEFAULT_MODEL, SYSTEM, USER, CORRECTIVE)

    stream = sj.file_stream(c.spark, path, asked.schema, files_per_batch=1)
    sj.job_stream(stream, run_items, out, new_path(c.spark, "checkpoint"))
    return c.spark.read.parquet(out).select(
        "job_id", "opinion_id", "priority", "estimated_seconds", "extraction_model", "status", "holding")


@query("stream_ingest_dedup", f"""
    SELECT DISTINCT opinion_id AS courtlistener_id FROM ({REFS_SQL})""")
def stream_ingest_dedup(c):
    path, table = new_path(c.spark, "landed"), new_path(c.spark, "opinions")
    batch = _refs(c).select(F.col("opinion_id").alias("courtlistener_id"), "cluster_id")
    batch.repartition(3, "cluster_id").write.parquet(path)
    si.ingest_stream(sj.file_stream(c.spark, path, batch.schema, files_per_batch=1), "courtlistener_id", table,
                     new_path(c.spark, "checkpoint"))
    return c.spark.read.parquet(table).select("courtlistener_id")
