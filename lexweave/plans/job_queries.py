"""Extraction jobs and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import jobs as jb
from lexweave.plans.catalog import query

# Twice as many items as events: the jobs of every second id are still open.
_JOBS_SQL = """
    SELECT job_id, count(*) + CASE WHEN job_id % 2 = 0 THEN 1 ELSE 0 END AS total_opinions FROM v_job_items GROUP BY job_id
    UNION ALL SELECT DISTINCT -1 - job_id, 10 FROM v_job_items"""


def declared_jobs(c):
    """Jobs of the event log, every second one with an item still to come, and jobs not begun."""
    counts = c.view("v_job_items").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    begun = counts.select("job_id", (F.col("n") + F.when(F.col("job_id") % 2 == 0, 1).otherwise(0)).alias("total_opinions"))
    waiting = counts.select((-1 - F.col("job_id")).alias("job_id"), F.lit(10).cast("bigint").alias("total_opinions"))
    return begun.unionByName(waiting)


_LATEST = """SELECT * EXCLUDE r FROM (
    SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY created_at DESC, extraction_id DESC) AS r
    FROM v_extraction_versions) WHERE r = 1"""


@query("latest_extraction", f"SELECT opinion_id, extraction_id, created_at, status FROM ({_LATEST})")
def latest_extraction(c):
    return jb.latest_extraction(c.view("v_extraction_versions")).select(
        "opinion_id", "extraction_id", "created_at", "status")


REQUEST_ID = "concat_ws('-', source, lang, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING))"


def requests(c):
    """One job per source, language and thousand of ids, its opinions in order of id.

    A job never lists more than a thousand opinions, however large a source is.
    """
    docs = c.table("documents").select(F.expr(REQUEST_ID).alias("job_id"), "doc_id", "lang")
    return docs.groupBy("job_id", "lang").agg(
        F.sort_array(F.collect_list("doc_id")).alias("opinion_ids"), F.min("doc_id").alias("submitted_at"))


@query("job_results", f"""
    SELECT j.job_id, CAST(j.pos AS INT) AS pos, j.opinion_id, CASE WHEN x.extraction_id IS NULL THEN 'pending' ELSE o.case_name END AS case_name,
      coalesce(x.status, 'pending') AS status, substr(x.holding, 1, 80) AS preview
    FROM (SELECT {REQUEST_ID} AS job_id, doc_id AS opinion_id,
            row_number() OVER (PARTITION BY {REQUEST_ID} ORDER BY doc_id) - 1 AS pos FROM documents) j
    LEFT JOIN ({_LATEST.replace("v_extraction_versions", "v_begun_versions")}) x USING (opinion_id) LEFT JOIN v_opinions o USING (opinion_id)""")
def job_results(c):
    return jb.job_results(requests(c), c.view("v_begun_versions"), c.view("v_opinions")).select(
        "job_id", "pos", "opinion_id", "case_name", "status", "preview")


@query("job_counters", """
    SELECT job_id, count(*) AS total_opinions, count(CASE WHEN outcome = 'ok' THEN 1 END) AS processed, count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed,
      CASE WHEN count(CASE WHEN outcome = 'failed' THEN 1 END) < count(*) THEN 'completed' ELSE 'failed' END AS status
    FROM v_job_items GROUP BY job_id""")
def job_counters(c):
    return jb.job_counters(c.view("v_job_items"))


STATE_SQL = f"""
    SELECT j.job_id, total_opinions, coalesce(processed, 0) AS processed, coalesce(failed, 0) AS failed, started_at,
      CASE WHEN started_at IS NULL THEN 'queued' WHEN processed + failed < total_opinions THEN 'running'
           WHEN failed < total_opinions THEN 'completed' ELSE 'failed' END AS status,
      CASE WHEN processed + failed >= total_opinions THEN last_at END AS completed_at
    FROM ({_JOBS_SQL}) j LEFT JOIN (
      SELECT job_id, min(ts) AS started_at, max(ts) AS last_at, count(CASE WHEN outcome = 'ok' THEN 1 END) AS processed,
        count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed FROM v_job_items GROUP BY job_id) s USING (job_id)"""
STATE_COLUMNS = ("job_id", "total_opinions", "processed", "failed", "started_at", "status", "completed_at")


@query("job_state", STATE_SQL)
def job_state(c):
    return jb.job_state(declared_jobs(c), c.view("v_job_items")).select(*STATE_COLUMNS)


@query("increment_counters", f"""
    SELECT job_id, 1 + coalesce(p, 0) AS processed, coalesce(f, 0) AS failed FROM ({_JOBS_SQL})
    LEFT JOIN (SELECT job_id, count(CASE WHEN outcome = 'ok' THEN 1 END) AS p, count(CASE WHEN outcome = 'failed' THEN 1 END) AS f
               FROM v_job_items GROUP BY job_id) USING (job_id)""")
def increment_counters(c):
    start = declared_jobs(c).select("job_id", F.lit(1).alias("processed"), F.lit(0).alias("failed"))
    deltas = c.view("v_job_items").select(
        "job_id", F.when(F.col("outcome") == "ok", 1).otherwise(0).alias("processed_delta"),
        F.when(F.col("outcome") == "failed", 1).otherwise(0).alias("failed_delta"))
    return jb.increment_counters(start, deltas)


@query("token_usage", """
    SELECT opinion_id, extraction_model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
      CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM v_job_items GROUP BY 1, 2""")
def token_usage(c):
    return jb.token_usage(c.view("v_job_items"), ["opinion_id", "extraction_model"])


@query("event_metrics", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def event_metrics(c):
    return jb.event_counts(c.table("events"), ["event_type", "user_id"])


_BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("event_histogram", f"""
    SELECT event_type, le, count(CASE WHEN bound IS NULL OR value <= bound THEN 1 END) AS n, round(sum(value), 4) AS total
    FROM events CROSS JOIN (VALUES {', '.join(f"('{b}', {b})" for b in _BOUNDS)}, ('+Inf', NULL)) b(le, bound)
    GROUP BY event_type, le""")
def event_histogram(c):
    rows = jb.event_histogram(c.table("events"), ["event_type"], "value", _BOUNDS)
    return rows.withColumn("total", F.round("total", 4))
