"""Extraction requests, job states and counters as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.constants import PRIORITIES
from lexweave.operators.jobs import estimated_seconds
from lexweave.runtime import folders, materialize, remove


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream. A single file is named by a pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if path.endswith(".parquet"):
        path = path[:-1] + "[t]"
    return reader.parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Start, process what is there, stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def queue_order():
    """Order of requests within a batch: priority, then time of submission."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return [F.when(rank > 0, rank).otherwise(len(PRIORITIES)), F.col("submitted_at"), F.col("job_id")]


def job_stream(
    requests: DataFrame, run_items: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str,
) -> None:
    """Runs requests as they arrive.

    ``requests`` has ``job_id``, ``opinion_ids``, ``priority``, ``submitted_at`` and
    may name the ``extraction_model`` to use, which the items keep.
    Each batch is cut into items that keep what orders the queue as the column
    ``queue_key`` (rank of the priority, time, job), so later joins cannot lose
    the order, and ``run_items`` turns items into outcome rows. A batch writes its
    own folder and, when that is whole, a mark. A batch that is delivered again
    after the mark calls nothing; before it, it replaces what it had written. The
    checkpoint holds what was delivered, so no request is lost half done.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, f"{out_path}-done/batch={batch_id}"
        if _is_table(spark, mark):
            return
        rank, *rest = queue_order()
        items = batch.select(
            "job_id", "priority", "submitted_at",
            *[m for m in ("extraction_model",) if m in batch.columns],
            F.struct(rank.alias("rank"), *rest).alias("queue_key"),
            estimated_seconds(F.col("opinion_ids")).alias("estimated_seconds"),
            F.posexplode("opinion_ids").alias("pos", "opinion_id"))
        run_items(items).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        spark.range(1).write.mode("overwrite").parquet(mark)

    run_available(requests.writeStream.foreachBatch(handle), checkpoint)


def _is_table(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table has been written at ``path``; a begun one has no files yet."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


_COUNTS = ("total_opinions", "processed", "failed")
_COUNTER_SCHEMA = "started_at timestamp, _last timestamp, total_opinions bigint, processed bigint, failed bigint"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(
        F.min("started_at").alias("started_at"), F.max("_last").alias("_last"), *[F.sum(c).alias(c) for c in _COUNTS])


def counter_stream(events: DataFrame, out_path: str, checkpoint: str, declared: DataFrame | None = None) -> None:
    """Item counters of every job (job_id, ts, outcome), kept up to date by :func:`latest_counters`.

    After each batch there is one table of the open jobs' counters, made from the
    one before and the batch, and a table of the jobs that have ended with it: all
    items that ``declared`` (job_id, total_opinions) names are done. Ended jobs
    leave the memory of the stream, so what a batch reads and writes grows with
    the open jobs only; without ``declared`` none ends. Each item comes once, so
    none follows the end of its job.

    Both tables of a batch are replaced if it is delivered again, and it starts
    from those of the batch before. Older open tables are deleted. A stream that
    starts anew on its old folder begins with nothing.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            remove(spark, out_path)
        added = batch.groupBy("job_id").agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("_last"),
            F.count(F.lit(1)).alias("total_opinions"),
            F.count_if(F.col("outcome") == "ok").alias("processed"),
            F.count_if(F.col("outcome") == "failed").alias("failed"))
        if batch_id:
            added = _summed(spark.read.parquet(f"{out_path}/open/batch={batch_id - 1}").unionByName(added))
        ended = F.lit(False)
        if declared is not None:
            totals = declared.select("job_id", F.col("total_opinions").alias("_declared"))
            added = added.join(totals, "job_id", "left")
            ended = F.coalesce(F.col("processed") + F.col("failed") >= F.col("_declared"), F.lit(False))
        now = materialize(added.withColumn("_ended", ended).drop("_declared"), "counters")
        now.filter("_ended").drop("_ended").write.mode("overwrite").parquet(f"{out_path}/ended/batch={batch_id}")
        now.filter("not _ended").drop("_ended").write.mode("overwrite").parquet(f"{out_path}/open/batch={batch_id}")
        for old in folders(spark, f"{out_path}/open", "batch"):
            if old < batch_id - 1:
                remove(spark, f"{out_path}/open/batch={old}")

    run_available(events.writeStream.foreachBatch(handle), checkpoint)


def latest_counters(spark: SparkSession, out_path: str) -> DataFrame:
    """Current counters of every job: the last table of open jobs, and those that had ended by then."""
    done = folders(spark, f"{out_path}/open", "batch")
    if not done:
        return spark.createDataFrame([], f"job_id bigint, {_COUNTER_SCHEMA}")
    ended = spark.read.parquet(f"{out_path}/ended").filter(F.col("batch") <= done[-1]).drop("batch")
    return spark.read.parquet(f"{out_path}/open/batch={done[-1]}").unionByName(ended)
