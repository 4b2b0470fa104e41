"""Repeated ingestion that skips what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.ranking import top_per_group
from lexweave.runtime import folders, materialize, remove
from lexweave.streaming.jobs import run_available

#: Buckets of stored keys, and bits of each bucket's Bloom filter with so many of them a key. A filter is good for about
#: a tenth as many keys as bits; beyond, more buckets are read than need be, and nothing else changes.
BUCKETS, FILTER_BITS, PROBES = 64, 1 << 17, 4


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _marks(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, key, word, mark): the bits of each key, as words of 64."""
    places = F.array(*[F.pmod(F.xxhash64(F.lit(n), key), F.lit(bits)) for n in range(PROBES)])
    return rows.select("bucket", key, F.explode(F.array_distinct(places)).alias("_at")).select(
        "bucket", key, F.shiftright("_at", 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at").bitwiseAND(F.lit(63)).cast("int")).alias("mark"))


def may_be_stored(batch: DataFrame, key: str, marks: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(bucket, key) of the rows of ``batch`` (bucket, key) whose bits are all in the filters ``marks`` (bucket, word, bits)."""
    asked = _marks(batch, key, bits).groupBy("bucket", key, "word").agg(F.bit_or("mark").alias("mark"))
    met = asked.join(marks, ["bucket", "word"], "left")
    held = F.coalesce(F.col("bits").bitwiseAND(F.col("mark")) == F.col("mark"), F.lit(False))
    return met.groupBy("bucket", key).agg(F.bool_and(held).alias("held")).filter("held").drop("held")


def stored_keys(spark: SparkSession, keys: str, buckets: list[int], before: int) -> DataFrame:
    """Keys that batches earlier than ``before`` have stored in ``buckets``; only their folders are read."""
    return spark.read.parquet(keys).filter(F.col("bucket").isin(buckets) & (F.col("batch") < before))


def ingest_stream(
    batches: DataFrame, key: str, table: str, checkpoint: str, buckets: int = BUCKETS, bits: int = FILTER_BITS,
) -> None:
    """Append rows of a stream whose ``key`` the table at ``table`` does not hold yet.

    Beside the table lie its keys (``table-keys``), one folder for each bucket and
    batch, and a Bloom filter of each bucket (``table-filter``). A batch first asks
    the filters, and reads only the buckets that may hold one of its keys; keys
    that are new throughout cost no look at what is stored. The filters' size is
    fixed by ``buckets`` and ``bits``, which must stay the same for a table.

    A batch writes its own folders and looks only at those of earlier batches: run
    again, it writes the same rows. A stream that starts anew on its old folders
    goes through them again from its first batch.
    """
    keys, filters = f"{table}-keys", f"{table}-filter"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c != key]
        order = [F.xxhash64(*others), *map(F.col, others)] if others else [F.col(key)]
        fresh = top_per_group(batch, [key], order, 1)
        earlier = [n for n in folders(spark, filters, "batch") if n < batch_id]
        marks = spark.read.parquet(f"{filters}/batch={earlier[-1]}") if earlier else None
        if marks is not None:
            fresh = materialize(fresh, "batch")
            maybe = materialize(may_be_stored(fresh.select(key, _bucket(key, buckets)), key, marks, bits), "maybe")
            asked = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most the number of buckets
            if asked:
                known = maybe.join(stored_keys(spark, keys, asked, batch_id), ["bucket", key], "left_semi").select(key)
                fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        written = spark.read.schema(fresh.schema).parquet(f"{table}/batch={batch_id}").select(key, _bucket(key, buckets))
        written.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.partitionBy("bucket", "batch").option(
            "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(keys)
        new = _marks(written, key, bits).groupBy("bucket", "word").agg(F.bit_or("mark").alias("bits"))
        if marks is not None:
            new = marks.unionByName(new).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        new.write.mode("overwrite").parquet(f"{filters}/batch={batch_id}")
        for old in earlier[:-1]:
            remove(spark, f"{filters}/batch={old}")

    run_available(batches.writeStream.foreachBatch(handle), checkpoint)
