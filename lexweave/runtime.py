"""Shared plumbing: where intermediate tables live and how small inputs are spread."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Session setting with the number of partitions that small inputs of text work are spread over; unset, none is.
SPREAD = "spark.lexweave.spread"
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    The folder must be reachable from every executor. A private folder is made
    only in local mode when the session names none.
    """
    inner = _folder.get()
    if inner:
        return inner
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _private_dir()


@lru_cache(maxsize=1)
def _private_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own below :func:`work_dir`."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written by the jobs inside go to a folder of their own, which is deleted at the end.

    What a job returns reads those tables, so use or store it before the end.
    """
    folder = new_path(spark, "scratch")
    mark = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(mark)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables written by these jobs, wherever it lies; one that is not there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(spark: SparkSession, parent: str, prefix: str) -> list[int]:
    """Numbers of the finished tables ``prefix=number`` below ``parent``, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().split("=")[1]) for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and gives the planner the
    real size of the data.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input over as many partitions as the session asks for by ``SPREAD``.

    Text work is CPU-bound; a small file of one row group would keep one core
    busy. That is for tests and benchmarks: without the setting, as on large
    inputs, texts stay where they are read and nothing is shuffled.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), key) if parts else df
