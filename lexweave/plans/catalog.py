"""Registry of queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans.corpus import Corpus, with_views

_JOBS: dict[str, Callable[[Corpus], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job under ``name``; ``sql`` may use the views of the corpus."""
    def register(job: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        if name in _JOBS:
            raise ValueError(f"query {name} is registered twice")
        _JOBS[name] = job
        if sql is not None:
            _SQL[name] = with_views(sql)
        return job

    return register


def _runner(job: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: job(Corpus(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(job) for name, job in _JOBS.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from lexweave.plans import (  # noqa: F401
        conflict_queries, graph_queries, ingest_queries, job_queries, model_queries,
        resolution_queries, search_queries, stream_queries, table_queries, text_queries,
    )
