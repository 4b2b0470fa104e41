"""Whole runs: landed records to tables, and documents to extractions with links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.constants import MAX_RETRIES, REVIEW_THRESHOLD
from lexweave.operators import chunking, inference, ingest, resolution
from lexweave.runtime import materialize
from lexweave.sources import landed, sinks


def ingest_landed(
    clusters: DataFrame, opinions: DataFrame, courts: DataFrame, table: str,
    court_ids: Sequence[str] | None = None, date_after: str | None = None, date_before: str | None = None,
    max_opinions: int | None = None, opinion_ids: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Landed records to new rows of the opinions table at ``table``.

    Selects clusters per court, follows their opinion references, joins court and
    text, cleans, cuts into chunks and appends what is new. ``opinion_ids`` (one
    column) restricts the run to those opinions. Returns opinions, chunks,
    quarantine, references not landed, and the report per court.
    """
    quota = None if max_opinions is None else landed.court_quota(
        max_opinions, len(court_ids) if court_ids else courts.count())
    chosen = landed.source_clusters(clusters, court_ids, date_after, date_before, quota)
    refs = landed.explode_sub_opinions(chosen, F.col("sub_opinions")).drop("sub_opinions")
    if opinion_ids is not None:
        refs = refs.join(opinion_ids.toDF("opinion_id"), "opinion_id", "left_semi")
    asked = opinions.join(refs.select("opinion_id").distinct(), "opinion_id", "left_semi")  # only these are cleaned
    texts = ingest.with_best_text(asked).select("opinion_id", "raw_text")
    found, missing = landed.source_lookup(refs, texts, courts)
    records = materialize(ingest.normalize_metadata(found), "records")
    good, bad = ingest.split_errors(records)
    stored = records.sparkSession.read.parquet(table)
    report = materialize(ingest.ingest_report(records, stored), "report")
    fresh = materialize(
        sinks.new_rows(ingest.opinion_rows(good), stored, "courtlistener_id",
                       [F.col("court_id"), F.col("case_name"), F.col("date_filed")]), "opinions")
    sinks.append(fresh.select(*stored.columns), table)
    chunks = chunking.chunk_documents(fresh.withColumnRenamed("courtlistener_id", "opinion_id"))
    return {"opinions": fresh, "chunks": chunks, "quarantine": bad, "missing": missing, "report": report}


def extract_and_link(
    opinions: DataFrame, infer: inference.Infer | Mapping[str, inference.Infer], model: str, system: str, user: str, corrective: str,
    corpus: DataFrame | None = None, max_retries: int = MAX_RETRIES, threshold: float = REVIEW_THRESHOLD,
    strict: bool = False, match: str = "key",
) -> dict[str, DataFrame]:
    """Model output of ``opinions`` as extraction rows, and their citations resolved in ``corpus``.

    ``match`` is the mode of :func:`resolution.resolve_exact`.
    """
    docs = opinions.select(
        "opinion_id", "case_name", F.col("court_id").alias("court"), "raw_text",
        *[c for c in ("extraction_model",) if c in opinions.columns])
    outcomes, log = inference.extract_documents(
        docs, infer, model, system, user, corrective, max_retries, threshold, strict)
    rows = materialize(sinks.extraction_rows(outcomes), "extractions")
    cited = rows.select(
        F.col("opinion_id").alias("citing_opinion_id"), F.posexplode("key_authorities").alias("pos", "a")
    ).select("citing_opinion_id", "pos", "a.*")
    edges = resolution.resolve_citations(cited, corpus if corpus is not None else opinions, match)
    citations = sinks.with_surrogate_id(edges, "citation_id", "citing_opinion_id", "pos").drop("pos")
    return {"extractions": rows, "citations": citations, "attempts": log}


def extract_items(
    items: DataFrame, opinions: DataFrame, infer: inference.Infer | Mapping[str, inference.Infer], model: str,
    system: str, user: str, corrective: str, strict: bool = False,
) -> DataFrame:
    """Items of requests (opinion_id, perhaps extraction_model) with the extraction row of each, by the model that it asks for.

    An opinion is sent to a model once, however many items ask for that.
    """
    named = F.coalesce(F.col("extraction_model"), F.lit(model)) if "extraction_model" in items.columns else F.lit(model)
    items = materialize(items.withColumn("extraction_model", named), "items")
    keys = ["opinion_id", "extraction_model"]
    docs = items.select(*keys).distinct().join(opinions.select(
        "opinion_id", "case_name", F.col("court_id").alias("court"), "raw_text"), "opinion_id")
    outcomes, _ = inference.extract_documents(docs, infer, model, system, user, corrective, strict=strict)
    return items.join(sinks.extraction_rows(outcomes), keys)
