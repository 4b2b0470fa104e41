"""Runs from landed JSON to tables, and from documents to links."""

import json

import pandas as pd
from pyspark.sql import functions as F

from lexweave.operators import runs
from lexweave.runtime import new_path
from lexweave.schemas import schema
from lexweave.sources import landed


def land(spark, name, rows):
    path = new_path(spark, name)
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(path)
    return landed.read_landed(spark, path, schema(f"landed_{name}"))


def test_landed_json_to_tables(spark):
    courts = land(spark, "courts", [
        {"court_id": "ca9", "full_name": "", "short_name": "Ninth Circuit", "court_code": "F"},
        {"court_id": "nysd", "full_name": "Southern District", "court_code": "FD"}])
    clusters = land(spark, "clusters", [
        {"cluster_id": 1, "court_id": "ca9", "case_name": "A v. B", "date_filed": "2020-01-01", "sub_opinions": ["/op/10/", "11"]},
        {"cluster_id": 2, "court_id": "nysd", "date_filed": "2021-01-01", "precedential_status": "Errata", "sub_opinions": []},
        {"cluster_id": 3, "court_id": "nysd", "case_name": "C", "date_filed": None, "sub_opinions": ["12"]},
        {"cluster_id": 4, "court_id": "nysd", "case_name": "D", "date_filed": "2019-01-01", "sub_opinions": ["13", "99", "10"]}])
    opinions = land(spark, "opinions", [
        {"opinion_id": 10, "plain_text": "Intro.\n\nORDER\n\nSee 1 U.S. 2."}, {"opinion_id": 11, "html": "<p>x</p>"},
        {"opinion_id": 2, "plain_text": "two"}, {"opinion_id": 12, "plain_text": "t"}, {"opinion_id": 13, "plain_text": " "}])
    table = new_path(spark, "opinions")
    spark.createDataFrame([], schema("opinions")).write.parquet(table)

    out = runs.ingest_landed(clusters, opinions, courts, table)
    stored = {r.courtlistener_id: r for r in spark.read.parquet(table).collect()}
    assert set(stored) == {10, 11, 2}
    assert stored[10].court_id == "ca9" and stored[10].court_level == "appellate"
    assert stored[2].case_name == "Unknown Case" and stored[2].precedential_status == "errata"
    assert {(r.opinion_id, r.error) for r in out["quarantine"].collect()} == {
        (12, "Missing date_filed in opinion data"), (13, "No text available")}
    assert [r.opinion_id for r in out["missing"].collect()] == [99]
    report = {r.court_id: tuple(r)[1:] for r in out["report"].collect()}
    assert report == {"ca9": (2, 2, 0, 0, 3), "nysd": (4, 1, 1, 2, 3)}
    assert sorted((r.opinion_id, r.section_type) for r in out["chunks"].collect()) == [
        (2, "majority"), (10, "holding"), (10, "majority"), (11, "majority")]

    again = runs.ingest_landed(clusters, opinions, courts, table, opinion_ids=spark.createDataFrame([(10,), (12,)], "i long"))
    assert again["opinions"].count() == 0 and spark.read.parquet(table).count() == 3


def test_documents_to_links(spark):
    def infer(batch):
        rows = []
        for i in batch.opinion_id:
            rows.append((json.dumps({
                "holding": f"h{i}", "holding_confidence": 0.2 if i == 2 else 0.8, "disposition": "affirmed",
                "disposition_confidence": 1, "legal_topics": ["t"] if i < 3 else [], "key_authorities": [
                    {"citation_string": "9 U.S. 8", "citation_context": "c", "citation_type": "cited", "paragraph_context": "p"},
                    {"citation_string": "7 F.3d 6", "case_name": "nobody", "citation_context": "c", "citation_type": "cited",
                     "paragraph_context": "p"}]}), 5, 1, None))
        return pd.DataFrame(rows, columns=["content", "prompt_tokens", "completion_tokens", "call_error"])

    opinions = spark.createDataFrame(
        [(1, "A v. B", "ca5", "text 9 U.S. 8 text", "2020-01-01"), (2, "C", "ca9", "t", "2020-01-01"), (3, "D", "ca9", "t", "2020-01-01")],
        "opinion_id long, case_name string, court_id string, raw_text string, date_filed string",
    ).withColumn("date_filed", F.col("date_filed").cast("date"))
    out = runs.extract_and_link(opinions, infer, "m", "s", "{opinion_text}", "{error_message}", max_retries=1)
    rows = {r.opinion_id: r for r in out["extractions"].collect()}
    assert [rows[i].status for i in (1, 2, 3)] == ["completed", "needs_review", "failed"]
    assert rows[3].holding == "Extraction failed" and rows[3].prompt_tokens == 10
    assert [f.name for f in out["extractions"].schema] == [f.name for f in schema("extractions")]
    links = [(r.citing_opinion_id, r.citation_string, r.cited_opinion_id) for r in out["citations"].collect()]
    assert sorted(links, key=str) == [(1, "7 F.3d 6", None), (1, "9 U.S. 8", 1), (2, "7 F.3d 6", None), (2, "9 U.S. 8", 1)]
