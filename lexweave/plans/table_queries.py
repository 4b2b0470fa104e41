"""Lookups, listings, counts and paging on stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators.ranking import page
from lexweave.plans.catalog import query
from lexweave.sources import sinks, tables

_OPINION = ("opinion_id", "courtlistener_id", "court_id", "case_name", "date_filed")
_COLS = ", ".join(_OPINION)


@query("point_lookup", f"SELECT {_COLS} FROM v_opinions WHERE courtlistener_id IN (SELECT doc_id + 70000 FROM labels)")
def point_lookup(c):
    """All opinions that carry labels, looked up by their source id."""
    wanted = c.table("labels").select((F.col("doc_id") + 70000).alias("id"))
    return tables.batch_lookup(c.view("v_opinions"), "courtlistener_id", wanted).select(*_OPINION)


@query("list_by_court", f"""
    SELECT {_COLS} FROM v_opinions WHERE court_id = 'ca9' AND date_filed BETWEEN DATE '2001-01-01' AND DATE '2022-12-31'
    ORDER BY date_filed DESC, opinion_id LIMIT 100 OFFSET 10""")
def list_by_court(c):
    return tables.list_by_court(c.view("v_opinions"), "ca9", "2001-01-01", "2022-12-31", 100, 10).select(*_OPINION)


@query("paginate", f"SELECT {_COLS} FROM v_opinions ORDER BY case_name, opinion_id LIMIT 50 OFFSET 100")
def paginate(c):
    return page(c.view("v_opinions").select(*_OPINION), [F.col("case_name"), F.col("opinion_id")], 50, 100)


@query("count_opinions", """
    SELECT court_id, count(*) AS n FROM v_opinions GROUP BY court_id
    UNION ALL SELECT 'all', count(*) FROM v_opinions""")
def count_opinions(c):
    opinions = c.view("v_opinions")
    total = tables.count_opinions(opinions).select(F.lit("all").alias("court_id"), "n")
    return tables.count_by_court(opinions).unionByName(total)


@query("search_filter", """
    SELECT opinion_id, court_id, date_filed FROM v_vectors WHERE court_level = 'appellate'
      AND court_id IN ('ca1', 'ca5', 'ca9') AND date_filed BETWEEN DATE '2002-01-01' AND DATE '2021-12-31'
    UNION ALL SELECT opinion_id, court_id, date_filed FROM v_vectors WHERE jurisdiction = 'nysd'""")
def search_filter(c):
    rows = c.view("v_vectors").drop("embedding")
    first = rows.filter(tables.search_filter("appellate", ["ca1", "ca5", "ca9"], None, "2002-01-01", "2021-12-31"))
    second = rows.filter(tables.search_filter(jurisdiction="nysd"))
    return first.unionByName(second).select("opinion_id", "court_id", "date_filed")


@query("list_pending", """
    SELECT extraction_id, opinion_id, created_at FROM v_extraction_versions WHERE status = 'pending'
    ORDER BY created_at, extraction_id LIMIT 50""")
def list_pending(c):
    return tables.list_pending(c.view("v_extraction_versions")).select("extraction_id", "opinion_id", "created_at")


@query("update_status", """
    SELECT extraction_id, CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'needs_review' ELSE status END AS status,
      quality IS NOT NULL AS updated
    FROM v_extractions LEFT JOIN labels ON doc_id = opinion_id""")
def update_status(c):
    """Review verdicts from the labels set the status of their extractions."""
    updates = c.table("labels").select(
        (F.col("doc_id") * 3).alias("extraction_id"),
        F.when(F.col("quality") == 1, "completed").otherwise("needs_review").alias("status"))
    return sinks.update_status(c.view("v_extractions"), updates, "extraction_id").select(
        "extraction_id", "status", "updated")


@query("lookup_edges", """
    SELECT 'outgoing' AS side, citing_opinion_id AS opinion_id, citation_id FROM (
      SELECT *, row_number() OVER (PARTITION BY citing_opinion_id ORDER BY citation_id) AS r FROM v_citations) WHERE r <= 200
    UNION ALL SELECT 'incoming', cited_opinion_id, citation_id FROM (
      SELECT *, row_number() OVER (PARTITION BY cited_opinion_id ORDER BY citation_id) AS r FROM v_citations
      WHERE cited_opinion_id IS NOT NULL) WHERE r BETWEEN 2 AND 201""")
def lookup_edges(c):
    """The first page of outgoing edges and a shifted one of incoming edges, for every opinion."""
    edges = c.view("v_citations")

    def side(name, end, offset):
        return tables.edge_pages(edges, end, offset=offset).select(
            F.lit(name).alias("side"), F.col(end).alias("opinion_id"), "citation_id")

    return side("outgoing", "citing_opinion_id", 0).unionByName(side("incoming", "cited_opinion_id", 1))


@query("relationship_nav", """
    SELECT t.citation_id, a.case_name AS citing_name, b.case_name AS cited_name, e.disposition AS citing_disposition
    FROM v_citations t JOIN v_opinions a ON a.opinion_id = t.citing_opinion_id
    LEFT JOIN v_opinions b ON b.opinion_id = t.cited_opinion_id
    JOIN v_extractions e ON e.opinion_id = t.citing_opinion_id""")
def relationship_nav(c):
    names = c.view("v_opinions").select("opinion_id", "case_name")
    citing = names.toDF("citing_opinion_id", "citing_name")
    cited = names.toDF("cited_opinion_id", "cited_name")
    held = c.view("v_extractions").select(
        F.col("opinion_id").alias("citing_opinion_id"), F.col("disposition").alias("citing_disposition"))
    edges = c.view("v_citations").join(citing, "citing_opinion_id").join(held, "citing_opinion_id")
    # links that lead nowhere stay out of the join, where they would all meet in one task
    known = edges.filter(F.col("cited_opinion_id").isNotNull()).join(cited, "cited_opinion_id", "left")
    open_ = edges.filter(F.col("cited_opinion_id").isNull()).withColumn("cited_name", F.lit(None).cast("string"))
    return known.unionByName(open_).select("citation_id", "citing_name", "cited_name", "citing_disposition")
