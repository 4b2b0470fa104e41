"""Citation strings to opinions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.citations import parse_citation
from lexweave.operators import resolution as rs
from lexweave.plans import sqltext as q
from lexweave.plans.catalog import query

_PARSED = f"""
    parsed AS (
      SELECT authority_id, citing_opinion_id, citation_string, case_name, citation_type,
        CAST(nullif(regexp_extract(citation_string, {q.CITE}, 1), '') AS INT) AS volume,
        nullif(regexp_extract(citation_string, {q.CITE}, 2), '') AS reporter,
        CAST(nullif(regexp_extract(citation_string, {q.CITE}, 3), '') AS INT) AS page,
        CAST(nullif(regexp_extract(citation_string, {q.CITE}, 5), '') AS INT) AS year
      FROM v_authorities)"""
_EXACT = """
    exact AS (
      SELECT volume, page, min(opinion_id) AS exact_id
      FROM (SELECT DISTINCT volume, page FROM parsed WHERE volume IS NOT NULL) p
      JOIN v_opinions o ON o.raw_text LIKE '%' || p.volume || ' % ' || p.page || '%' GROUP BY 1, 2)"""
_EXACT_KEY = f"""
    found AS (
      SELECT opinion_id, CAST(regexp_extract(m, {q.CITE}, 1) AS INT) AS volume,
        regexp_extract(m, {q.CITE}, 2) AS reporter, CAST(regexp_extract(m, {q.CITE}, 3) AS INT) AS page
      FROM (SELECT opinion_id, unnest(regexp_extract_all(raw_text, {q.CITE}, 0)) AS m FROM v_opinions)),
    exact AS (
      SELECT volume, reporter, page, min(opinion_id) AS exact_id FROM found
      WHERE (volume, reporter, page) IN (SELECT (volume, reporter, page) FROM parsed WHERE volume IS NOT NULL) GROUP BY 1, 2, 3)"""
_FUZZY = """
    fuzzy AS (
      SELECT case_name, year, opinion_id AS fuzzy_id FROM (
        SELECT n.case_name, n.year, o.opinion_id, row_number() OVER (
            PARTITION BY n.case_name, n.year ORDER BY o.date_filed DESC, o.opinion_id) AS r
        FROM (SELECT DISTINCT case_name, year FROM parsed WHERE case_name <> '') n
        JOIN v_opinions o ON contains(lower(o.case_name), lower(n.case_name))
          AND (n.year IS NULL OR o.date_filed BETWEEN make_date(n.year - 1, 1, 1) AND make_date(n.year + 1, 12, 31)))
      WHERE r = 1)"""


def _parsed(c):
    return c.view("v_authorities").withColumn("c", parse_citation(F.col("citation_string"))).select(
        "authority_id", "citing_opinion_id", "citation_string", "case_name", "citation_type",
        "c.volume", "c.reporter", "c.page", "c.year")


@query("resolve_exact", f"WITH {_PARSED.strip()}, {_EXACT} SELECT volume, 'U.S.' AS reporter, page, exact_id FROM exact")
def resolve_exact(c):
    return rs.resolve_exact(_parsed(c).filter(F.col("volume").isNotNull()), c.text_view("v_opinions"), mode="like")


@query("resolve_exact_key", f"WITH {_PARSED.strip()}, {_EXACT_KEY} SELECT volume, reporter, page, exact_id FROM exact")
def resolve_exact_key(c):
    return rs.resolve_exact(_parsed(c).filter(F.col("volume").isNotNull()), c.text_view("v_opinions"))


@query("resolve_fuzzy", f"WITH {_PARSED.strip()}, {_FUZZY} SELECT case_name, year, fuzzy_id FROM fuzzy")
def resolve_fuzzy(c):
    return rs.resolve_fuzzy(_parsed(c), c.view("v_opinions"))


@query("latest_match", f"""
    WITH {_PARSED.strip()}, {_FUZZY}
    SELECT case_name, opinion_id AS fuzzy_id FROM (
      SELECT n.case_name, o.opinion_id, row_number() OVER (
        PARTITION BY n.case_name ORDER BY o.date_filed DESC, o.opinion_id) AS r
      FROM (SELECT DISTINCT case_name FROM parsed WHERE case_name <> '') n
      JOIN v_opinions o ON contains(lower(o.case_name), lower(n.case_name))) WHERE r = 1""")
def latest_match(c):
    """Newest opinion per name when no year is known."""
    names = _parsed(c).select("case_name", F.lit(None).cast("int").alias("year"))
    return rs.resolve_fuzzy(names, c.view("v_opinions")).select("case_name", "fuzzy_id")


def _resolved(exact: str, on: str) -> str:
    return f"""
    {_PARSED.strip()}, {exact}, {_FUZZY},
    edges AS (
      SELECT p.authority_id, p.citing_opinion_id, p.citation_string, p.case_name, p.citation_type,
        coalesce(e.exact_id, f.fuzzy_id) AS cited_opinion_id
      FROM parsed p LEFT JOIN exact e ON {on}
      LEFT JOIN fuzzy f ON f.case_name = p.case_name AND f.year IS NOT DISTINCT FROM p.year)"""


_RESOLVED = _resolved(_EXACT, "e.volume = p.volume AND e.page = p.page")
_RESOLVED_KEY = _resolved(_EXACT_KEY, "e.volume = p.volume AND e.reporter = p.reporter AND e.page = p.page")


@query("resolve_citations", f"WITH {_RESOLVED} SELECT * FROM edges")
def resolve_citations(c):
    return rs.resolve_citations(c.view("v_authorities"), c.text_view("v_opinions"), mode="like").select(
        "authority_id", "citing_opinion_id", "citation_string", "case_name", "citation_type", "cited_opinion_id")


@query("resolve_citations_key", f"WITH {_RESOLVED_KEY} SELECT * FROM edges")
def resolve_citations_key(c):
    """The default: texts that hold the very citation."""
    return rs.resolve_citations(c.view("v_authorities"), c.text_view("v_opinions")).select(
        "authority_id", "citing_opinion_id", "citation_string", "case_name", "citation_type", "cited_opinion_id")


@query("resolution_stats", f"""
    WITH {_RESOLVED} SELECT count(*) AS total, count(cited_opinion_id) AS resolved,
      count(*) - count(cited_opinion_id) AS unresolved FROM edges""")
def resolution_stats(c):
    return rs.resolution_stats(rs.resolve_citations(c.view("v_authorities"), c.text_view("v_opinions"), mode="like"))


@query("unresolved_citations", f"""
    WITH {_RESOLVED} SELECT citation_string, count(*) AS n FROM edges WHERE cited_opinion_id IS NULL GROUP BY 1""")
def unresolved_citations(c):
    return rs.unresolved_citations(rs.resolve_citations(c.view("v_authorities"), c.text_view("v_opinions"), mode="like"))
