"""Citation graph: walks from many opinions, edges, degrees and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.scoring import age_years
from lexweave.operators import graph
from lexweave.plans.catalog import query
from lexweave.plans.corpus import AS_OF

_OUT = "SELECT citing_opinion_id AS src, cited_opinion_id AS dst FROM v_citations WHERE cited_opinion_id IS NOT NULL"
_BACK = "SELECT cited_opinion_id AS src, citing_opinion_id AS dst FROM v_citations WHERE cited_opinion_id IS NOT NULL"
_BOTH = f"{_OUT} UNION {_BACK}"


_ROOTS = "SELECT opinion_id FROM v_opinions WHERE opinion_id % 100 = 0"


def _walk(name: str, steps: str, depth: int, roots: str = _ROOTS) -> str:
    """Breadth-first by repeated union of distinct rows; the least depth is taken later."""
    return f"""
      {name} AS (
        SELECT opinion_id AS root_id, opinion_id, 0 AS depth FROM ({roots})
        UNION
        SELECT w.root_id, s.dst, w.depth + 1 FROM {name} w JOIN ({steps}) s ON s.src = w.opinion_id WHERE w.depth < {depth})"""


def _least(name: str) -> str:
    return f"SELECT root_id, opinion_id, min(depth) AS depth FROM {name} GROUP BY 1, 2"


def _roots(c):
    """The requested walks: one from every opinion with an id divisible by 100."""
    return c.view("v_opinions").filter("opinion_id % 100 = 0").select(F.col("opinion_id").alias("root_id"))


def _as_of():
    return F.lit(AS_OF).cast("date")


@query("graph_walk", f"WITH RECURSIVE {_walk('w', _OUT, 3)} {_least('w')}")
def graph_walk(c):
    walk = graph.graph_walk(c.view("v_citations"), c.view("v_opinions"), _roots(c), 3, "outgoing")
    return walk.select("root_id", "opinion_id", "depth")


@query("graph_walk_incoming", f"WITH RECURSIVE {_walk('w', _BACK, 2)} {_least('w')}")
def graph_walk_incoming(c):
    walk = graph.graph_walk(c.view("v_citations"), c.view("v_opinions"), _roots(c), 2, "incoming")
    return walk.select("root_id", "opinion_id", "depth")


@query("graph_walk_both", f"WITH RECURSIVE {_walk('w', _BOTH, 2)} {_least('w')}")
def graph_walk_both(c):
    walk = graph.graph_walk(c.view("v_citations"), c.view("v_opinions"), _roots(c), 2, "both")
    return walk.select("root_id", "opinion_id", "depth")


@query("graph_attrs", f"""
    WITH RECURSIVE {_walk('w', _OUT, 1, 'SELECT opinion_id FROM v_opinions')}
    SELECT root_id, opinion_id, depth, case_name, court_id FROM ({_least('w')}) JOIN v_opinions USING (opinion_id)""")
def graph_attrs(c):
    """The first step of the walk from every opinion."""
    opinions = c.view("v_opinions")
    return graph.graph_walk(c.view("v_citations"), opinions, opinions.select(F.col("opinion_id").alias("root_id")), 1, "outgoing")


@query("edges_both_directions", f"SELECT src, dst FROM ({_BOTH})")
def edges_both_directions(c):
    return graph.walk_steps(c.view("v_citations"), "both")


@query("min_depth_per_node", """
    SELECT citing_opinion_id AS root_id, cited_opinion_id AS opinion_id, min(citation_id % 4) AS depth
    FROM v_citations WHERE cited_opinion_id IS NOT NULL GROUP BY 1, 2""")
def min_depth_per_node(c):
    """Visits ranked by their place among the citing opinion's links."""
    visits = c.view("v_citations").filter(F.col("cited_opinion_id").isNotNull()).select(
        F.col("citing_opinion_id").alias("root_id"), F.col("cited_opinion_id").alias("opinion_id"),
        (F.col("citation_id") % 4).alias("depth"))
    return graph.min_depth_per_node(visits)


_MERGED = f"""
    WITH RECURSIVE {_walk('o', _OUT, 2)}, {_walk('i', _BACK, 2)},
      od AS ({_least('o')}), id AS ({_least('i')}),
      merged AS (SELECT root_id, opinion_id, coalesce(od.depth, id.depth) AS depth
                 FROM od FULL JOIN id USING (root_id, opinion_id))"""


@query("merge_walks", f"{_MERGED} SELECT root_id, opinion_id, depth FROM merged")
def merge_walks(c):
    return _both_walks(c).select("root_id", "opinion_id", "depth")


def _both_walks(c):
    edges, opinions, roots = c.view("v_citations"), c.view("v_opinions"), _roots(c)
    return graph.merge_walks(
        graph.graph_walk(edges, opinions, roots, 2, "outgoing"),
        graph.graph_walk(edges, opinions, roots, 2, "incoming"))


@query("node_union_distinct", f"""
    {_MERGED} SELECT root_id, count(*) AS nodes, CAST(sum(depth) AS BIGINT) AS depth_sum FROM merged GROUP BY root_id""")
def node_union_distinct(c):
    return _both_walks(c).groupBy("root_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("depth").alias("depth_sum"))


@query("induced_edges", """
    SELECT citation_id, citing_opinion_id, cited_opinion_id FROM v_citations
    WHERE citing_opinion_id IN (SELECT opinion_id FROM v_opinions WHERE court_level = 'appellate')
      AND cited_opinion_id IN (SELECT opinion_id FROM v_opinions WHERE court_level = 'appellate')""")
def induced_edges(c):
    nodes = c.view("v_opinions").filter(F.col("court_level") == "appellate").select("opinion_id")
    return graph.induced_edges(c.view("v_citations"), nodes).select(
        "citation_id", "citing_opinion_id", "cited_opinion_id")


@query("citation_in_degree", """
    SELECT opinion_id, count(citation_id) AS in_degree
    FROM v_opinions LEFT JOIN v_citations ON cited_opinion_id = opinion_id GROUP BY opinion_id""")
def citation_in_degree(c):
    return graph.citation_in_degree(c.view("v_citations"), c.view("v_opinions"))


_ROOT_QUERIES = ("57 U.S. 393", "600 U.S. 894 (2019)", "topic 7", "topic 39", "9999 U.S. 99999", "no such topic")


def _root_sql(text: str) -> str:
    digits = text.split()
    by_text = "NULL"
    if digits[1:2] == ["U.S."]:
        by_text = f"(SELECT min(opinion_id) FROM v_opinions WHERE raw_text LIKE '%{digits[0]}%{digits[2]}%')"
    return f"""SELECT '{text}' AS query, coalesce({by_text}, (
        SELECT t.opinion_id FROM v_topics t JOIN v_extractions e USING (opinion_id)
        WHERE topic = '{text}' AND status = 'completed' ORDER BY created_at DESC, extraction_id DESC LIMIT 1)) AS opinion_id"""


@query("find_root", " UNION ALL ".join(_root_sql(t) for t in _ROOT_QUERIES))
def find_root(c):
    asked = c.spark.createDataFrame([(t,) for t in _ROOT_QUERIES], "query string")
    return graph.find_roots(asked, c.text_view("v_opinions"), c.extractions())


_RANK = """CASE court_level WHEN 'supreme' THEN 100 WHEN 'appellate' THEN 80 WHEN 'state_supreme' THEN 70
  WHEN 'state_appellate' THEN 50 WHEN 'district' THEN 40 WHEN 'state_trial' THEN 30 WHEN 'bankruptcy' THEN 20 ELSE 25 END"""


def _score_sql(nodes: str, rank: str) -> str:
    return f"""
      SELECT opinion_id, case_name, court_id, citation_count, round(least(citation_count / 10.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE
        + {rank} / 100.0::DOUBLE * 0.3::DOUBLE
        + greatest(0.0::DOUBLE, 1.0::DOUBLE - age / 30.0::DOUBLE) * 0.2::DOUBLE, 6) AS score
      FROM (SELECT o.opinion_id, case_name, court_id, court_level,
              date_diff('day', date_filed, DATE '{AS_OF}') / 365.25::DOUBLE AS age,
              (SELECT count(*) FROM v_citations t WHERE t.cited_opinion_id = o.opinion_id) AS citation_count
            FROM v_opinions o WHERE o.opinion_id IN ({nodes}))"""


@query("authority_score", f"""
    SELECT a.opinion_id, a.citation_count, a.score, b.score AS parity_score
    FROM ({_score_sql('SELECT opinion_id FROM v_opinions', _RANK)}) a
    JOIN ({_score_sql('SELECT opinion_id FROM v_opinions', '25')}) b USING (opinion_id)""")
def authority_score(c):
    opinions, edges = c.view("v_opinions"), c.view("v_citations")
    nodes = opinions.select("opinion_id")
    by_level = graph.score_authorities(nodes, edges, opinions, _as_of())
    flat = graph.score_authorities(nodes, edges, opinions, _as_of(), parity=True)
    return by_level.select("opinion_id", "citation_count", F.round("score", 6).alias("score")).join(
        flat.select("opinion_id", F.round("score", 6).alias("parity_score")), "opinion_id")


_ROOT = """SELECT t.opinion_id FROM v_topics t JOIN v_extractions e USING (opinion_id)
  WHERE topic = 'topic 7' AND status = 'completed' ORDER BY created_at DESC, extraction_id DESC LIMIT 1"""
_AROUND = f"""
    WITH RECURSIVE {_walk('o', _OUT, 2, _ROOT)}, {_walk('i', _BACK, 2, _ROOT)},
      around AS (SELECT opinion_id FROM o UNION SELECT opinion_id FROM i)"""


@query("rank_authorities", f"""
    {_AROUND} SELECT s.*, s.opinion_id = ({_ROOT}) AS is_anchor
    FROM ({_score_sql('SELECT opinion_id FROM around', _RANK)}) s""")
def rank_authorities(c):
    nodes, _ = graph.analyze_authority(
        "topic 7", c.view("v_citations"), c.text_view("v_opinions"), c.extractions(), _as_of(), 2)
    return nodes.select("opinion_id", "case_name", "court_id", "citation_count",
                        F.round("score", 6).alias("score"), "is_anchor")


@query("authority_edges", f"""
    {_AROUND} SELECT citing_opinion_id AS source_id, cited_opinion_id AS target_id, citation_type, citation_context
    FROM v_citations WHERE citing_opinion_id IN (SELECT opinion_id FROM around)
      AND cited_opinion_id IN (SELECT opinion_id FROM around)""")
def authority_edges(c):
    _, edges = graph.analyze_authority(
        "topic 7", c.view("v_citations"), c.text_view("v_opinions"), c.extractions(), _as_of(), 2)
    return edges


@query("age_years", f"""
    SELECT opinion_id, round(date_diff('day', date_filed, DATE '{AS_OF}') / 365.25::DOUBLE, 6) AS age FROM v_opinions""")
def ages(c):
    return c.view("v_opinions").select(
        "opinion_id", F.round(age_years(_as_of(), F.col("date_filed")), 6).alias("age"))
