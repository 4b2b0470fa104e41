"""Vector search: the query of every label is the mean of its vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions.scoring import iso_date
from lexweave.functions.vectors import clamp_score
from lexweave.operators import search as se
from lexweave.plans.catalog import query
from lexweave.runtime import materialize, new_path
from lexweave.sources import sinks, tables

K = 10


def _vectors(c):
    return c.view("v_vectors")


def _queries(c):
    return se.centroids(_vectors(c), "label").select(F.col("label").alias("query_id"), "embedding")


_ASK = """
    ask AS (
      SELECT label AS query_id, list(x ORDER BY dim) AS v FROM (
        SELECT label, dim, avg(x::DOUBLE) AS x
        FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM v_vectors)
        GROUP BY label, dim) GROUP BY label)"""


def _scored(where: str = "true") -> str:
    return f"""
      scored AS (
        SELECT query_id, opinion_id, embedding::DOUBLE[] AS e, court_id, date_filed,
          list_cosine_similarity(v, embedding::DOUBLE[]) AS score
        FROM ask CROSS JOIN v_vectors WHERE {where}),
      ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, opinion_id) AS rank FROM scored)"""


def _mmr(k: int, weight: float, where: str = "true") -> str:
    """Greedy choice: one row per query and step, with the vectors chosen so far."""
    return f"""
      cand AS (SELECT query_id, opinion_id, e, court_id, date_filed, score, rank FROM ranked WHERE rank <= 50),
      mmr AS (
        SELECT query_id, opinion_id, score, 1 AS position, [opinion_id] AS ids, [e] AS vecs FROM cand WHERE rank = 1
        UNION ALL
        SELECT query_id, opinion_id, score, position, ids, vecs FROM (
          SELECT c.query_id, c.opinion_id, c.score, m.position + 1 AS position,
            list_append(m.ids, c.opinion_id) AS ids, list_append(m.vecs, c.e) AS vecs,
            row_number() OVER (PARTITION BY c.query_id ORDER BY
              {weight} * c.score - {round(1 - weight, 6)} * list_max(list_transform(m.vecs, lambda v: list_cosine_similarity(v, c.e))) DESC,
              c.rank) AS pick
          FROM mmr m JOIN cand c ON c.query_id = m.query_id
          WHERE m.position < {k} AND NOT list_contains(m.ids, c.opinion_id)) WHERE pick = 1)"""


@query("similarity_topk", f"""
    WITH {_ASK.strip()}, {_scored()}
    SELECT CAST(query_id AS BIGINT) AS query_id, opinion_id, CAST(rank AS INT) AS rank, round(score, 6) AS score
    FROM ranked WHERE rank <= {K}""")
def similarity_topk(c):
    return se.similarity_topk(_vectors(c), _queries(c), K).select(
        "query_id", "opinion_id", "rank", F.round("score", 6).alias("score"))


_FILTER = "court_level = 'appellate' AND date_filed >= DATE '2005-01-01'"


@query("similarity_topk_filtered", f"""
    WITH {_ASK.strip()}, {_scored(_FILTER)}
    SELECT CAST(query_id AS BIGINT) AS query_id, opinion_id, CAST(rank AS INT) AS rank, round(score, 6) AS score
    FROM ranked WHERE rank <= {K}""")
def similarity_topk_filtered(c):
    where = tables.search_filter(court_level="appellate", date_after="2005-01-01")
    return se.similarity_topk(_vectors(c), _queries(c), K, where).select(
        "query_id", "opinion_id", "rank", F.round("score", 6).alias("score"))


_MEAN = """
    ask AS (
      SELECT 0 AS query_id, list(x ORDER BY dim) AS v FROM (
        SELECT dim, avg(x::DOUBLE) AS x
        FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM v_vectors) GROUP BY dim))"""


@query("search_one", f"""
    WITH {_MEAN.strip()}, {_scored()} SELECT opinion_id, round(score, 6) AS score FROM ranked WHERE rank <= {K}""")
def search_one(c):
    """One query, the mean of all vectors, answered by a single top-k sort."""
    mean = se.centroids(_vectors(c).withColumn("whole", F.lit(0)), "whole").first().embedding
    found = se.search_one(_vectors(c), mean, K)
    return found.select("opinion_id", F.round("score", 6).alias("score"))


@query("mmr_rerank", f"""
    WITH RECURSIVE {_ASK.strip()}, {_scored()}, {_mmr(5, 0.7)}
    SELECT CAST(query_id AS BIGINT) AS query_id, opinion_id, CAST(position AS INT) AS position, round(score, 6) AS score FROM mmr""")
def mmr_rerank(c):
    return se.mmr_search(_vectors(c), _queries(c), 5, 0.7).select(
        "query_id", "opinion_id", "position", F.round("score", 6).alias("score"))


_ANCHORED = """
    SELECT a.opinion_id AS anchor_id, b.opinion_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine
    FROM v_vectors a CROSS JOIN v_vectors b WHERE a.opinion_id % 100 = 0"""


def _anchored(c):
    anchors = _vectors(c).filter("opinion_id % 100 = 0").select(F.col("opinion_id").alias("anchor_id"), "embedding")
    return se.cosine_matrix(_vectors(c), anchors)


@query("cosine_matrix", f"SELECT anchor_id, opinion_id, round(cosine, 6) AS cosine FROM ({_ANCHORED})")
def cosine_matrix(c):
    """Every vector with an id divisible by 100 against all vectors."""
    return _anchored(c).select("anchor_id", "opinion_id", F.round("cosine", 6).alias("cosine"))


@query("pairwise_diversity", """
    SELECT a.label, round(avg(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS diversity
    FROM v_vectors a JOIN v_vectors b ON a.label = b.label AND a.opinion_id < b.opinion_id GROUP BY a.label""")
def pairwise_diversity(c):
    return se.pairwise_diversity(_vectors(c), "label").select("label", F.round("diversity", 6).alias("diversity"))


@query("search_metrics", f"""
    WITH RECURSIVE {_ASK.strip()}, {_scored()}, {_mmr(K, 0.5)},
      hits AS (SELECT m.query_id, m.opinion_id, c.court_id, c.date_filed, c.e, greatest(0, least(1, m.score)) AS score
               FROM mmr m JOIN cand c ON c.query_id = m.query_id AND c.opinion_id = m.opinion_id),
      spread AS (SELECT a.query_id, avg(1 - list_cosine_similarity(a.e, b.e)) AS d
                 FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.opinion_id < b.opinion_id GROUP BY 1)
    SELECT CAST(query_id AS BIGINT) AS query_id, count(DISTINCT court_id) AS unique_courts,
      round(date_diff('day', min(date_filed), max(date_filed)) / 365.25::DOUBLE, 2) AS date_range_years,
      round(avg(score), 4) AS avg_relevance_score, round(max(d), 4) AS avg_pairwise_diversity
    FROM hits JOIN spread USING (query_id) GROUP BY query_id""")
def search_metrics(c):
    vectors, queries = _vectors(c), _queries(c).select(F.col("query_id").cast("bigint").alias("query_id"), "embedding")
    hits = se.mmr_search(vectors, queries, K, 0.5)
    results = se.search_results(hits, vectors)
    diversity = se.pairwise_diversity(hits.join(vectors.select("opinion_id", "embedding"), "opinion_id"), "query_id")
    return se.search_metrics(results, queries, diversity)


@query("search_hits", f"""
    WITH RECURSIVE {_ASK.strip()}, {_scored(_FILTER + " AND opinion_id IN (SELECT opinion_id FROM v_opinions)")}, {_mmr(5, 0.7)}
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(position AS INT) AS position, opinion_id, o.case_name, o.court_id,
      strftime(o.date_filed, '%Y-%m-%d') AS date_filed, x.holding, round(greatest(0, least(1, score)), 6) AS relevance_score,
      (SELECT string_agg(topic, '|' ORDER BY topic) FROM v_topics t WHERE t.opinion_id = mmr.opinion_id) AS topics
    FROM mmr JOIN v_opinions o USING (opinion_id) JOIN v_extractions x USING (opinion_id)""")
def search_hits(c):
    """A search from the stored points to the rows that a caller gets."""
    points = materialize(se.index_payload(c.extractions(), c.view("v_opinions"), _vectors(c)), "points")
    where = tables.search_filter(court_level="appellate", date_after="2005-01-01")
    return se.search_hits(points, _queries(c), 5, 0.7, where).select(
        "query_id", "position", "opinion_id", "case_name", "court_id", "date_filed", "holding",
        F.round("relevance_score", 6).alias("relevance_score"), F.array_join(F.sort_array("legal_topics"), "|").alias("topics"))


def letter_counts(texts) -> list:
    """Stand-in for an embedding: how often each of 64 characters occurs."""
    return [[float(t.count(chr(64 + d))) for d in range(64)] for t in texts]


_TEXT_ASK = """
    ask AS (
      SELECT opinion_id AS query_id, list_transform(range(64), lambda d: (length(t) - length(replace(t, chr((64 + d)::INT), '')))::DOUBLE) AS v
      FROM (SELECT opinion_id, substr(raw_text, 1, 200) AS t FROM v_opinions WHERE opinion_id % 100 = 0))"""


@query("search_texts", f"""
    WITH {_TEXT_ASK.strip()}, {_scored(_FILTER + " AND opinion_id IN (SELECT opinion_id FROM v_opinions)")}
    SELECT query_id, CAST(rank AS INT) AS position, opinion_id, o.case_name, x.holding, round(greatest(0, least(1, score)), 6) AS relevance_score
    FROM ranked JOIN v_opinions o USING (opinion_id) JOIN v_extractions x USING (opinion_id) WHERE rank <= 5""")
def search_texts(c):
    """Beginnings of opinions as search texts, embedded and answered."""
    points = materialize(se.index_payload(c.extractions(), c.view("v_opinions"), _vectors(c)), "points")
    asked = c.view("v_opinions").filter("opinion_id % 100 = 0").select(
        F.col("opinion_id").alias("query_id"), F.substring("raw_text", 1, 200).alias("text"))
    found = se.search_texts(points, asked, letter_counts, 5, where=tables.search_filter(court_level="appellate", date_after="2005-01-01"))
    return found.select("query_id", "position", "opinion_id", "case_name", "holding", F.round("relevance_score", 6).alias("relevance_score"))


@query("clamp_score", f"SELECT anchor_id, opinion_id, round(greatest(0, least(1, cosine)), 6) AS relevance FROM ({_ANCHORED})")
def clamp_scores(c):
    return _anchored(c).select("anchor_id", "opinion_id", F.round(clamp_score(F.col("cosine")), 6).alias("relevance"))


@query("safe_iso_date", """
    SELECT cluster_id, TRY_CAST(substr(date_filed, 1, 10) AS DATE) AS filed FROM v_clusters""")
def safe_iso_date(c):
    return c.view("v_clusters").select("cluster_id", iso_date(F.col("date_filed")).alias("filed"))


@query("vector_upsert", """
    SELECT opinion_id, court_id, strftime(date_filed, '%Y-%m-%d') AS date_filed,
      CASE WHEN label < 5 THEN 2 ELSE 1 END AS version, round(embedding[1] * CASE WHEN label < 5 THEN -1 ELSE 1 END, 6) AS first_value
    FROM (SELECT * REPLACE (embedding::DOUBLE[] AS embedding) FROM v_vectors)""")
def vector_upsert(c):
    """A second run replaces the points of half of the labels; the table is read back."""
    rows = _vectors(c).withColumn("date_filed", F.date_format("date_filed", "yyyy-MM-dd"))
    old = rows.withColumn("version", F.lit(1))
    new = rows.filter(F.col("label") < 5).withColumn("version", F.lit(2)).withColumn(
        "embedding", F.transform("embedding", lambda x: -x))
    path = new_path(c.spark, "points")
    sinks.write_buckets(old, path, "opinion_id", 8)
    sinks.upsert_buckets(new, path, "opinion_id", "version", 8)
    return c.spark.read.parquet(path).select(
        "opinion_id", "court_id", "date_filed", "version",
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("index_payload", """
    SELECT v.opinion_id, e.holding, o.court_id, strftime(o.date_filed, '%Y-%m-%d') AS date_filed, o.jurisdiction,
      (SELECT string_agg(topic, '|' ORDER BY topic) FROM v_topics t WHERE t.opinion_id = v.opinion_id) AS topics
    FROM v_vectors v JOIN v_opinions o USING (opinion_id) JOIN v_extractions e USING (opinion_id)""")
def index_payload(c):
    points = se.index_payload(c.extractions(), c.view("v_opinions"), _vectors(c))
    return points.select("opinion_id", "holding", "court_id", "date_filed", "jurisdiction",
                         F.array_join(F.sort_array("legal_topics"), "|").alias("topics"))
