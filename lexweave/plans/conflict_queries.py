"""Conflicts between courts, and the evidence behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import conflicts as cf
from lexweave.plans.catalog import query
from lexweave.plans.corpus import AS_OF
from lexweave.runtime import new_path
from lexweave.sources import sinks


def _joined(c):
    return cf.opinions_with_extractions(c.view("v_opinions"), c.extractions())


def _pairs(c):
    """Pairs whose evidence reaches the threshold of a conflict."""
    return cf.conflict_pairs(cf.profiles(_joined(c)), min_confidence=0.5, as_of=_as_of())


def _as_of():
    return F.lit(AS_OF).cast("date")


# Plain restatement: all pairs of a topic, then the evidence, then the choice.
_PAIRS = f"""
    joined AS (SELECT opinion_id, extraction_id, court_id, court_level, case_name, date_filed, disposition
               FROM v_opinions JOIN v_extractions USING (opinion_id) WHERE status = 'completed'),
    overlap AS (
      SELECT a.opinion_id AS a_id, b.opinion_id AS b_id, count(*) AS topic_count, list_sort(list(t.topic)) AS topics
      FROM v_topics t JOIN v_topics u ON t.topic = u.topic
      JOIN joined a ON a.opinion_id = t.opinion_id JOIN joined b ON b.opinion_id = u.opinion_id
      WHERE a.court_id <> b.court_id
        AND (a.date_filed > b.date_filed OR (a.date_filed = b.date_filed AND a.opinion_id < b.opinion_id))
      GROUP BY 1, 2),
    last_types AS (
      SELECT citing_opinion_id AS id, citation_string AS name, arg_max(citation_type, citation_id) AS kind
      FROM v_citations GROUP BY 1, 2),
    shared AS (
      SELECT o.a_id, o.b_id, x.name, x.kind AS kind_a, y.kind AS kind_b,
        (x.kind = 'followed' AND y.kind IN ('distinguished', 'overruled'))
          OR (y.kind = 'followed' AND x.kind IN ('distinguished', 'overruled')) AS clash
      FROM overlap o JOIN last_types x ON x.id = o.a_id JOIN last_types y ON y.id = o.b_id AND y.name = x.name),
    cites AS (SELECT a_id, b_id, count(*) AS cite_count, bool_or(clash) AS clash FROM shared GROUP BY 1, 2),
    judged AS (
      SELECT o.a_id, o.b_id, topic_count, topics, coalesce(cite_count, 0) AS cite_count,
        coalesce(clash, false) AS conflicting,
        coalesce((a.disposition = 'affirmed' AND b.disposition IN ('reversed', 'vacated', 'reversed_in_part'))
          OR (b.disposition = 'affirmed' AND a.disposition IN ('reversed', 'vacated', 'reversed_in_part')), false) AS opposing,
        a.court_id AS court_a, b.court_id AS court_b, a.case_name AS name_a, b.case_name AS name_b,
        a.extraction_id AS extraction_a_id, b.extraction_id AS extraction_b_id, a.disposition AS disp_a, b.disposition AS disp_b, a.court_level AS level_a, b.court_level AS level_b,
        date_diff('day', a.date_filed, DATE '{AS_OF}') / 365.25::DOUBLE AS age_a,
        date_diff('day', b.date_filed, DATE '{AS_OF}') / 365.25::DOUBLE AS age_b
      FROM overlap o JOIN joined a ON a.opinion_id = o.a_id JOIN joined b ON b.opinion_id = o.b_id
      LEFT JOIN cites c ON c.a_id = o.a_id AND c.b_id = o.b_id),
    weights AS (SELECT * FROM (VALUES ('supreme', 1.0), ('appellate', 0.8), ('state_supreme', 0.7), ('state_appellate', 0.5),
      ('district', 0.4), ('state_trial', 0.3), ('bankruptcy', 0.2), ('specialized', 0.3)) w(level, weight)),
    pairs AS (
      SELECT j.*, round(least(1.0::DOUBLE, CASE WHEN opposing THEN 0.30::DOUBLE ELSE 0 END
          + CASE WHEN conflicting THEN 0.25::DOUBLE ELSE 0 END
          + least(topic_count / 5.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE
          + least(cite_count / 3.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE
          + (wa.weight::DOUBLE + wb.weight::DOUBLE) / 2.0::DOUBLE * 0.10::DOUBLE
          + greatest(0.0::DOUBLE, 1.0::DOUBLE - (age_a + age_b) / 2.0::DOUBLE / 20.0::DOUBLE) * 0.05::DOUBLE), 4) AS confidence,
        array_to_string(topics[1:3], ', ') AS topic,
        concat_ws('; ', CASE WHEN opposing THEN court_a || ' (' || name_a || ') reached ' || disp_a || ' while '
            || court_b || ' (' || name_b || ') reached ' || disp_b END,
          CASE WHEN conflicting THEN court_a || ' and ' || court_b || ' treat shared authorities differently' END) AS description
      FROM judged j JOIN weights wa ON wa.level = level_a JOIN weights wb ON wb.level = level_b
      WHERE opposing OR conflicting)"""


def _sql(select: str) -> str:
    return f"WITH {_PAIRS.strip()}\n{select}"


@query("opinions_with_extractions", """
    SELECT opinion_id, extraction_id, court_id, court_level, case_name, date_filed, disposition
    FROM v_opinions JOIN v_extractions USING (opinion_id) WHERE status = 'completed'""")
def opinions_with_extractions(c):
    return _joined(c).select(
        "opinion_id", "extraction_id", "court_id", "court_level", "case_name", "date_filed", "disposition")


@query("cross_court_pairs", _sql("SELECT a_id, b_id, court_a, court_b FROM pairs WHERE confidence >= 0.5"))
def cross_court_pairs(c):
    return _pairs(c).select(
        F.col("a.opinion_id").alias("a_id"), F.col("b.opinion_id").alias("b_id"),
        F.col("a.court_id").alias("court_a"), F.col("b.court_id").alias("court_b"))


@query("court_pair_filter", _sql("""
    SELECT a_id, b_id, court_a, court_b, topic, confidence FROM pairs
    WHERE confidence >= 0.3 AND least(court_a, court_b) || greatest(court_a, court_b) IN ('ca5ca9', 'ca1scotus')"""))
def court_pair_filter(c):
    found = cf.detect_conflicts(
        cf.profiles(_joined(c)), _as_of(), court_pairs=[("ca9", "ca5"), ("scotus", "ca1")], min_confidence=0.3)
    return found.select(F.col("opinion_a_id").alias("a_id"), F.col("opinion_b_id").alias("b_id"),
                        "court_a", "court_b", "topic", "confidence")


@query("topic_overlap", _sql("SELECT a_id, b_id, CAST(topic_count AS INT) AS topic_count, topic FROM pairs WHERE confidence >= 0.5"))
def topic_overlap(c):
    return _pairs(c).select(
        F.col("a.opinion_id").alias("a_id"), F.col("b.opinion_id").alias("b_id"),
        F.size("shared_topics").alias("topic_count"), "topic")


@query("shared_authorities", _sql("""
    SELECT p.a_id, p.b_id, s.name, s.kind_a, s.kind_b FROM pairs p JOIN shared s ON s.a_id = p.a_id AND s.b_id = p.b_id WHERE confidence >= 0.5"""))
def shared_authorities(c):
    return cf.shared_authorities(cf.profiles(_joined(c)), _as_of())


@query("opposing_dispositions", _sql("SELECT a_id, b_id, disp_a, disp_b FROM pairs WHERE confidence >= 0.5 AND opposing"))
def opposing_dispositions(c):
    return _pairs(c).filter("opposing").select(
        F.col("a.opinion_id").alias("a_id"), F.col("b.opinion_id").alias("b_id"),
        F.col("a.disposition").alias("disp_a"), F.col("b.disposition").alias("disp_b"))


@query("conflicting_citation_types", _sql("SELECT a_id, b_id FROM pairs WHERE confidence >= 0.5 AND conflicting"))
def conflicting_citation_types(c):
    return _pairs(c).filter("conflicting").select(
        F.col("a.opinion_id").alias("a_id"), F.col("b.opinion_id").alias("b_id"))


@query("intersections", _sql("SELECT a_id, b_id, len(topics) AS topics, cite_count AS cites FROM pairs WHERE confidence >= 0.5"))
def intersections(c):
    return _pairs(c).select(
        F.col("a.opinion_id").alias("a_id"), F.col("b.opinion_id").alias("b_id"),
        F.size("shared_topics").cast("bigint").alias("topics"), F.size("shared_cites").cast("bigint").alias("cites"))


@query("last_type_per_authority", """
    SELECT citing_opinion_id, citation_string, arg_max(citation_type, citation_id) AS citation_type
    FROM v_citations GROUP BY 1, 2""")
def last_type_per_authority(c):
    return cf.last_type_per_authority(c.view("v_citations"))


@query("conflict_description", _sql("SELECT a_id, b_id, description FROM pairs WHERE confidence >= 0.5"))
def conflict_description(c):
    found = cf.detect_conflicts(cf.profiles(_joined(c)), _as_of())
    return found.select(F.col("opinion_a_id").alias("a_id"), F.col("opinion_b_id").alias("b_id"), "description")


@query("conflict_confidence", _sql("SELECT a_id, b_id, confidence FROM pairs WHERE confidence >= 0.5"))
def conflict_confidence(c):
    return _pairs(c).select(
        F.col("a.opinion_id").alias("a_id"), F.col("b.opinion_id").alias("b_id"), "confidence")


_RANKED = """SELECT a_id AS opinion_a_id, b_id AS opinion_b_id, topic, court_a, court_b, description, confidence,
  'detected' AS status, extraction_a_id, extraction_b_id, TIMESTAMP '2025-01-02 03:04:05' AS detected_at FROM pairs WHERE confidence >= 0.5"""


@query("rank_conflicts", _sql(_RANKED))
def rank_conflicts(c):
    return cf.ranked_conflicts(
        cf.profiles(_joined(c)), _as_of(), detected_at=F.lit("2025-01-02 03:04:05").cast("timestamp_ntz"))


@query("conflict_summary", _sql("""
    SELECT court_1, court_2, topic, CAST(rank AS INT) AS rank, a_id AS opinion_a_id, b_id AS opinion_b_id, confidence, n_conflicts FROM (
      SELECT *, count(*) OVER (PARTITION BY court_1, court_2, topic) AS n_conflicts,
        row_number() OVER (PARTITION BY court_1, court_2, topic ORDER BY confidence DESC, a_id, b_id) AS rank
      FROM (SELECT *, least(court_a, court_b) AS court_1, greatest(court_a, court_b) AS court_2 FROM pairs WHERE confidence >= 0.5))
    WHERE rank <= 3"""))
def conflict_summary(c):
    """The three strongest conflicts of every two courts and topic."""
    return cf.strongest_conflicts(cf.profiles(_joined(c)), _as_of()).select(
        "court_1", "court_2", "topic", "rank", "opinion_a_id", "opinion_b_id", "confidence", "n_conflicts")


@query("conflict_view", _sql(f"""
    SELECT r.opinion_a_id || '-' || r.opinion_b_id AS conflict_id, r.topic, r.confidence,
      a.case_name AS case_name_a, a.date_filed AS date_filed_a, x.holding AS holding_a,
      b.case_name AS case_name_b, b.date_filed AS date_filed_b, y.holding AS holding_b
    FROM ({_RANKED}) r JOIN v_opinions a ON a.opinion_id = r.opinion_a_id JOIN v_opinions b ON b.opinion_id = r.opinion_b_id
    JOIN v_extractions x ON x.opinion_id = r.opinion_a_id JOIN v_extractions y ON y.opinion_id = r.opinion_b_id"""))
def conflict_view(c):
    return cf.detect_conflict_view(cf.profiles(_joined(c)), c.view("v_extractions"), _as_of())


@query("sink_conflicts", _sql("""
    SELECT a_id AS opinion_a_id, b_id AS opinion_b_id, confidence FROM pairs
    WHERE confidence >= 0.45 AND (confidence >= 0.5 OR court_a IN ('ca5', 'ca9') AND court_b IN ('ca5', 'ca9'))"""))
def sink_conflicts(c):
    """Two overlapping runs fill the conflicts table; a pair known to it is skipped."""
    prof, path = cf.profiles(_joined(c)), new_path(c.spark, "conflicts")
    keys, courts = ["opinion_a_id", "opinion_b_id"], [("ca5", "ca9")]
    first = cf.detect_conflicts(prof, _as_of())
    sinks.append(cf.one_per_pair(first, prof), path)
    second = cf.detect_conflicts(prof, _as_of(), court_pairs=courts, min_confidence=0.45)
    sinks.insert_ignore(second, path, keys, [F.desc("confidence")], cf.of_courts(courts))
    return c.spark.read.parquet(path).select(*keys, "confidence")
