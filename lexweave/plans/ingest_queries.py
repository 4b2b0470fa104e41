"""Landed records to opinions, chunks and reports; sinks of the opinions table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.scoring import court_level, id_from_ref, iso_date, precedential_status
from lexweave.operators import ingest, quality, runs
from lexweave.operators.conflicts import detect_conflicts, opinions_with_extractions, profiles
from lexweave.plans import sqltext as q
from lexweave.plans.catalog import query
from lexweave.plans.conflict_queries import _sql as conflict_sql
from lexweave.plans.corpus import AS_OF
from lexweave.runtime import new_path
from lexweave.sources import landed, sinks

DAY = """CASE WHEN regexp_matches(substr(date_filed, 1, 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
  THEN CAST(substr(date_filed, 1, 10) AS DATE) END"""


def _refs(c):
    refs = F.filter(F.split("sub_refs", ","), lambda r: r != "")
    return landed.explode_sub_opinions(c.view("v_clusters"), refs)


REFS_SQL = """
    SELECT cl.*, TRY_CAST(regexp_extract(rtrim(ref, '/'), '([^/]*)$', 1) AS BIGINT) AS opinion_id
    FROM (SELECT *, unnest(CASE WHEN sub_refs = '' THEN [CAST(cluster_id AS VARCHAR)]
                           ELSE string_split(sub_refs, ',') END) AS ref FROM v_clusters) cl
    WHERE TRY_CAST(regexp_extract(rtrim(ref, '/'), '([^/]*)$', 1) AS BIGINT) IS NOT NULL"""

_CLUSTERS = f"""
    SELECT cluster_id, court_id, d AS filed, CAST(r AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY court_id ORDER BY d DESC NULLS LAST, cluster_id) AS r
      FROM (SELECT *, {DAY} AS d FROM v_clusters)
      WHERE d BETWEEN DATE '2003-01-01' AND DATE '2020-12-31') WHERE r <= 40"""


@query("source_clusters", f"SELECT cluster_id, court_id, filed FROM ({_CLUSTERS})")
def source_clusters(c):
    quota = landed.court_quota(400, 10)
    rows = landed.source_clusters(c.view("v_clusters"), None, "2003-01-01", "2020-12-31", quota)
    return rows.select("cluster_id", "court_id", iso_date(F.col("date_filed")).alias("filed"))


@query("per_court_quota", f"SELECT court_id, count(*) AS n, min(filed) AS oldest FROM ({_CLUSTERS}) GROUP BY court_id")
def per_court_quota(c):
    rows = landed.source_clusters(c.view("v_clusters"), None, "2003-01-01", "2020-12-31", 40)
    return rows.groupBy("court_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(iso_date(F.col("date_filed"))).alias("oldest"))


@query("source_lookup", f"""
    SELECT r.cluster_id, r.opinion_id, r.court_id, k.full_name, l.opinion_id IS NOT NULL AS found
    FROM ({REFS_SQL}) r LEFT JOIN v_landed l USING (opinion_id) LEFT JOIN v_courts k ON k.court_id = r.court_id""")
def source_lookup(c):
    found, missing = landed.source_lookup(
        _refs(c), c.view("v_landed").select("opinion_id"), c.view("v_courts"))
    courts = c.view("v_courts").select("court_id", "full_name")
    hit = found.select("cluster_id", "opinion_id", "court_id", "full_name", F.lit(True).alias("found"))
    lost = missing.join(courts, "court_id", "left").select(
        "cluster_id", "opinion_id", "court_id", "full_name", F.lit(False).alias("found"))
    return hit.unionByName(lost)


@query("explode_sub_opinions", f"SELECT cluster_id, opinion_id FROM ({REFS_SQL})")
def explode_sub_opinions(c):
    return _refs(c).select("cluster_id", "opinion_id")


@query("id_from_ref", """
    SELECT cluster_id, sub_refs, TRY_CAST(regexp_extract(rtrim(sub_refs, '/'), '([^/]*)$', 1) AS BIGINT) AS ref_id
    FROM v_clusters""")
def id_from_refs(c):
    return c.view("v_clusters").select("cluster_id", "sub_refs", id_from_ref(F.col("sub_refs")).alias("ref_id"))


_LEVEL = """CASE WHEN lower(coalesce(short_name, '')) LIKE '%supreme%' AND lower(court_code) NOT LIKE '%state%' THEN 'supreme'
  WHEN lower(coalesce(short_name, '')) LIKE '%circuit%' OR lower(coalesce(short_name, '')) LIKE '%appeals%' THEN 'appellate'
  WHEN court_code IN ('F', 'FD') THEN 'district' WHEN court_code = 'FB' THEN 'bankruptcy'
  WHEN court_code = 'FA' THEN 'appellate' WHEN court_code = 'FSC' THEN 'supreme'
  WHEN court_code = 'S' THEN 'state_trial' WHEN court_code = 'SA' THEN 'state_appellate'
  WHEN court_code = 'SS' THEN 'state_supreme' ELSE 'specialized' END"""
_STATUS = """CASE precedential_status WHEN 'Published' THEN 'published' WHEN 'Unpublished' THEN 'unpublished'
  WHEN 'Errata' THEN 'errata' WHEN 'Separate' THEN 'separate_opinion' WHEN 'In-chambers' THEN 'in_chambers'
  WHEN 'Relating-to' THEN 'relating_to' ELSE 'unknown' END"""


@query("court_level", f"""
    SELECT cluster_id, court_id, {_LEVEL} AS court_level FROM v_clusters JOIN v_courts USING (court_id)""")
def court_levels(c):
    rows = c.view("v_clusters").join(c.view("v_courts"), "court_id")
    return rows.select("cluster_id", "court_id",
                       court_level(F.col("court_code"), F.col("short_name")).alias("court_level"))


@query("precedential_status", f"SELECT cluster_id, {_STATUS} AS status FROM v_clusters")
def precedential_statuses(c):
    return c.view("v_clusters").select(
        "cluster_id", precedential_status(F.col("precedential_status")).alias("status"))


@query("parse_date_prefix", f"SELECT cluster_id, {DAY} AS filed, {DAY} IS NULL AS bad FROM v_clusters")
def parse_date_prefix(c):
    day = iso_date(F.col("date_filed"))
    return c.view("v_clusters").select("cluster_id", day.alias("filed"), day.isNull().alias("bad"))


def _metadata(c):
    """Every landed cluster joined to its opinions and its court."""
    joined = _refs(c).join(c.view("v_landed").select("opinion_id"), "opinion_id").join(
        c.view("v_courts"), "court_id", "left")
    return ingest.normalize_metadata(joined)


_ERROR = f"""CASE WHEN date_filed IS NULL THEN 'Missing date_filed in opinion data'
  WHEN {DAY} IS NULL THEN 'Invalid date_filed format' END"""


@query("normalize_metadata", f"""
    SELECT r.opinion_id, r.cluster_id, r.court_id, r.court_id AS jurisdiction,
      coalesce(nullif(full_name, ''), short_name, 'Unknown Court') AS court_name, {_LEVEL} AS court_level,
      coalesce(case_name, 'Unknown Case') AS case_name, {DAY} AS date_filed, {_STATUS} AS precedential_status,
      coalesce(citation_count, 0) AS citation_count, coalesce(judges, '') AS judges,
      'https://www.courtlistener.com/opinion/' || CAST(r.opinion_id AS VARCHAR) || '/' AS source_url, {_ERROR} AS error
    FROM ({REFS_SQL}) r JOIN v_landed USING (opinion_id) JOIN v_courts k ON k.court_id = r.court_id""")
def normalize_metadata(c):
    return _metadata(c).select(
        "opinion_id", "cluster_id", "court_id", "jurisdiction", "court_name", "court_level", "case_name",
        "date_filed", "precedential_status", "citation_count", "judges", "source_url", "error")


_BEST = f"""CASE WHEN {q.strip('plain_text')} <> '' THEN {q.whitespace(q.zero_width('plain_text'))}
  WHEN {q.strip("coalesce(html_with_citations, '')")} <> '' THEN {q.clean('html_with_citations')}
  WHEN {q.strip("coalesce(html, '')")} <> '' THEN {q.clean('html')} ELSE '' END"""


@query("best_text", f"SELECT opinion_id, {_BEST} AS raw_text FROM v_landed")
def best_text(c):
    return ingest.with_best_text(c.text_view("v_landed")).select("opinion_id", "raw_text")


def _records(c):
    texts = ingest.with_best_text(c.text_view("v_landed")).select("opinion_id", "raw_text")
    return _metadata(c).join(texts, "opinion_id")


def _existing(c):
    """Opinions stored by an earlier run: those of two source languages."""
    return c.table("documents").filter(F.col("lang").isin("de", "es")).select(
        F.col("doc_id").alias("courtlistener_id"))


_EXISTING = "SELECT doc_id AS courtlistener_id FROM documents WHERE lang IN ('de', 'es')"
# Texts without headings and blank lines are one paragraph of one section.
_LANDED = f"""
    WITH RECURSIVE recs AS (
        SELECT r.court_id, r.opinion_id, {_ERROR} AS err, b.raw_text
        FROM ({REFS_SQL}) r JOIN (SELECT opinion_id, {_BEST} AS raw_text FROM v_landed) b USING (opinion_id)),
      good AS (SELECT court_id, opinion_id, raw_text FROM recs WHERE err IS NULL AND raw_text <> ''),
      texts AS (SELECT DISTINCT opinion_id AS doc_id, raw_text AS text FROM good),
      {q.section_ctes('texts', 'doc_id')},
      paras AS (
        SELECT doc_id, section_index, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS part
        FROM (SELECT doc_id, section_index, {q.paragraph_list('substr(text, s + 1, e - s)')} AS l
              FROM spans JOIN texts USING (doc_id))),
      {q.pack_cte('merged', 'paras', 'doc_id, section_index', 2000, '..')},
      blocks AS (
        SELECT doc_id, section_index, block, string_agg(part, chr(10) || chr(10) ORDER BY n) AS body
        FROM merged GROUP BY ALL),
      sents AS (
        SELECT doc_id, section_index, block AS outer_block, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS part
        FROM (SELECT doc_id, section_index, block, {q.sentence_list('body')} AS l FROM blocks WHERE len(body) > 3000)),
      {q.pack_cte('forced', 'sents', 'doc_id, section_index, outer_block', 3000, '.')},
      sizes AS (
        SELECT doc_id, count(*) AS n FROM (
          SELECT doc_id, section_index, block, 0 AS sub FROM blocks WHERE len(body) <= 3000
          UNION ALL SELECT DISTINCT doc_id, section_index, outer_block, block FROM forced) GROUP BY doc_id),
      turns AS (
        SELECT court_id, opinion_id, row_number() OVER (PARTITION BY opinion_id ORDER BY court_id) AS turn,
          opinion_id IN ({_EXISTING}) AS known FROM good),
      kept AS (SELECT court_id, count(CASE WHEN NOT known AND turn = 1 THEN 1 END) AS stored,
                 count(CASE WHEN known OR turn > 1 THEN 1 END) AS skipped FROM turns GROUP BY court_id),
      cut AS (SELECT court_id, sum(n) AS chunks FROM good JOIN sizes ON doc_id = opinion_id GROUP BY court_id)"""
_REPORT = f"""{_LANDED}
    SELECT court_id, count(*) AS fetched, coalesce(max(k.stored), 0) AS stored,
      coalesce(max(k.skipped), 0) AS skipped, count(CASE WHEN err IS NOT NULL OR raw_text = '' THEN 1 END) AS errors,
      CAST(coalesce(max(cut.chunks), 0) AS BIGINT) AS chunks
    FROM recs LEFT JOIN kept k USING (court_id) LEFT JOIN cut USING (court_id) GROUP BY court_id"""


@query("ingest_report", _REPORT)
def ingest_report(c):
    return ingest.ingest_report(_records(c), _existing(c))


@query("ingest_landed", f"""{_LANDED}
    SELECT 'opinions' AS output, court_id, count(*) AS n FROM turns WHERE NOT known AND turn = 1 GROUP BY court_id
    UNION ALL SELECT 'chunks', court_id, CAST(sum(n) AS BIGINT) FROM turns JOIN sizes ON doc_id = opinion_id
    WHERE NOT known AND turn = 1 GROUP BY court_id
    UNION ALL SELECT 'quarantine', court_id, count(*) FROM recs WHERE err IS NOT NULL OR raw_text = '' GROUP BY court_id
    UNION ALL SELECT 'missing', court_id, count(*) FROM ({REFS_SQL}) r
    WHERE opinion_id NOT IN (SELECT opinion_id FROM v_landed) GROUP BY court_id
    UNION ALL SELECT 'report', court_id, count(*) FROM recs GROUP BY court_id""")
def ingest_landed(c):
    """The whole run from landed records to new rows, and how much each of its five outputs holds by court."""
    path = new_path(c.spark, "opinions")
    sinks.append(_existing(c), path)
    clusters = c.view("v_clusters").withColumn("sub_opinions", F.filter(F.split("sub_refs", ","), lambda r: r != ""))
    out = runs.ingest_landed(clusters, c.text_view("v_landed"), c.view("v_courts"), path)
    courts = out["opinions"].select(F.col("courtlistener_id").alias("opinion_id"), "court_id")
    parts = {"opinions": courts, "chunks": out["chunks"].select("opinion_id").join(courts, "opinion_id"),
             "quarantine": out["quarantine"], "missing": out["missing"]}
    counts = [df.groupBy("court_id").agg(F.count(F.lit(1)).alias("n")).withColumn("output", F.lit(name)) for name, df in parts.items()]
    counts.append(out["report"].select("court_id", F.col("fetched").alias("n"), F.lit("report").alias("output")))
    return reduce(DataFrame.unionByName, counts)


@query("ingest_quarantine", f"""
    SELECT opinion_id, cluster_id, coalesce(err, 'No text available') AS error FROM (
      SELECT r.opinion_id, r.cluster_id, {_ERROR} AS err, b.raw_text
      FROM ({REFS_SQL}) r JOIN (SELECT opinion_id, {_BEST} AS raw_text FROM v_landed) b USING (opinion_id))
    WHERE err IS NOT NULL OR raw_text = ''""")
def ingest_quarantine(c):
    _, bad = ingest.split_errors(_records(c))
    return bad.select("opinion_id", "cluster_id", "error")


@query("sink_opinions_insert_ignore", f"""
    SELECT courtlistener_id, min(cluster_id) AS cluster_id FROM (
      SELECT courtlistener_id, -1 AS cluster_id FROM ({_EXISTING})
      UNION ALL
      SELECT opinion_id, cluster_id FROM ({REFS_SQL})) GROUP BY courtlistener_id""")
def sink_opinions_insert_ignore(c):
    path = new_path(c.spark, "opinions")
    sinks.append(_existing(c).withColumn("cluster_id", F.lit(-1).cast("bigint")), path)
    batch = _refs(c).select(F.col("opinion_id").alias("courtlistener_id"), "cluster_id")
    sinks.insert_ignore(batch, path, "courtlistener_id", [F.col("cluster_id")])
    return c.spark.read.parquet(path)


@query("insert_except", f"""
    SELECT opinion_id AS courtlistener_id, min(cluster_id) AS cluster_id FROM ({REFS_SQL})
    WHERE opinion_id NOT IN ({_EXISTING}) GROUP BY opinion_id""")
def insert_except(c):
    batch = _refs(c).select(F.col("opinion_id").alias("courtlistener_id"), "cluster_id")
    return sinks.new_rows(batch, _existing(c), "courtlistener_id", [F.col("cluster_id")])


@query("sink_append", """
    SELECT opinion_id, court_id, status FROM v_opinions JOIN v_extractions USING (opinion_id)
    UNION ALL SELECT opinion_id, court_id, 'pending' FROM v_opinions""")
def sink_append(c):
    path = new_path(c.spark, "rows")
    opinions = c.view("v_opinions").select("opinion_id", "court_id")
    sinks.append(opinions.join(c.view("v_extractions").select("opinion_id", "status"), "opinion_id"), path)
    sinks.append(opinions.withColumn("status", F.lit("pending")), path)
    return c.spark.read.parquet(path)


@query("sink_citations_batch", """
    SELECT citing_opinion_id || '-' || (citation_id % 4) AS citation_id, citing_opinion_id, citation_string, citation_type
    FROM v_citations""")
def sink_citations_batch(c):
    path = new_path(c.spark, "citations")
    edges = c.extractions().select(
        F.col("opinion_id").alias("citing_opinion_id"), F.posexplode("key_authorities").alias("pos", "a"))
    rows = edges.select("citing_opinion_id", "pos", "a.citation_string", "a.citation_type")
    sinks.append(sinks.with_surrogate_id(rows, "citation_id", "citing_opinion_id", "pos").drop("pos"), path)
    return c.spark.read.parquet(path)


def _sample_conflicts(c):
    prof = profiles(opinions_with_extractions(c.view("v_opinions"), c.extractions()))
    return detect_conflicts(prof, F.lit(AS_OF).cast("date")).select("opinion_a_id", "opinion_b_id")


_DELETED = "SELECT doc_id FROM documents WHERE source = 'src1'"


@query("referential_cleanup", conflict_sql(f"""
    SELECT 'opinions' AS table_name, opinion_id AS row_id, CAST(NULL AS BIGINT) AS link FROM v_opinions
    WHERE opinion_id NOT IN ({_DELETED})
    UNION ALL SELECT 'extractions', extraction_id, opinion_id FROM v_extractions WHERE opinion_id NOT IN ({_DELETED})
    UNION ALL SELECT 'citations', citation_id, CASE WHEN cited_opinion_id IN ({_DELETED}) THEN NULL ELSE cited_opinion_id END
    FROM v_citations WHERE citing_opinion_id NOT IN ({_DELETED})
    UNION ALL SELECT 'conflicts', a_id, b_id FROM pairs
    WHERE confidence >= 0.5 AND a_id NOT IN ({_DELETED}) AND b_id NOT IN ({_DELETED})"""))
def referential_cleanup(c):
    deleted = c.table("documents").filter(F.col("source") == "src1").select(F.col("doc_id").alias("opinion_id"))
    kept = sinks.delete_opinions(
        deleted, c.view("v_opinions"), c.view("v_extractions"), c.view("v_citations"), _sample_conflicts(c))

    def rows(name, key, link):
        return kept[name].select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), link.alias("link"))

    return rows("opinions", "opinion_id", F.lit(None).cast("bigint")).unionByName(
        rows("extractions", "extraction_id", F.col("opinion_id"))).unionByName(
        rows("citations", "citation_id", F.col("cited_opinion_id"))).unionByName(
        rows("conflicts", "opinion_a_id", F.col("opinion_b_id")))


def _broken(table: str, rules: dict[str, str]) -> str:
    """Violations of the rules of a table, each by the condition of a violating row."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(CASE WHEN {bad} THEN 1 END) AS violations FROM v_damaged_{table}"
        for rule, bad in rules.items())


def _blank(*columns: str) -> dict[str, str]:
    return {f"{x} non-empty": f"coalesce({x}, '') = ''" for x in columns}


_DAMAGED_SQL = " UNION ALL ".join([
    _broken("extractions", {
        "opinion_id required": "opinion_id IS NULL", **_blank("holding"),
        "holding_confidence in range": "holding_confidence > 1", "disposition required": "disposition IS NULL",
        "disposition in set": "disposition = 'acquitted'", "disposition_confidence in range": "disposition_confidence > 1",
        "status required": "status IS NULL", "status in set": "status = 'lost'",
        "prompt_tokens at least 0": "prompt_tokens < 0", "completion_tokens at least 0": "completion_tokens < 0",
        "opinion_id in opinions": "opinion_id NOT IN (SELECT opinion_id FROM v_opinions)"}),
    _broken("citations", {
        "citing_opinion_id required": "citing_opinion_id IS NULL", **_blank("citation_string"),
        "citation_type required": "citation_type IS NULL", "citation_type in set": "citation_type = 'liked'",
        **_blank("citation_context", "paragraph_context"),
        "citing_opinion_id in opinions": "citing_opinion_id NOT IN (SELECT opinion_id FROM v_opinions)",
        "cited_opinion_id in opinions": "cited_opinion_id NOT IN (SELECT opinion_id FROM v_opinions)"}),
    _broken("conflicts", {
        **_blank("topic", "court_a", "court_b", "description"), "confidence in range": "confidence > 1",
        "status required": "status IS NULL", "status in set": "status = 'guessed'",
        "opinion_a_id in opinions": "opinion_a_id NOT IN (SELECT opinion_id FROM v_opinions)",
        "opinion_b_id in opinions": "opinion_b_id NOT IN (SELECT opinion_id FROM v_opinions)"}),
    "SELECT 'conflicts', 'opinion_a_id, opinion_b_id unique', CAST(sum(n - 1) AS BIGINT) "
    "FROM (SELECT count(*) AS n FROM v_damaged_conflicts GROUP BY opinion_a_id, opinion_b_id)",
    _broken("chunks", {
        "chunk_index at least 0": "chunk_index < 0", **_blank("text"),
        "start_char at least 0": "start_char < 0", "end_char at least 0": "end_char < 0"}),
    _broken("jobs", {"status required": "status IS NULL", "status in set": "status = 'lost'"})])


@query("constraint_report_stored", _DAMAGED_SQL)
def constraint_report_stored(c):
    """The rules of the other five tables and their links, on rows that break every one of them."""
    opinions = c.view("v_opinions").select("opinion_id")
    rows = {t: c.view(f"v_damaged_{t}") for t in ("extractions", "citations", "conflicts", "chunks", "jobs")}
    links = {"extractions": ("opinion_id",), "citations": ("citing_opinion_id", "cited_opinion_id"),
             "conflicts": ("opinion_a_id", "opinion_b_id")}
    reports = [quality.constraint_report(df, t, quality.table_rules(t, df)) for t, df in rows.items()]
    reports += [quality.link_report(rows[t], t, x, opinions, "opinions", "opinion_id") for t, xs in links.items() for x in xs]
    reports.append(quality.uniqueness_report(rows["conflicts"], "conflicts", ["opinion_a_id", "opinion_b_id"]))
    return reduce(DataFrame.unionByName, reports)


@query("constraint_report", """
    SELECT 'opinions' AS table_name, 'court_level in set' AS rule, count(CASE WHEN court_level NOT IN ('supreme', 'appellate', 'district',
      'state_supreme', 'state_appellate', 'state_trial', 'bankruptcy', 'specialized') THEN 1 END) AS violations FROM v_opinions
    UNION ALL SELECT 'opinions', 'court_level required', count(CASE WHEN court_level IS NULL THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'precedential_status required', count(CASE WHEN precedential_status IS NULL THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'opinion_id required', count(CASE WHEN opinion_id IS NULL THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'court_id non-empty', count(CASE WHEN coalesce(court_id, '') = '' THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'case_name non-empty', count(CASE WHEN coalesce(case_name, '') = '' THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'date_filed required', count(CASE WHEN date_filed IS NULL THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'precedential_status in set', count(CASE WHEN precedential_status NOT IN ('published', 'unpublished',
      'errata', 'separate_opinion', 'in_chambers', 'relating_to', 'unknown') THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'raw_text non-empty', count(CASE WHEN coalesce(raw_text, '') = '' THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'citation_count at least 0', count(CASE WHEN citation_count < 0 THEN 1 END) FROM v_opinions
    UNION ALL SELECT 'opinions', 'courtlistener_id unique', count(*) - count(DISTINCT courtlistener_id) FROM v_opinions
    UNION ALL SELECT 'clusters', 'case_name required', count(CASE WHEN case_name IS NULL THEN 1 END) FROM v_clusters
    UNION ALL SELECT 'clusters', 'precedential_status in set', count(CASE WHEN precedential_status NOT IN ('Published',
      'Unpublished', 'Errata', 'Separate', 'In-chambers', 'Relating-to', 'Unknown') THEN 1 END) FROM v_clusters
    UNION ALL SELECT 'clusters', 'citation_count at least 50', count(CASE WHEN citation_count < 50 THEN 1 END) FROM v_clusters
    UNION ALL SELECT 'clusters', 'citation_count in range', count(CASE WHEN NOT citation_count BETWEEN 10 AND 60 THEN 1 END) FROM v_clusters
    UNION ALL SELECT 'clusters', 'court_id, case_name unique', CAST(sum(n - 1) AS BIGINT)
      FROM (SELECT count(*) AS n FROM v_clusters GROUP BY court_id, case_name)""")
def constraint_report(c):
    opinions, clusters = c.text_view("v_opinions"), c.view("v_clusters")
    extra = [
        quality.required("case_name"),
        quality.member("precedential_status", ("Published", "Unpublished", "Errata", "Separate",
                                               "In-chambers", "Relating-to", "Unknown")),
        quality.at_least("citation_count", 50), quality.within("citation_count", 10, 60),
    ]
    return (
        quality.constraint_report(opinions, "opinions", quality.table_rules("opinions", opinions))
        .unionByName(quality.uniqueness_report(opinions, "opinions", ["courtlistener_id"]))
        .unionByName(quality.constraint_report(clusters, "clusters", extra))
        .unionByName(quality.uniqueness_report(clusters, "clusters", ["court_id", "case_name"]))
    )
