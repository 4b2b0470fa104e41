"""Views that turn the given tables into courts, opinions, extractions and links.

The text of every view runs in Spark and, inlined, in the comparing engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.runtime import spread

AS_OF = "2024-12-31"

_COURTS = "scotus,ca1,ca2,ca3,ca5,ca9,ca11,nysd,cand,texsup"
_LEVELS = (
    "supreme,appellate,appellate,appellate,appellate,appellate,appellate,district,district,state_supreme"
)
_STATUSES = "published,unpublished,errata,separate_opinion,in_chambers,relating_to,unknown"


def _pick(words: str, index: str) -> str:
    n = len(words.split(","))
    return f"split_part('{words}', ',', CAST({index} % {n} + 1 AS INT))"


def _filed(key: str) -> str:
    return f"date '2000-01-01' + CAST({key} * 37 % 8766 AS INT)"


_VERSIONS = f"""
    SELECT doc_id * 3 + k AS extraction_id, doc_id AS opinion_id,
      date '2024-01-01' + CAST((doc_id + k * 7) % 30 AS INT) AS created_at,
      concat('Version ', CAST(k AS STRING), ' for ', CAST(doc_id AS STRING), ' by ', source) AS holding,
      {_pick('pending,completed,failed,needs_review', '(doc_id + k)')} AS status
    FROM documents CROSS JOIN (VALUES (0),(1),(2)) t(k)"""

VIEWS = {
    "v_opinions": f"""
        SELECT doc_id AS opinion_id, doc_id + 70000 AS courtlistener_id,
          {_pick(_COURTS, 'doc_id')} AS court_id, {_pick(_COURTS, 'doc_id')} AS jurisdiction,
          {_pick(_LEVELS, 'doc_id')} AS court_level,
          concat('Party ', CAST(doc_id % 50 AS STRING), ' v. Party ', CAST(doc_id % 7 AS STRING)) AS case_name,
          {_filed('doc_id')} AS date_filed,
          {_pick(_STATUSES, 'doc_id')} AS precedential_status, doc_id % 100 AS citation_count,
          concat('See ', CAST(doc_id % 600 + 1 AS STRING), ' U.S. ', CAST(doc_id * 7 % 900 + 1 AS STRING),
                 ' (', CAST(1950 + doc_id % 70 AS STRING), '). ', text) AS raw_text
        FROM documents""",
    "v_extractions": f"""
        SELECT doc_id AS opinion_id, doc_id * 3 AS extraction_id,
          concat('Held in matter ', CAST(doc_id AS STRING), ' on the question of ', lang) AS holding,
          CAST(doc_id % 101 AS DOUBLE) / 100 AS holding_confidence,
          {_pick('affirmed,reversed,remanded,vacated,dismissed,affirmed_in_part,reversed_in_part',
                 'doc_id * 11')} AS disposition,
          date '2024-01-01' + CAST(doc_id % 30 AS INT) AS created_at,
          CASE WHEN doc_id % 101 < 30 THEN 'needs_review' ELSE 'completed' END AS status
        FROM documents""",
    "v_topics": """
        SELECT DISTINCT doc_id AS opinion_id,
          concat('topic ', CAST((doc_id * (k + 3) + k * 5) % 40 AS STRING)) AS topic
        FROM documents CROSS JOIN (VALUES (0),(1),(2)) t(k)""",
    "v_citations": f"""
        SELECT doc_id * 4 + k AS citation_id, doc_id AS citing_opinion_id,
          CASE WHEN k = 3 THEN NULL ELSE (doc_id * 7 + k * 13 + 1) % (SELECT count(*) FROM documents) END
            AS cited_opinion_id,
          concat(CAST((doc_id * 7 + k * 13 + 1) % 60 + 1 AS STRING), ' U.S. ',
                 CAST((doc_id * 7 + k * 13 + 1) % 60 * 7 + 1 AS STRING)) AS citation_string,
          {_pick('followed,distinguished,overruled,cited', '(doc_id + k)')} AS citation_type,
          concat('context ', CAST(k AS STRING)) AS citation_context
        FROM documents CROSS JOIN (VALUES (0),(1),(2),(3)) t(k)""",
    "v_courts": """
        SELECT * FROM (VALUES
          ('scotus','Supreme Court of the United States','Supreme Court','FSC'),
          ('ca1','Court of Appeals for the First Circuit','First Circuit','FA'),
          ('ca2',NULL,'Second Circuit','FA'),
          ('ca3','Court of Appeals for the Third Circuit','Third Circuit','F'),
          ('ca5','Court of Appeals for the Fifth Circuit','Fifth Circuit','FA'),
          ('ca9','Court of Appeals for the Ninth Circuit','Ninth Circuit','FA'),
          ('ca11',NULL,'Eleventh Circuit','FA'),
          ('nysd','Southern District of New York','S.D. New York','FD'),
          ('cand',NULL,NULL,'FD'),
          ('texsup','Texas Supreme Court','Texas Supreme Court','S')
        ) t(court_id, full_name, short_name, court_code)""",
    "v_clusters": f"""
        SELECT doc_id AS cluster_id, {_pick(_COURTS, 'doc_id')} AS court_id,
          CASE WHEN doc_id % 11 = 0 THEN NULL
               ELSE concat('Party ', CAST(doc_id % 50 AS STRING), ' v. Party ', CAST(doc_id % 7 AS STRING))
          END AS case_name,
          CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'bad-date'
               ELSE concat(CAST({_filed('doc_id')} AS STRING), 'T00:00:00') END AS date_filed,
          {_pick('Published,Unpublished,Errata,Separate,In-chambers,Relating-to,Other', 'doc_id')}
            AS precedential_status,
          CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 100 END AS citation_count,
          CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('Judge ', CAST(doc_id % 20 AS STRING)) END AS judges,
          CASE WHEN doc_id % 5 = 0 THEN ''
               WHEN doc_id % 5 = 1 THEN concat('https://x.test/opinions/', CAST(doc_id AS STRING),
                                               '/,https://x.test/opinions/none/')
               WHEN doc_id % 5 = 2 THEN concat(CAST(doc_id AS STRING), ',', CAST(doc_id + 1 AS STRING))
               ELSE CAST(doc_id AS STRING) END AS sub_refs
        FROM documents""",
    "v_landed": """
        SELECT doc_id AS opinion_id,
          CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN concat(' ', chr(10)) ELSE text END
            AS plain_text,
          CASE WHEN doc_id % 4 = 1 THEN concat('<div>', text, '</div><br/>  Smith &amp; Co <b>held</b> ')
          END AS html_with_citations,
          CASE WHEN doc_id % 8 = 0 THEN concat('<p>', text, '</p>') END AS html
        FROM documents""",
    "v_authorities": f"""
        SELECT doc_id * 3 + k AS authority_id, doc_id AS citing_opinion_id,
          CASE WHEN k = 2 THEN '999 Fake 111'
               ELSE concat(CAST((doc_id + k) % 650 + 1 AS STRING), ' U.S. ',
                           CAST((doc_id + k) * 7 % 900 + 1 AS STRING), ' (',
                           CAST(1995 + (doc_id + k) % 30 AS STRING), ')') END AS citation_string,
          CASE WHEN (doc_id + k) % 4 = 0 THEN NULL
               ELSE concat('Party ', CAST((doc_id + k) % 60 AS STRING), ' v. Party ',
                           CAST((doc_id + k) % 7 AS STRING)) END AS case_name,
          {_pick('followed,distinguished,overruled,cited', '(doc_id + k)')} AS citation_type
        FROM documents CROSS JOIN (VALUES (0),(1),(2)) t(k)""",
    "v_raw_json": """
        SELECT doc_id AS opinion_id, CASE
          WHEN length(text) % 9 = 0 THEN 'not json {' WHEN length(text) % 9 = 1 THEN '[1, 2]'
          ELSE concat('{', CASE WHEN length(text) % 9 = 2 THEN '' ELSE '"holding": "The court held X.", ' END,
            '"holding_confidence": ',
            CASE WHEN length(text) % 9 = 3 THEN '1.5' WHEN length(text) % 9 = 8 THEN '"0.5"'
                 ELSE concat('0.', CAST(length(text) % 90 + 10 AS STRING)) END,
            ', "disposition": "', CASE WHEN length(text) % 9 = 4 THEN 'acquitted' ELSE 'affirmed' END,
            '", "disposition_confidence": 0.9, "legal_standard": null, "key_authorities": [{"citation_string": "',
            CASE WHEN length(text) % 9 = 5 THEN 'not a citation' ELSE '554 U.S. 570 (2008)' END,
            '", "case_name": null, "citation_context": "c", "citation_type": "followed", "paragraph_context": "p"}], "legal_topics": [',
            CASE WHEN length(text) % 9 = 6 THEN '' ELSE '"constitutional law"' END,
            '], "extraction_model": "m1", "extraction_timestamp": "2025-01-15T12:00:00Z", "raw_prompt_tokens": 10, "raw_completion_tokens": 5}')
          END AS raw
        FROM documents""",
    "v_headed_docs": """
        SELECT doc_id, concat('Intro text here.', chr(10), chr(10), 'I. BACKGROUND', chr(10), chr(10),
          replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10), 'ANALYSIS', chr(10), chr(10),
          'See Heller, 128 S. Ct. 2783 (2008). It holds. Per 554 U.S. 570. Again 128 S. Ct. 2783, 2790.',
          chr(10), chr(10), text, chr(10), chr(10),
          'Jones, J., dissenting.', chr(10), chr(10), 'I respectfully dissent.') AS text
        FROM documents""",
    "v_vectors": f"""
        SELECT vec_id AS opinion_id, embedding, label, {_pick(_COURTS, 'vec_id')} AS court_id,
          {_pick(_COURTS, 'vec_id')} AS jurisdiction,
          {_pick(_LEVELS, 'vec_id')} AS court_level, {_filed('vec_id')} AS date_filed
        FROM embeddings""",
    "v_extraction_versions": _VERSIONS,
    "v_begun_versions": _VERSIONS + " WHERE lang <> 'fr'",
    # rows of the stored tables that break their rules now and then
    "v_damaged_extractions": f"""
        SELECT CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id + 20 END AS opinion_id,
          CASE WHEN doc_id % 13 = 0 THEN '' ELSE source END AS holding,
          CAST(doc_id % 101 AS DOUBLE) / 90 AS holding_confidence, CAST(doc_id % 101 AS DOUBLE) / 95 AS disposition_confidence,
          nullif({_pick('affirmed,reversed,acquitted,none', 'doc_id')}, 'none') AS disposition,
          nullif({_pick('completed,failed,lost,none', 'doc_id')}, 'none') AS status,
          doc_id % 7 - 1 AS prompt_tokens, doc_id % 5 - 1 AS completion_tokens
        FROM documents""",
    "v_damaged_citations": f"""
        SELECT CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id + 20 END AS citing_opinion_id,
          CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 2 END AS cited_opinion_id,
          CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(CAST(doc_id AS STRING), ' U.S. 1') END AS citation_string,
          nullif({_pick('followed,cited,liked,none', 'doc_id')}, 'none') AS citation_type,
          CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS citation_context,
          CASE WHEN doc_id % 19 = 0 THEN '' ELSE lang END AS paragraph_context
        FROM documents""",
    "v_damaged_conflicts": f"""
        SELECT CAST(floor(doc_id / 2) * 2 + 20 AS BIGINT) AS opinion_a_id, CAST(floor(doc_id / 2) * 2 + 21 AS BIGINT) AS opinion_b_id,
          nullif(source, 'src1') AS topic, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'ca1' END AS court_a,
          CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'ca2' END AS court_b,
          CASE WHEN doc_id % 19 = 0 THEN '' ELSE lang END AS description,
          CAST(doc_id % 101 AS DOUBLE) / 90 AS confidence,
          nullif({_pick('detected,guessed,none', 'doc_id')}, 'none') AS status
        FROM documents""",
    "v_damaged_chunks": """
        SELECT doc_id % 5 - 1 AS chunk_index, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text,
          doc_id % 7 - 1 AS start_char, doc_id % 11 - 1 AS end_char
        FROM documents""",
    "v_damaged_jobs": f"""
        SELECT nullif({_pick('completed,failed,lost,none', 'event_id')}, 'none') AS status FROM events""",
    "v_job_items": """
        SELECT event_id, CAST(floor(event_id / 10) AS BIGINT) AS job_id, event_id % 200 AS opinion_id, ts,
          CASE WHEN CAST(floor(event_id / 10) AS BIGINT) % 13 = 0 OR event_id % 17 = 0 THEN 'failed'
               ELSE 'ok' END AS outcome,
          event_id % 7 * 100 AS prompt_tokens, event_id % 5 * 10 AS completion_tokens,
          concat('model-', event_type) AS extraction_model
        FROM events""",
}

_BASE = ("documents", "pages", "embeddings", "events")
_VALUES = re.compile(r"CROSS JOIN \(VALUES ([()0-9,]+)\) t\(k\)")


def _names(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """The statement with the views it names as leading common table expressions."""
    used = _names(sql)
    if not used:
        return sql
    heads = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads},\n{body[len('WITH'):]}"
    return f"WITH {heads}\n{body}"


def _spark_text(sql: str) -> str:
    """The small constant lists of a view become an explode instead of a join."""
    lists = _VALUES.sub(
        lambda m: "LATERAL VIEW explode(array(" + re.sub(r"[()]", "", m.group(1)) + ")) t AS k", sql)
    for table in _BASE:
        lists = re.sub(rf"\bFROM {table}\b", f"FROM lexweave_{table}", lists)
    return lists


class Corpus:
    """Tables and views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str, spread_by: str | None = None) -> DataFrame:
        """A view; ``spread_by`` names the base key for CPU-bound text work on it."""
        sql = VIEWS[name]
        for table in _BASE:
            if re.search(rf"\bFROM {table}\b", sql):
                base = self.table(table)
                if spread_by:
                    base = spread(base, spread_by)
                base.createOrReplaceTempView(f"lexweave_{table}")
        return self.spark.sql(_spark_text(sql))

    def text_view(self, name: str) -> DataFrame:
        return self.view(name, spread_by="doc_id")

    def pages(self) -> DataFrame:
        return spread(self.table("pages"), "page_id")

    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    def extractions(self) -> DataFrame:
        """Extractions with their topics and authorities as arrays within the row."""
        d = F.col("opinion_id")
        topics = [F.concat(F.lit("topic "), ((d * (k + 3) + k * 5) % 40).cast("string")) for k in range(3)]
        types = F.array(*[F.lit(t) for t in ("followed", "distinguished", "overruled", "cited")])

        def authority(k: int):
            n = (d * 7 + k * 13 + 1) % 60
            return F.struct(
                F.concat((n + 1).cast("string"), F.lit(" U.S. "), (n * 7 + 1).cast("string")).alias("citation_string"),
                F.get(types, ((d + k) % 4).cast("int")).alias("citation_type"),
            )

        return self.view("v_extractions").withColumns({
            "legal_topics": F.array_distinct(F.array(*topics)),
            "key_authorities": F.array(*[authority(k) for k in range(4)]),
        })
