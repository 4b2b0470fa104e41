"""Model stages with stand-ins that read their prompts, and checks on output."""

from __future__ import annotations

import json
import re
from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from lexweave.functions.intelligence import (
    json_kind, parse_json, read_intelligence, review_status, rule_violations, schema_issues,
)
from lexweave.operators import inference as inf
from lexweave.operators import runs
from lexweave.operators import validation as va
from lexweave.plans.catalog import query
from lexweave.sources import sinks

SYSTEM = "Read the opinion and answer with one JSON object."
USER = "Case: {case_name}\nCourt: {court}\n---\n{opinion_text}\n---\nAnswer now."
CORRECTIVE = "The answer was invalid: {error_message}\nIt was:\n{previous_output}\nAnswer again."

# Rules of the comparison in terms of the JSON functions of the other engine.
_SCHEMA = """
    CASE WHEN json_extract(raw, '$.holding') IS NULL THEN 'holding: Field required'
      WHEN TRY_CAST(json_extract_string(raw, '$.holding_confidence') AS DOUBLE) > 1
        THEN 'holding_confidence: Input should be less than or equal to 1'
      WHEN json_extract_string(raw, '$.disposition') NOT IN ('affirmed', 'reversed', 'remanded', 'vacated', 'dismissed',
        'affirmed_in_part', 'reversed_in_part')
        THEN 'disposition: Input should be one of affirmed, reversed, remanded, vacated, dismissed, affirmed_in_part, reversed_in_part'
      WHEN json_array_length(raw, '$.legal_topics') = 0 THEN 'legal_topics: List should have at least 1 item' END"""
_RULES = """
    CASE WHEN NOT regexp_matches(json_extract_string(raw, '$.key_authorities[0].citation_string'), '[0-9]+ U\\.S\\. [0-9]+')
      THEN 'key_authorities[0]: citation_string ''' || json_extract_string(raw, '$.key_authorities[0].citation_string')
        || ''' does not match legal citation regex' END"""
_JSON = """CASE WHEN NOT json_valid(raw) THEN 'Invalid JSON'
    WHEN json_type(raw) = 'ARRAY' THEN 'Expected JSON object, got list' END"""
_OBJECTS = "(SELECT * FROM v_raw_json WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')"
# Invalid text must not reach the JSON functions, so it is replaced by an empty object for them.
_JUDGED = f"""
    SELECT opinion_id, error, stage, CASE WHEN stage = 'ok' THEN
        CASE WHEN CAST(json_extract_string(safe, '$.holding_confidence') AS DOUBLE) < 0.3 THEN 'needs_review' ELSE 'completed' END
      END AS status, safe
    FROM (
      SELECT opinion_id, safe, CASE WHEN j IS NOT NULL THEN j WHEN s IS NOT NULL THEN 'Schema validation failed: ' || s
          WHEN r IS NOT NULL THEN 'Business rule violations: ' || r END AS error,
        CASE WHEN j IS NOT NULL THEN 'json' WHEN s IS NOT NULL THEN 'schema' WHEN r IS NOT NULL THEN 'rules' ELSE 'ok' END AS stage
      FROM (
        SELECT opinion_id, raw AS safe, j, {_SCHEMA} AS s, {_RULES} AS r
        FROM (SELECT opinion_id, CASE WHEN {_JSON} IS NULL THEN raw ELSE '{{}}' END AS raw, {_JSON} AS j FROM v_raw_json)))"""


@query("json_object_check", f"SELECT opinion_id, {_JSON} AS error FROM v_raw_json")
def json_object_check(c):
    return c.text_view("v_raw_json").select("opinion_id", va.json_error(parse_json(F.col("raw"))).alias("error"))


def _objects(c):
    rows = c.text_view("v_raw_json").withColumn("value", parse_json(F.col("raw")))
    return rows.filter(json_kind(F.col("value")) == "dict")


@query("schema_validate", f"SELECT opinion_id, coalesce({_SCHEMA}, '') AS issues FROM {_OBJECTS}")
def schema_validate(c):
    return _objects(c).select("opinion_id", F.array_join(schema_issues(F.col("value")), "; ").alias("issues"))


@query("business_rules", f"""
    SELECT opinion_id, concat_ws('; ',
      CASE WHEN TRY_CAST(json_extract_string(raw, '$.holding_confidence') AS DOUBLE) > 1
        THEN 'holding_confidence ' || json_extract_string(raw, '$.holding_confidence') || ' not in [0.0, 1.0]' END,
      CASE WHEN json_extract_string(raw, '$.disposition') = 'acquitted' THEN 'Invalid disposition: acquitted' END,
      CASE WHEN json_array_length(raw, '$.legal_topics') = 0 THEN 'legal_topics must contain at least one entry' END,
      {_RULES}) AS violations FROM {_OBJECTS}""")
def business_rules(c):
    intel = _objects(c).select("opinion_id", read_intelligence(F.col("value")).alias("intel"))
    return intel.select("opinion_id", F.array_join(rule_violations(F.col("intel")), "; ").alias("violations"))


@query("review_status", """
    SELECT opinion_id, CASE WHEN holding_confidence < 0.3 THEN 'needs_review' ELSE 'completed' END AS status FROM v_extractions""")
def review_statuses(c):
    return c.view("v_extractions").select("opinion_id", review_status(F.col("holding_confidence")).alias("status"))


@query("validate_extractions", f"SELECT opinion_id, error, stage, status FROM ({_JUDGED})")
def validate_extractions(c):
    return va.judge(c.text_view("v_raw_json")).select("opinion_id", "error", "stage", "status")


@query("attach_run_metadata", f"""
    SELECT opinion_id, 'gpt-x' AS extraction_model, '2025-01-15T12:00:00Z' AS extraction_timestamp,
      CAST(len(safe) AS BIGINT) AS prompt_tokens, 7::BIGINT AS completion_tokens FROM ({_JUDGED}) WHERE stage = 'ok'""")
def attach_run_metadata(c):
    good, _ = va.split_judged(va.judge(c.text_view("v_raw_json")))
    patched = va.attach_run_metadata(
        good, F.lit("gpt-x"), F.lit("2025-01-15T12:00:00Z"), F.length("raw").cast("bigint"), F.lit(7).cast("bigint"))
    return patched.select("opinion_id", "extraction_model", "extraction_timestamp", "prompt_tokens", "completion_tokens")


@query("sink_extraction_outcomes", f"""
    SELECT opinion_id, CASE WHEN stage = 'ok' THEN 'The court held X.' ELSE 'Extraction failed' END AS holding,
      CASE WHEN stage = 'ok' THEN CAST(json_extract_string(safe, '$.holding_confidence') AS DOUBLE) ELSE 0.0 END AS holding_confidence,
      CASE WHEN stage = 'ok' THEN 'affirmed' ELSE 'dismissed' END AS disposition,
      CASE WHEN stage = 'ok' THEN 'constitutional law' ELSE 'unknown' END AS topics,
      CASE WHEN stage = 'ok' THEN status ELSE 'failed' END AS status FROM ({_JUDGED})""")
def sink_extraction_outcomes(c):
    outcomes = va.judge(c.text_view("v_raw_json")).withColumns({
        "extraction_model": F.lit("m"), "prompt_tokens": F.lit(1), "completion_tokens": F.lit(1)})
    return sinks.extraction_rows(outcomes).select(
        "opinion_id", "holding", "holding_confidence", "disposition",
        F.array_join("legal_topics", "|").alias("topics"), "status")


def _docs(c):
    """Opinions for the model stages; those of appellate courts name their model."""
    return c.text_view("v_opinions").select(
        "opinion_id", "case_name", F.col("court_id").alias("court"), "raw_text",
        F.when(F.col("court_level") == "appellate", "claude-x").alias("extraction_model"))


@query("build_prompts", """
    SELECT opinion_id, 'Read the opinion and answer with one JSON object.' AS system_prompt,
      'Case: ' || case_name || chr(10) || 'Court: ' || court_id || chr(10) || '---' || chr(10) || raw_text || chr(10)
        || '---' || chr(10) || 'Answer now.' AS user_prompt FROM v_opinions""")
def build_prompts(c):
    return inf.build_prompts(_docs(c), SYSTEM, USER).select("opinion_id", "system_prompt", "user_prompt")


@query("build_corrective_prompts", f"""
    SELECT opinion_id, 'The answer was invalid: ' || error || chr(10) || 'It was:' || chr(10) || raw || chr(10) || 'Answer again.'
      AS user_prompt FROM ({_JUDGED}) JOIN v_raw_json USING (opinion_id) WHERE error IS NOT NULL""")
def build_corrective_prompts(c):
    _, bad = va.split_judged(va.judge(c.text_view("v_raw_json")))
    return bad.select("opinion_id", inf.corrective_prompt(CORRECTIVE, F.col("error"), F.col("raw")).alias("user_prompt"))


_CITED = re.compile(r"[0-9]+ U\.S\. [0-9]+")


def _reply(provider: str, prompt: str) -> tuple:
    """Answer of a stand-in, from its prompt alone.

    By the length of the first prompt modulo 4: 0 valid at once, 1 valid on the
    second try, 2 never valid, 3 the call fails. A corrective prompt holds the
    previous answer, which says what becomes of it.
    """
    if prompt.startswith("The answer was invalid"):
        previous = prompt.split("\nIt was:\n", 1)[1].rsplit("\nAnswer again.", 1)[0]
        if not previous:
            return None, 0, 0, f"{provider} unavailable"
        told = json.loads(previous)
        if told["legal_standard"] == "open":
            told["legal_topics"] = ["procedure"]
        return json.dumps(told), len(prompt), 10, None
    kind = len(prompt) % 4
    if kind == 3:
        return None, 0, 0, f"{provider} unavailable"
    cited = _CITED.search(prompt).group()
    return json.dumps({
        "holding": f"{provider} on {cited}", "holding_confidence": len(prompt) % 10 / 10, "legal_standard": "open" if kind == 1 else None,
        "disposition": "affirmed", "disposition_confidence": 0.9, "dissent_present": False, "key_authorities": [{
            "citation_string": cited, "case_name": None, "citation_context": "c", "citation_type": "followed", "paragraph_context": "p"}],
        "legal_topics": ["procedure"] if kind == 0 else []}), len(prompt), 10, None


def stand_in(provider: str, batch: pd.DataFrame) -> pd.DataFrame:
    rows = [_reply(provider, p) for p in batch.user_prompt]
    return pd.DataFrame(rows, columns=["content", "prompt_tokens", "completion_tokens", "call_error"])


PROVIDERS = {name: partial(stand_in, name) for name in ("anthropic", "openai")}
DEFAULT_MODEL = "gpt-x"

_LENGTH = """length('Case: ' || case_name || chr(10) || 'Court: ' || court_id || chr(10) || '---' || chr(10) || raw_text || chr(10)
  || '---' || chr(10) || 'Answer now.')"""


def asked_sql(provider: str) -> str:
    """What the stand-ins make of each opinion's prompt."""
    return f"""
      SELECT opinion_id, {provider} AS provider, {_LENGTH} % 4 AS kind, {_LENGTH} % 10 AS share,
        regexp_extract(raw_text, '[0-9]+ U[.]S[.] [0-9]+') AS cited FROM v_opinions"""


_BY_COURT = "CASE WHEN court_level = 'appellate' THEN 'anthropic' ELSE 'openai' END"


def run_extraction(docs):
    return inf.extract_documents(docs, PROVIDERS, DEFAULT_MODEL, SYSTEM, USER, CORRECTIVE, strict=False)


@query("extract_documents", f"""
    SELECT opinion_id, CASE provider WHEN 'anthropic' THEN 'claude-x' ELSE 'gpt-x' END AS extraction_model,
      CASE WHEN kind < 2 THEN provider || ' on ' || cited END AS holding,
      CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INT) AS attempts,
      CASE WHEN kind >= 2 OR share < 3 THEN 'needs_review' ELSE 'completed' END AS status,
      CASE kind WHEN 2 THEN 'Schema validation failed: legal_topics: List should have at least 1 item'
        WHEN 3 THEN provider || ' unavailable' END AS error,
      CAST(CASE kind WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 0 END AS BIGINT) AS completion_tokens
    FROM ({asked_sql(_BY_COURT)})""")
def extract_documents(c):
    outcomes, _ = run_extraction(_docs(c))
    return outcomes.select("opinion_id", "extraction_model", F.col("intelligence.holding").alias("holding"), "attempts", "status",
                           "error", "completion_tokens")


@query("extract_and_link", f"""
    WITH cited AS (
        SELECT opinion_id, cited, split_part(cited, ' U.S. ', 1) AS v, split_part(cited, ' U.S. ', 2) AS p FROM ({asked_sql("''")}) WHERE kind < 2),
      exact AS (SELECT v, p, min(o.opinion_id) AS id FROM (SELECT DISTINCT v, p FROM cited)
                JOIN v_opinions o ON o.raw_text LIKE '%' || v || ' % ' || p || '%' GROUP BY 1, 2)
    SELECT opinion_id || '-0' AS citation_id, opinion_id AS citing_opinion_id, cited AS citation_string, id AS cited_opinion_id
    FROM cited LEFT JOIN exact USING (v, p)""")
def extract_and_link(c):
    """The whole run from opinions to extractions and, from these, to resolved citations."""
    out = runs.extract_and_link(c.text_view("v_opinions"), PROVIDERS, DEFAULT_MODEL, SYSTEM, USER, CORRECTIVE, match="like")
    return out["citations"].select("citation_id", "citing_opinion_id", "citation_string", "cited_opinion_id")


@query("route_model", """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'anthropic' ELSE 'openai' END AS provider FROM events""")
def route_model(c):
    model = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("claude-"), "event_type")).otherwise(
        F.concat(F.lit("gpt-"), "event_type"))
    return c.table("events").select("event_id", inf.route_model(model).alias("provider"))


def length_vector(texts: pd.Series) -> list:
    """Stand-in for an embedding: text length and word count."""
    return [[float(len(t)), float(len(t.split(" ")))] for t in texts]


@query("embed_texts", """
    SELECT conv_id, turn, CAST(len(text) AS DOUBLE) AS n_chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words
    FROM conversations""")
def embed_texts(c):
    rows = inf.embed_texts(c.table("conversations").select("conv_id", "turn", "text"), "text", length_vector)
    return rows.select("conv_id", "turn", F.get("embedding", F.lit(0)).cast("double").alias("n_chars"),
                       F.get("embedding", F.lit(1)).cast("double").alias("n_words"))
