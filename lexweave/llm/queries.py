"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import (
    contamination, embeddings, language_model, languages, mixture, negatives, pii, quality_rules, sharding, simhash, spelling,
    suffixes, toxicity)
from lexweave.llm.common import table
from lexweave.runtime import new_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the context-adjusted scores."""
    spans = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", "added")
    return spans.select(
        "doc_id", *(count(k.name) for k in pii.KINDS), F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(every).alias("spans"),
        F.array_join(F.transform(every, lambda x: x["score"].cast("string")), ",").alias("scores"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in one of 24 shards of near equal bytes, by the stored table of slots."""
    placed, chosen = sharding.shard_by_map(table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "slots"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(chosen.version).alias("map_version"))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    mixed, _ = mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "part")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact unigram score and model score of every document, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = ~language_model.held_out()
    model, words = language_model.fit(docs.filter(learned))
    return language_model.score(docs, model, words, learned).select(
        "doc_id", language_model.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside windows of benchmark items, and which items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", contamination.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contamination.contaminated().alias("contaminated"), "longest")


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.fit(docs.filter(~languages.held_out()))
    return languages.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", languages.held_out().alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, at a cosine of 0.93 or more within its label."""
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, from labelled examples outside the held-out fold, with the nearest as evidence."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model, space = toxicity.fit(table(spark, sf_dir, "documents"), labels.filter(~toxicity.held_out()))
    return toxicity.score(space, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"), "evidence")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one holds in a passage of 50 bytes, and what is left."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and failure bits of every document, the verdict of the current policy, and for a document that one rule
    alone rejects, how many the policy would keep without that rule."""
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    tally = quality_rules.ablations(entries).select(F.col("rule").alias("decided_by"), F.col("n_kept_without").alias("kept_without"))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask(1))) != 0
    judged = quality_rules.apply_policy(entries).join(F.broadcast(tally), "decided_by", "left")  # a row for each rule
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed",
        "decided_by", "kept_without")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and number of neighbours of every frequent word of the documents."""
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_sharding, op3_mixture, op4_language_model, op5_contamination, op6_languages, op7_embeddings,
    op8_simhash, op9_toxicity, op10_suffixes, op11_quality_rules, op12_spelling, op13_negatives)}

_BLANK = r"\x20\x09-\x0D"
_RULES = [r.name for r in quality_rules.RULES]
_FAILED = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(quality_rules.RULES))
_CASES = " ".join(f"WHEN {1 << k} THEN '{name}'" for k, name in enumerate(_RULES))

SQL: dict[str, str] = {
    "op11_quality_rules": rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^{_BLANK}]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l FROM texts),
windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM parts, unnest(range(1, len(w) - 1)) AS u(i)),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[{_BLANK}]*[-*\x{{2022}}]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[{_BLANK}]*$'))) AS n_ellipsis_lines
  FROM parts LEFT JOIN repeats USING (r)),
judged AS (SELECT *, ({_FAILED})::BIGINT AS failed FROM measured),
named AS (SELECT *, CASE failed {_CASES} END AS decided_by FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality_rules.mask(1)} <> 0 AS base_failed,
  failed = 0 AS kept, failed, decided_by,
  CASE WHEN decided_by IS NOT NULL THEN (SELECT count(*) FROM judged WHERE failed = 0) + count(*) OVER (PARTITION BY decided_by) END AS kept_without
FROM named""",
    "op13_negatives": """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
found AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3""",
}
