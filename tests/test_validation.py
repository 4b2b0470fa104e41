import json

from pyspark.sql import functions as F

from lexweave.functions.intelligence import json_kind, parse_json
from lexweave.operators.validation import judge, split_judged


def payload(**changes):
    base = {
        "holding": "Held.", "holding_confidence": 0.9, "legal_standard": None, "disposition": "affirmed",
        "disposition_confidence": 1, "key_authorities": [{
            "citation_string": "31 F.3d 42 (1994)", "case_name": None, "citation_context": "c",
            "citation_type": "followed", "paragraph_context": "p"}],
        "dissent_present": False, "legal_topics": ["t"], "extraction_model": "m",
        "extraction_timestamp": "2023-06-07T08:09:10Z", "raw_prompt_tokens": 1, "raw_completion_tokens": 0,
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v != "drop"}


def results(spark, raws, **kw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r for r in judge(df, **kw).orderBy("i").collect()]


def errors(spark, *changes):
    return [r.error for r in results(spark, [json.dumps(payload(**c)) for c in changes])]


def test_only_one_complete_json_value_counts(spark):
    texts = ['{"a":1}', '{"a":1}{', '{"a":1}]', '{"a":1}}', '{"a":1},{"b":2}', "", "nope", "[1]", "3", '"s"', "null", None,
             ' {"a": 1} \n']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    kinds = [r.k for r in df.select("i", json_kind(parse_json(F.col("t"))).alias("k")).orderBy("i").collect()]
    assert kinds == ["dict", None, None, None, None, None, None, "list", "int", "str", "NoneType", None, "dict"]


def test_valid_and_threshold(spark):
    rows = results(spark, [json.dumps(payload(holding_confidence=c)) for c in (0.3, 0.29, 0.0)])
    assert [r.error for r in rows] == [None] * 3
    assert [r.status for r in rows] == ["completed", "needs_review", "needs_review"]
    assert rows[0].intelligence.key_authorities[0].citation_string == "31 F.3d 42 (1994)"


def test_lax_coercion_and_its_limits(spark):
    assert errors(spark, {"holding_confidence": "0.5"}, {"holding_confidence": True}, {"raw_prompt_tokens": "10"},
                  {"raw_prompt_tokens": 3.0}, {"dissent_present": "yes"}, {"extraction_timestamp": 1700000000},
                  {"extra": [1]}, {"key_authorities": []}, {"key_authorities": "drop"}) == [None] * 9
    bad = errors(spark, {"holding": 5}, {"holding_confidence": "high"}, {"raw_prompt_tokens": 1.5},
                 {"dissent_present": "maybe"}, {"extraction_timestamp": "soon"}, {"legal_topics": "t"})
    assert [b.split(": ")[1] for b in bad] == [
        "holding", "holding_confidence", "raw_prompt_tokens", "dissent_present", "extraction_timestamp", "legal_topics"]


def test_schema_messages(spark):
    got = errors(spark, {"holding": "drop"}, {"holding": ""}, {"holding_confidence": -0.1}, {"disposition": "x"},
                 {"legal_topics": []}, {"legal_topics": [1]}, {"raw_completion_tokens": -1},
                 {"key_authorities": [{"citation_string": "1 U.S. 2"}]}, {"key_authorities": ["x"]})
    assert all(g.startswith("Schema validation failed: ") for g in got)
    assert "holding: Field required" in got[0] and "at least 1 character" in got[1]
    assert "legal_topics.0: Input should be a valid string" in got[5]
    assert got[7].count("Field required") == 3
    assert "key_authorities.0: Input should be an object" in got[8]


def test_rules_run_after_the_shape_check(spark):
    authority = payload()["key_authorities"][0] | {"citation_string": "none"}
    rows = results(spark, [json.dumps(payload(key_authorities=[authority])), "[1]", "{"])
    assert rows[0].stage == "rules" and "key_authorities[0]" in rows[0].error
    assert rows[1].error == "Expected JSON object, got list" and rows[2].error == "Invalid JSON"


def test_metadata_may_be_left_to_the_run(spark):
    raw = json.dumps(payload(extraction_model="drop", extraction_timestamp="drop", raw_prompt_tokens="drop",
                             raw_completion_tokens="drop"))
    assert results(spark, [raw])[0].stage == "schema"
    assert results(spark, [raw], strict=False)[0].stage == "ok"


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(json.dumps(payload()),), ("x",)], "raw string")
    good, bad = split_judged(judge(df))
    assert good.count() == 1 and bad.count() == 1
