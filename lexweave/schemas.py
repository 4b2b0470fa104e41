"""Declared schemas of landed records and stored tables."""

from pyspark.sql import types as T

_DDL = {
    "landed_courts": "court_id string, full_name string, short_name string, court_code string",
    "landed_clusters": (
        "cluster_id bigint, court_id string, case_name string, date_filed string, precedential_status string, "
        "citation_count bigint, judges string, sub_opinions array<string>"),
    "landed_opinions": (
        "opinion_id bigint, plain_text string, html_with_citations string, html string, xml_harvard string"),
    "opinions": (
        "courtlistener_id bigint, court_id string, court_level string, case_name string, date_filed date, "
        "precedential_status string, raw_text string, citation_count bigint, judges string, jurisdiction string, "
        "source_url string"),
    "chunks": (
        "opinion_id bigint, chunk_index int, section_type string, text string, start_char int, end_char int, "
        "citation_strings array<string>"),
    "extractions": (
        "opinion_id bigint, holding string, holding_confidence double, legal_standard string, disposition string, "
        "disposition_confidence double, key_authorities array<struct<citation_string:string,case_name:string,"
        "citation_context:string,citation_type:string,paragraph_context:string>>, dissent_present boolean, "
        "dissent_summary string, concurrence_present boolean, concurrence_summary string, legal_topics array<string>, "
        "extraction_model string, prompt_tokens bigint, completion_tokens bigint, status string"),
    "citations": (
        "citation_id bigint, citing_opinion_id bigint, cited_opinion_id bigint, citation_string string, "
        "case_name string, citation_context string, citation_type string, paragraph_context string"),
    "conflicts": (
        "opinion_a_id bigint, opinion_b_id bigint, topic string, court_a string, court_b string, description string, "
        "confidence double, status string, extraction_a_id bigint, extraction_b_id bigint, detected_at timestamp"),
    "jobs": (
        "job_id string, opinion_ids array<bigint>, priority string, submitted_at timestamp, extraction_model string"),
    "vectors": (
        "opinion_id bigint, embedding array<float>, court_id string, court_level string, date_filed string, "
        "case_name string, jurisdiction string, holding string, legal_topics array<string>"),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])
