"""What the planner makes of the jobs: pushed filters, narrow scans, no cross joins."""

import re

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import chunking, conflicts, graph, resolution
from lexweave.operators.ranking import top_per_group
from lexweave.plans.corpus import Corpus
from lexweave.runtime import materialize
from lexweave.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, SF)


@pytest.fixture(scope="module")
def opinions(corpus):
    return materialize(corpus.view("v_opinions"), "opinions")


def assert_no_cross(text):
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_court_listing_reaches_the_scan(opinions):
    text = plan(tables.list_by_court(opinions, "ca9", "2001-01-01").select("opinion_id", "date_filed"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(court_id,ca9\)", text)
    assert "GreaterThanOrEqual(date_filed" in text
    assert "raw_text" not in re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "TakeOrderedAndProject" in text


def test_lookup_reads_only_the_row_group_filter(opinions):
    assert "EqualTo(opinion_id,5)" in plan(tables.point_lookup(opinions, "opinion_id", 5))


def test_conflicts_never_read_the_text_nor_cross(opinions, corpus):
    joined = conflicts.opinions_with_extractions(opinions, corpus.extractions())
    assert "raw_text" not in plan(joined.select("opinion_id", "disposition"))
    found = conflicts.detect_conflicts(conflicts.profiles(joined), F.lit("2024-12-31").cast("date"))
    text = plan(found)
    assert_no_cross(text)
    assert "confidence" in text


def test_resolution_does_not_cross(opinions, corpus):
    text = plan(resolution.resolve_citations(corpus.view("v_authorities"), opinions))
    assert_no_cross(text)


def test_only_numbers_asked_for_leave_their_text(spark, opinions):
    pairs = spark.createDataFrame([(12, 345), (7, 90000), (12, 8)], "volume int, page int")
    asked = resolution.NumberMap(pairs)
    assert sum(map(len, asked.maps.values())) * 8 < 14_100  # bytes, whatever is asked for
    index = resolution.number_index(opinions, asked)
    optimized = index._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("split(") == 1  # that of the text: the maps are constants
    texts = spark.createDataFrame([(1, "see 12 U.S. 345, 7 900, 90000 8 and 5 6"), (2, None), (3, "")], "opinion_id long, raw_text string")
    rows = {(r.kind, r.number) for r in resolution.number_index(texts, asked).collect()}
    assert rows == {("v", 12), ("v", 7), ("p", 345), ("p", 90000), ("p", 8)}
    inside = {(r.kind, r.number, r.place) for r in resolution.piece_index(texts, asked).collect()}
    assert inside == {("v", 12, 0), ("p", 345, 2), ("v", 7, 5), ("p", 90000, 9), ("p", 8, 14)}


def test_walk_levels_have_words_of_roots(spark):
    cites = spark.createDataFrame([(1, 1, 2), (2, 2, 3)], "citation_id long, citing_opinion_id long, cited_opinion_id long")
    names = spark.range(5).select(F.col("id").alias("opinion_id"), F.lit("n").alias("case_name"), F.lit("c").alias("court_id"))
    walk = graph.graph_walk(cites, names, names.select(F.col("opinion_id").alias("root_id")), 2)
    assert_no_cross(plan(walk))
    assert {(r.root_id, r.opinion_id, r.depth) for r in walk.collect()} == {
        *((i, i, 0) for i in range(5)), (1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_top_of_group_is_cut_before_the_shuffle(opinions):
    text = plan(top_per_group(opinions.select("court_id", "opinion_id"), ["court_id"], [F.col("opinion_id")], 3))
    assert text.count("WindowGroupLimit") == 2


def test_large_top_ranks_slices_first(opinions):
    rows = opinions.select("court_id", "opinion_id")
    text = plan(top_per_group(rows, ["court_id"], [F.col("opinion_id")], 5000))
    assert "_slice" in text


def test_chunking_does_not_shuffle(opinions):
    text = plan(chunking.chunk_documents(opinions))
    assert "Exchange" not in text and "Window" not in text and "Python" not in text


def test_cleaning_calls_python_for_folding_and_entities_only(corpus):
    text = plan(corpus.table("pages").select(tx.clean_text(F.col("html"))))
    assert len(re.findall(r"ArrowEvalPython \[", text)) == 2
    assert "BatchEvalPython" not in text
