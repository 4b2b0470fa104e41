"""What the pipeline's stages read, write and shuffle once only."""

import pyarrow as pa

from lexweave.llm import common, mixture, near_copies, simhash
from test_near_copies import grams

SHAPE = "doc_id long, text string, source string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sets_are_those_of_the_shingles():
    texts = [None, "", "a b", "A  b", "a\0b", "a b c d e f g", "a b c d e f h", "b c\td e\nf g", "ü ö " * 40, "x" * 70_000 + " y"]
    sets = list(near_copies.sets_of(pa.array(texts)))
    for x, own in zip(texts, sets):
        for y, other in zip(texts, sets):
            assert len(set(own) & set(other)) == len(grams(x) & grams(y)), (x, y)
    assert [list(s) for s in near_copies.sets_of(pa.array(texts).slice(3, 4))] == [list(s) for s in sets[3:7]]


def test_texts_visit_python_once_for_fingerprints_and_bands(spark):
    docs = spark.createDataFrame([(1, "one two three four", "a"), (2, None, "a")], SHAPE)
    marked = simhash.fingerprints(docs, ("bands", "array<long>", near_copies._marks))
    assert plan_of(marked).count("MapInArrow") == 1 and marked.columns == ["doc_id", "source", "fp", "bands"]
    assert sorted((r.doc_id, r.fp) for r in marked.collect()) == sorted((r.doc_id, r.fp) for r in simhash.fingerprints(docs).collect())


def test_links_that_are_stars_take_no_step(spark, monkeypatch):
    written, kept = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: written.append(label) or kept(df, label))
    stars = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (4, 5), (6, 6)], "a long, b long")
    assert sorted(map(tuple, common.components(stars).collect())) == [(2, 1), (3, 1), (5, 4)] and written == ["links"]
    chain = spark.createDataFrame([(k + 1, k) for k in range(9)] + [(20, 3), (20, 8)], "a long, b long")
    assert sorted(map(tuple, common.components(chain).collect())) == [(k, 0) for k in [*range(1, 10), 20]]


def test_only_repeated_rows_are_told_apart(spark):
    rows = [(1, "one two", "a"), (2, "ONE two", "b"), (3, None, "a")]
    once = near_copies.keep_one(spark.createDataFrame(rows, SHAPE))
    twice = near_copies.keep_one(spark.createDataFrame([*rows, rows[0]], SHAPE))
    assert "first(text" not in plan_of(once) and "first(text" in plan_of(twice)
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in twice.collect()) == [1, 3]


def test_words_are_counted_once_for_sums(spark, monkeypatch):
    written, kept = [], mixture.materialize
    monkeypatch.setattr(mixture, "materialize", lambda df, label: written.append(label) or kept(df, label))
    mixed, _ = mixture.mix(spark.createDataFrame([(1, "one two", "a"), (2, "three", "b")], SHAPE))
    assert written == ["sums"] and plan_of(mixed).count("regexp_extract_all") == 1
