"""The near-copy stage joins copies by op8's classes first, and never by a class alone."""

import corpus_pipeline
from lexweave.llm import near_copies, simhash

SHAPE = "doc_id long, text string, source string"


def test_copies_of_a_class_are_joined_without_a_common_band(spark):
    words = " ".join(f"w{i}" for i in range(40))
    # 1 and 2 are alike; 3 has their fingerprint only; 4 is alike with no fingerprint of theirs.
    texts = {1: words, 2: words.upper(), 3: "some thing else", 4: words + " end"}
    prints = {1: 7, 2: 5, 3: 7, 4: 1 << 40 | 0xFFFF}
    nodes = spark.createDataFrame(
        [(i, bytes([i]), prints[i], [100 * i + b for b in range(near_copies.BANDS)]) for i in texts],
        "node long, key binary, fp long, bands array<long>")
    rows = spark.createDataFrame([(bytes([i]), t) for i, t in texts.items()], "key binary, text string")
    assert {(r.node, r.root) for r in near_copies.classes(nodes, rows).collect() if r.node != r.root} == {(2, 1)}


def test_stage_asks_op8(spark, monkeypatch):
    asked, kept = [], simhash.classes
    monkeypatch.setattr(simhash, "classes", lambda marked, *rest: asked.append(1) or kept(marked, *rest))
    rows = [(1, "one two three", "a"), (2, "ONE two  three", "b"), (3, None, "a"), (4, "four", "a")]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SHAPE), "")
    assert sorted(r.doc_id for r in found.collect()) == [1, 3, 4] and asked
