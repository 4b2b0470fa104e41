"""The near-copy stage against all pairs of texts."""

import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import near_copies

SHAPE = "doc_id long, text string, source string"


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def kept_of(rows):
    """Smallest ids of the classes, by all pairs."""
    sets = [(i, grams(t)) for i, t, _ in rows]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i][1] & sets[j][1]) >= 4 * len(sets[i][1] | sets[j][1]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return {min(sets[k][0] for k in range(len(sets)) if root[k] == r) for r in set(root)}


def test_stage_joins_texts_of_one_changed_word(spark):
    words = [f"w{i}" for i in range(60)]
    one, two = words.copy(), words.copy()
    one[30] = "x"
    two[20] = two[40] = "y"
    rows = [(1, " ".join(words), "a"), (2, " ".join(one), "a"), (3, " ".join(two), "a"), (4, " ".join(words).upper(), "b"),
            (5, None, None), (6, "", "a"), (None, " ".join(words), None), (8, "w1 w2", "a"), (8, "w1 w2", "a"), (9, "W1  w2", "a")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SHAPE), "")
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 8]
    assert near_copies.keep_one(spark.createDataFrame([], SHAPE)).count() == 0


@pytest.mark.parametrize("part", [near_copies.PART, 3, 1])
def test_all_pairs(spark, part):
    """Parts of 3 rows and of one send places through the finer bands as well."""
    rng = np.random.default_rng(7)
    rows = []
    for group in range(12):
        base = [f"g{group}v{k}" for k in rng.integers(0, 400, 120)]
        for _ in range(14):
            own = base.copy()
            for at in rng.integers(0, len(own), rng.integers(0, 6)):
                own[at] = f"c{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(own), "s"))
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[k][1], "s") for i, k in enumerate(order)]
    found = near_copies.keep_one(spark.createDataFrame(rows, SHAPE), part)
    want = kept_of(rows)
    assert {r.doc_id for r in found.collect()} == want and 12 <= len(want) < len(rows)


def test_rows_of_a_place_follow_the_nodes_outside_its_largest_class(spark):
    rows = [(k, 0 if k < 900 else k, 5, 77) for k in range(903)] + [(k, k, 6, 78) for k in range(10)]
    named = spark.createDataFrame(rows, "node long, root long, band int, place long")
    dealt = near_copies._dealt(named, near_copies._sizes(named), 100)
    per = {r.band: r["count"] for r in dealt.groupBy("band").count().collect()}
    assert per[5] == 900 + 3 * 9 + 3 and per[6] <= 1 + 9 * 2
    met = set()
    for cell in dealt.toPandas().groupby(near_copies.CELL):
        own = cell[1]
        left, right = own[own.side == 0].node, own[own.side == 1].node
        pairs = [(x, y) for x in left for y in right] if len(right) else [(x, y) for x in left for y in left if x < y]
        met |= {(cell[0][0], min(p), max(p)) for p in pairs}
    want = {(band, min(x, y), max(x, y)) for x, rx, band, _ in rows for y, ry, other, _ in rows if band == other and x < y and rx != ry}
    assert met >= want
