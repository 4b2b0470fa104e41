"""Opinions that differ in their dates only meet as one kind, and no conflict of theirs is lost."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from lexweave.operators import conflicts as cf
from test_relations import AS_OF, SCHEMA, corpus


def many(n):
    """Two kinds of ``n`` opinions, on two sides of the threshold by their dates."""
    side = {"ca5": "affirmed", "ca9": "reversed"}
    return [(2 * i + k, court, "appellate", f"Case {i}", date(2000, 1, 1) + timedelta(days=300 * i), side[court], ["t", "u"], [])
            for i in range(n) for k, court in enumerate(side)]


def test_kinds_meet_once_whatever_the_number_of_opinions(spark):
    prof = cf.profiles(spark.createDataFrame(many(30), SCHEMA))
    kinds, _ = cf._with_kinds(prof, 7)
    assert cf._met_kinds(kinds, None, 7, 0.4, F.lit(AS_OF)).count() == 1
    found = cf.detect_conflicts(prof, F.lit(AS_OF), min_confidence=0.45, rows_per_cell=7)
    assert found.count() == len({(r.opinion_a_id, r.opinion_b_id) for r in found.collect()})


def test_counted_summary_equals_that_of_all_conflicts(spark):
    for rows, least, n in ((many(30), 0.45, 3), (corpus(40), 0.4, 2), (corpus(40), 0.2, 50)):
        prof = cf.profiles(spark.createDataFrame(rows, SCHEMA))
        found = cf.detect_conflicts(prof, F.lit(AS_OF), min_confidence=least)
        columns = ["court_1", "court_2", "topic", "rank", "opinion_a_id", "opinion_b_id", "confidence", "n_conflicts"]
        want = {tuple(r) for r in cf.conflict_summary(found, n).select(columns).collect()}
        got = {tuple(r) for r in cf.strongest_conflicts(prof, F.lit(AS_OF), n, least, 7).select(columns).collect()}
        assert want and got == want
