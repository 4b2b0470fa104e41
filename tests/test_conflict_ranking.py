"""Sorted conflicts are all conflicts, in order, and no table of them is written before the sort."""

from pyspark.sql import functions as F

from lexweave.operators import conflicts as cf
from test_conflict_kinds import many
from test_relations import AS_OF, SCHEMA, corpus


def test_ranked_equals_sorted_conflicts(spark, monkeypatch):
    written = []
    kept = cf.materialize
    monkeypatch.setattr(cf, "materialize", lambda df, label: written.append(label) or kept(df, label))
    for rows, least, rows_per_part, sample in ((many(30), 0.45, 3, 5), (corpus(40), 0.2, 1, 10_000), ([], 0.5, 9, 1)):
        prof = cf.profiles(spark.createDataFrame(rows, SCHEMA))
        got = cf.ranked_conflicts(prof, F.lit(AS_OF), least, 7, rows_per_part=rows_per_part, sample=sample)
        assert "conflicts" not in written
        want = cf.detect_conflicts(prof, F.lit(AS_OF), min_confidence=least)
        assert got.schema == want.schema
        found = [tuple(r) for r in got.collect()]
        order = lambda r: (-r[6], r[0], r[1])
        assert found == sorted(found, key=order)
        assert sorted(found, key=repr) == sorted((tuple(r) for r in want.collect()), key=repr)
        assert bool(found) == bool(rows)
