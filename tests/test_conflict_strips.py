"""Two kinds meet in strips of bounded size, and a pair's cheaper columns are those of before."""

import random

from pyspark.sql import functions as F

from lexweave.operators import conflicts as cf
from test_conflict_kinds import many
from test_relations import AS_OF, SCHEMA, corpus


def test_no_joined_row_makes_all_pairs_of_two_kinds(spark):
    prof = cf.profiles(spark.createDataFrame(many(400), SCHEMA))
    kinds, members = cf._with_kinds(prof, cf.ROWS_PER_CELL)
    met = cf._met_kinds(kinds, None, cf.ROWS_PER_CELL, 0.0, F.lit(AS_OF))
    rows = cf._meet_blocks(met, members, ["opinion_id", "extraction_id"], ["opinion_id"])
    pairs = rows.select((F.size("xs") * F.size("ys")).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    assert pairs["all"] == 400 * 400 and pairs.most <= 3 * cf.STRIP * 400


def test_rounding_by_numbers_equals_that_by_digits(spark):
    dice = random.Random(7)
    values = [dice.random() for _ in range(20_000)] + [n / 20_000 for n in range(20_001)] + [n / 20_000 + 1e-16 for n in range(999)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert rows.filter(~cf._rounded(F.col("v")).eqNullSafe(F.round("v", 4))).count() == 0


def test_shared_authorities_are_those_of_the_pairs(spark):
    prof = cf.profiles(spark.createDataFrame(corpus(60), SCHEMA))
    pairs = cf.conflict_pairs(prof, min_confidence=0.4, as_of=F.lit(AS_OF)).select("a.opinion_id", "b.opinion_id", F.explode("treated").alias("t"))
    want = sorted(map(repr, (tuple(r)[:2] + tuple(r.t) for r in pairs.toDF("a", "b", "t").collect())))
    got = sorted(map(repr, map(tuple, cf.shared_authorities(prof, F.lit(AS_OF), 0.4, 7).collect())))
    assert want and got == want
