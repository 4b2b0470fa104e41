"""The sort of conflicts moves the columns that it shows and one number to order by, no dates and no places."""

import re

from pyspark.sql import functions as F

from lexweave.operators import conflicts as cf
from test_conflict_kinds import many
from test_relations import AS_OF, SCHEMA


def test_sorted_rows_are_slim(spark):
    prof = cf.profiles(spark.createDataFrame(many(10), SCHEMA))
    plan = cf.ranked_conflicts(prof, F.lit(AS_OF), 0.45)._jdf.queryExecution().optimizedPlan().toString()
    moved = re.search(r"RepartitionByExpression.*\n.*Project \[(.*)\]", plan).group(1)
    names = re.findall(r"(\w+)#\d+L?(?=,|$)", moved)
    assert {"opinion_id_a", "opinion_id_b", "_key", "_part"} <= set(names)
    assert not {"date_filed", "place", "u", "v", "_second"} & set(names) and len(names) <= 11
