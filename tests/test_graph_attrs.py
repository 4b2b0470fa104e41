"""The registered first step of the walk begins at every opinion."""

import __spark_entry__ as entry


def test_first_step_starts_everywhere(spark):
    sf = "/root/testdata/sf0.001"
    roots = entry.queries()["graph_attrs"](spark, sf).select("root_id").distinct().count()
    assert roots == spark.read.parquet(f"{sf}/documents.parquet").count()
