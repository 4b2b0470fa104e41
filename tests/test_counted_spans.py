"""Characters before a chunk are summed from span to span, not read again from the beginning of the text."""

from pyspark.sql import functions as F

from lexweave.functions.segments import chunk_document
from lexweave.operators.chunking import counted_spans

TEXTS = ["", None, "  \n\n ", "I. BACKGROUND\n\n" + "One thing is said. Été \U0001f600 too.\n\n" * 300, "lead\n\nANALYSIS\n\n" + "See 1 U.S. 2. It holds. " * 400]


def _solid(part):
    return F.length(F.regexp_replace(part, r"\s", ""))


def test_counted_spans_equal_counts_from_the_beginning(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    spans = rows.select("i", "text", F.posexplode(chunk_document(F.col("text"))).alias("n", "c"))
    part = lambda begin, end: F.substring("text", begin + 1, end - begin)
    want = spans.select("i", "n", _solid(part(F.col("c.start_char"), F.col("c.end_char"))), _solid(part(F.lit(0), F.col("c.start_char"))))
    got = rows.select("i", F.posexplode(counted_spans(F.col("text"), _solid)).alias("n", "c")).select("i", "n", "c.inside", "c.before")
    assert got.count() > 8 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the text does not travel with each chunk
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(aggregate(" in plan
