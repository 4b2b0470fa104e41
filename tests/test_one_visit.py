"""Cleaning goes to Python once and gives what its two steps give."""

from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import ingest

TEXTS = ["plain", "a &amp; b", "&lt;caf\u00e9&gt; \ufb01n", "x&#8203;y", "&frac12 &copy", "\uff21&amp", "", None, "zero\u200bwidth", "&#xFB01;&nbsp;z"]


def test_cleaning_visits_python_once(spark):
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS * 30)], "opinion_id long, plain_text string, html string")
    for closed in (False, True):
        got = rows.select("opinion_id", tx.unescape_and_normalize(F.col("html"), closed=closed).alias("x")).collect()
        two = rows.withColumn("y", tx.unescape_entities(F.col("html"), closed)).select("opinion_id", tx.normalize_unicode(F.col("y")).alias("x"))
        assert sorted(map(tuple, got)) == sorted(map(tuple, two.collect()))
    pages = rows.withColumn("plain_text", F.when(F.col("opinion_id") % 3 == 0, F.col("plain_text")))
    best = ingest.with_best_text(pages).select("opinion_id", "raw_text")
    assert best._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    cut = {r.opinion_id: r.raw_text for r in best.collect()}
    assert cut[30] == "plain" and cut[1] == "a & b" and cut[21] == "a &amp; b" and cut[2] == "<caf\u00e9> fin"
    assert tx.with_clean_text(rows, "html", "x")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
