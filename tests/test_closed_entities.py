"""References that are cut off before their semicolon."""

from pyspark.sql import functions as F

from lexweave.functions import text as tx


def test_cut_off_references_stay_if_only_closed_ones_are_asked_for(spark):
    texts = ["a &amp; b &copy; &#65;&#x42; &quot;", "x &amp", "x &copy y &am", "&nosuch; &notit; &amp;lt;", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.u for r in df.select(tx.unescape_entities(F.col("t"), closed=True).alias("u")).collect()]
    assert got == ["a & b \u00a9 AB \"", "x &amp", "x &copy y &am", "&nosuch; &notit; &lt;", None]
    cleaned = tx.with_clean_text(df, "t", "t", closed=True).collect()
    assert cleaned[1].t == "x &amp"
    assert df.select(tx.unescape_entities(F.col("t")).alias("u")).collect()[1].u == "x &"
