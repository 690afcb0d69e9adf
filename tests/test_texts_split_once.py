"""A text is cut into lines once, however often its lines are looked at."""

from pyspark.sql import functions as F

from tracemill.functions import text as X


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([("<assistant>x\nx \ny\n#### 1\nz",), ("a\n\na",), (None,)], "c string")
    clean = X.clip_after_final(X.sanitize_reasoner(F.col("c")))
    said = X.sanitize_selector(F.col("c"))
    assert df.select(clean.alias("x"))._jdf.queryExecution().analyzed().toString().count("split(") == 2
    assert df.select(said.alias("x"))._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [r[0] for r in df.select(clean).collect()] == ["x\ny\n#### 1", "a\n\na", None]
