"""Lists of nested values have numbered segments in their paths."""

from pyspark.sql import functions as F

from episodica.operators.schema import flattened


def test_numbered_segments(spark):
    rows = spark.createDataFrame([(1, [(5, [1.0, 2.0]), (6, [3.0])]), (2, [(7, None)]), (3, None)], "k int, parts array<struct<id:int,xs:array<double>>>")
    listed = rows.select("k", F.struct(F.col("parts").alias("parts", metadata={"items": 2}), F.lit("t").alias("a.b")).alias("o"))
    out = flattened(listed)
    assert out.columns == ["k", "o/parts/0/id", "o/parts/0/xs", "o/parts/1/id", "o/parts/1/xs", "o/a.b"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 5, [1.0, 2.0], 6, [3.0], "t"), (2, 7, None, None, None, "t"), (3, None, None, None, None, "t")]
    assert flattened(rows).columns == ["k", "parts"]
