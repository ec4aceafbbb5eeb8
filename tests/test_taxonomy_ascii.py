"""Patterns with boundaries of ASCII, as in SQL."""

from pyspark.sql import functions as F

from sievework.operators import taxonomy


def test_boundaries_of_ascii(spark):
    d = spark.createDataFrame([("Netz | undüäer",), ("Bund",), ("x UND",), ("und_",), ("lıcense",), ("ſmall",)], "text string")
    of = lambda p, ascii: [x.c for x in d.select(taxonomy.match_category(F.col("text"), {"a": p}, ascii=ascii).alias("c")).collect()]
    assert of([r"\bund\b"], True) == ["a", None, "a", None, None, None]
    assert of([r"\bund\b"], False) == [None, None, "a", None, None, None]
    assert of([r"License", r"\bsmall\b"], True)[4] is None
