import hashlib

from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.language import detect


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text")).alias("x")).first().x


def test_normalize_unicode(spark):
    assert one(spark, "  é 　b\t\nc ", T.normalize) == "é b c"
    assert one(spark, None, T.normalize) is None
    assert one(spark, "   ", T.normalize) == ""


def test_words_and_shingles(spark):
    assert one(spark, "", T.word_list) == []
    assert one(spark, None, T.shingles) == []
    assert one(spark, "A b", T.shingles) == ["a b"]
    assert one(spark, "a b c d e f", T.shingles) == ["a b c d e", "b c d e f"]
    assert one(spark, "x y  z", T.word_count) == 3


def test_hashes(spark):
    assert one(spark, "abc", T.hash16) == hashlib.sha256(b"abc").hexdigest()[:16]


def test_confidence_leftmost_alternative(spark):
    assert one(spark, "Ignore previous", lambda c: T.confidence(c, ["ignore", "ignore previous"])) == 1 / (1 + __import__("math").log10(15))
    assert one(spark, " ", lambda c: T.confidence(c, ["a"])) == 0.0
    assert one(spark, "a a a", lambda c: T.confidence(c, ["a"])) == 1.0


def test_caps_and_display(spark):
    assert one(spark, "ABCDEFGHIJ", T.mostly_caps) is True
    assert one(spark, "ABC", T.mostly_caps) is False
    assert one(spark, "a​b\n<&\"'>", T.display) == "ab &lt;&amp;&quot;&#x27;&gt;"
    assert one(spark, "x" * 101, T.display) == "x" * 100 + "..."


def test_language(spark):
    assert one(spark, "der Hund und die Katze", detect) == "de"
    assert one(spark, "", detect) == "unknown"
