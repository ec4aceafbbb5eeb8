"""The secret scan: held-out findings, features against plain Python, and shapes that are easily missed or mistaken."""

import math
import re

import pytest
from pyspark.sql import functions as F

WORDS = ["the", "and", "house", "garden", "letter", "water", "morning", "number", "little", "window", "under", "river", "stone", "paper", "summer", "winter", "market", "street", "bridge", "forest"]


@pytest.fixture(scope="module")
def detector(spark):
    from sievework.llm.secret_scan import trained

    return trained(spark.createDataFrame([(" ".join(WORDS * 30),)], "text string"))


def test_held_out_findings(spark):
    from sievework.llm.secret_scan import labelled_findings, language_of, measured, train

    language = language_of(dict.fromkeys(WORDS, 10))
    f = labelled_findings(spark, 6000, language.words).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(4)))
    assert f.where("value is null or before is null").isEmpty()
    m = measured(f.where("part = 0"), train(f.where("part <> 0"), language))
    assert m["precision"] > 0.97 and m["recall"] > 0.97 and m["removed"] > 0.97


def test_misses_and_false_findings(spark, detector):
    from sievework.llm.secret_scan import scan

    secret = ["postgres://admin:{}@host/db", "S3cretPw99"], ["password = {}", "abc123!"], ['pwd: "{}"', "two words here"], ["mot de passe : {}", "Zx9kLm2Qp7Rt"], ["export AWS_SECRET_ACCESS_KEY={} ok", "wJalrXUtnFEMIK7MDENGbPxRfiCY"]
    none = ["token = userTokenProviderFactory", 'private = "SomeClassNameHere"', "the password is in the letter", "see https://www.example.com:8080/path", "commit 8d5e425dbdaa383537b4fea24b37ed72645ac62d", "AWS_SECRET_ACCESS_KEY is a name"]
    data = [(i, p.format(v)) for i, (p, v) in enumerate(secret)] + [(100 + i, t) for i, t in enumerate(none)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(data, "doc_id bigint, text string"), detector).collect()}
    for i, (p, v) in enumerate(secret):
        assert got[i].redacted_text == p.format("<SECRET>"), got[i]
        assert [(f.start, f.length) for f in got[i].findings] == [(p.index("{"), len(v))]
    for i, t in enumerate(none):
        assert got[100 + i].n_secrets == 0 and got[100 + i].redacted_text == t


def test_other_places_of_a_secret(spark, detector):
    """Each place of a value goes, but not where it is a part of a longer word; marks and quoting signs in texts do no harm."""
    from sievework.llm.secret_scan import scan

    texts = ["api_key = Zk39xQ81 then Zk39xQ81, xZk39xQ81 and Zk39xQ81y", "a\u0001b password = \"q\\E7.Kx$1\\Q2\" c q\\E7.Kx$1\\Q2", "\u0001\u0001", "password = 'x", "token = \"\" and secret: ''"]
    got = [r.redacted_text for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), detector).orderBy("doc_id").collect()]
    assert got[0] == "api_key = <SECRET> then <SECRET>, xZk39xQ81 and Zk39xQ81y"
    assert got[1] == "a\u0001b password = \"<SECRET>\" c <SECRET>" and got[2:] == texts[2:]


def test_features_against_python(spark, detector):
    from sievework.llm.secret_scan import FEATURES, LETTERS, features

    values = ["gardenHouse9", "a", "Zx-9_/kL.m", "é日x9house", "the water 12", "0123456789abcdef", "WINTER_market"]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = d.selectExpr("i", f"{features('v', "'my password = '", "'tests/x'", detector.language)} as f").collect()
    names = list(FEATURES)
    for r in rows:
        v, f = values[r.i], dict(zip(names, r.f, strict=True))
        at = [LETTERS.find(c) + 1 for c in v.lower()]
        pairs = list(zip(at, at[1:], strict=False)) or [(at[0], 1)]  # an empty text is found at the first place
        assert math.isclose(f["transitions"], sum(detector.language.transitions[a * 27 + b] for a, b in pairs) / len(pairs), rel_tol=1e-9)
        parts = re.split(r"[\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
        assert math.isclose(f["dictionary"], sum(len(p) for p in parts if p in set(detector.language.words)) / len(v), rel_tol=1e-9)
        assert f["length"] == len(v) and math.isclose(f["digit_share"], sum("0" <= c <= "9" for c in v) / len(v)) and math.isclose(f["distinct_share"], len(set(v)) / len(v))
        assert (f["path"], f["said_secret"], f["assigned"], f["said_other"]) == (1, 1, 1, 0) and f["hexadecimal"] == bool(re.fullmatch("[0-9a-f]+", v))


def test_no_python_on_the_main_path(spark, detector):
    from sievework.llm.secret_scan import scan

    plan = scan(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), detector)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
