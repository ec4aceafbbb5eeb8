"""Commands over files, and whole reports."""

import json

import numpy as np
from pyspark.sql import functions as F

from sievework import cli
from sievework.operators import reports

LABELLED = "sample_id bigint, label int, text string, attack_category string, is_indirect boolean, language string, embedding array<double>, source string"


def table(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(120):
        y = i % 2
        rows.append((i, y, f"text number {i % 100} of {'some' if y else 'other'} kind {r.integers(1000)}", "ab"[i // 2 % 2] if y else None, i % 6 == 1, "en" if i % 5 else "fr", [float(v) for v in r.normal(size=3) + 2 * y], "s"))
    return spark.createDataFrame(rows, LABELLED)


def test_chain_of_commands(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    run = lambda *args: cli.main(list(args), spark)
    table(spark).write.parquet(at("raw"))
    run("harmonize", at("raw"), at("clean"))
    clean = spark.read.parquet(at("clean"))
    assert 0 < clean.count() <= 120 and {r[0] for r in clean.select("language").distinct().collect()} <= {"en", "fr"}
    run("split", at("clean"), at("splits"), "--min-samples", "20", "--train-only", "b")
    s = spark.read.parquet(at("splits"))
    assert {r[0] for r in s.where("experiment = 'leave_out'").select("held_out").distinct().collect()} == {"a"}
    run("check-contamination", at("clean"), at("leaks"), at("splits"))
    leaks = [json.loads(x.value) for x in spark.read.text(at("leaks")).collect()]
    assert {x["split_id"] for x in leaks} == {f"standard_cv_{f}" for f in range(5)} | {"leave_out_0", "direct_indirect_0", "crosslingual_0"}
    for experiment in ("standard_cv", "leave_out"):
        run("train", at("clean"), at("folds"), "--experiment", experiment, "--classifier", "logreg", "svm", "--embedding", "e", "--min-samples", "20")
    folds = spark.read.parquet(at("folds"))
    assert folds.count() == 2 * (5 + 2)
    run("report", at("folds"), at("report"))
    said = capsys.readouterr().out
    assert said.startswith("Over 2 combinations") and "of 2 combinations" in said
    assert spark.read.option("header", True).csv(at("report/master")).count() == 2
    assert spark.read.text(at("report/summary")).count() >= 3
    assert reports.summary(folds.limit(0)) == "There are no results."


def test_review(spark, tmp_path):
    d = table(spark).withColumn("label_source", F.when(F.col("label") == 1, "llm").otherwise("uncertain")).withColumn("confidence", F.lit(0.7))
    d.write.parquet(str(tmp_path / "t"))
    cli.main(["review", str(tmp_path / "t"), str(tmp_path / "out"), "--n", "3"], spark)
    spot = spark.read.option("header", True).csv(str(tmp_path / "out/spot_check"))
    assert spot.count() == 6 and spark.read.option("header", True).csv(str(tmp_path / "out/uncertain")).count() == 60
    spot.select("sample_hash", F.lit("C7").alias("correct_category")).coalesce(1).write.option("header", True).csv(str(tmp_path / "o"))
    cli.main(["review", str(tmp_path / "t"), str(tmp_path / "new"), "--overrides", str(tmp_path / "o")], spark)
    assert spark.read.parquet(str(tmp_path / "new")).where("label_source = 'manual' and attack_category = 'other'").count() == 6
