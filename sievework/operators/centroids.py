"""A nearest-centroid experiment over vectors: all folds, parts of the vectors and rules of comparison in one plan.

It is the cheapest real classifier: centroids are sums over groups of rows, so a fold's training is the total of the groups
that train in it, and no row is read once a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import metrics

#: The rules by name: whether a row with distances, products and lengths to the positive (1) and negative (0) centroid is positive.
RULES = {"logreg": "e0 > e1", "svm": "d1 / sqrt(n1) > d0 / sqrt(n0)", "xgboost": "l0 > l1", "mlp": "d1 > d0"}


def roles(df: DataFrame, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(experiments: experiment, fold, held_out) and the rows that test in each: by id modulo ``folds``, and one category left out at a time with one part of the benign rows."""
    spark = df.sparkSession
    names = sorted(r[0] for r in df.where("label = 1 and attack_category is not null").select("attack_category").distinct().collect())
    cases = [("standard_cv", f, None) for f in range(folds)] + [("leave_out", f, c) for f, c in enumerate(names)]
    experiments = spark.createDataFrame(cases, "experiment string, fold int, held_out string")
    part = F.pmod("sample_id", F.lit(folds)) == F.col("fold")
    cv = F.col("experiment") == "standard_cv"
    tests = (cv & part) | (~cv & ((F.col("attack_category") == F.col("held_out")) | ((F.col("label") == 0) & part)))
    return experiments, df.join(F.broadcast(experiments), tests)


def experiment(df: DataFrame, parts: dict[str, tuple[int, int]], folds: int = 5, vector: str = "embedding") -> DataFrame:
    """(experiment, embedding, classifier, fold, held_out, f1): macro F1 of each rule on each part (from, to: places of the vector from 1) in each fold."""
    experiments, tests = roles(df, folds)
    x = F.col("x").cast("double")
    each = df.select("label", "attack_category", F.pmod("sample_id", F.lit(folds)).alias("m"), F.posexplode(vector).alias("k", "x"))
    sums = each.groupBy("label", "attack_category", "m", (F.col("k") + 1).alias("k")).agg(F.sum(x).alias("s"), F.count("*").alias("n"))
    cv = F.col("experiment") == "standard_cv"
    benign, away = F.col("label") == 0, F.col("m") != F.col("fold")
    trains = F.when(cv, away).otherwise((benign & away) | (~benign & ~F.col("attack_category").eqNullSafe(F.col("held_out"))))
    centre = sums.join(F.broadcast(experiments), trains).groupBy("experiment", "fold", "k").agg(*((F.sum(F.when(F.col("label") == c, F.col("s"))) / F.sum(F.when(F.col("label") == c, F.col("n")))).alias(f"c{c}") for c in (0, 1)))
    name = F.lit(None).cast("string")
    for n, (low, high) in parts.items():
        name = F.when(F.col("k").between(low, high), F.lit(n)).otherwise(name)
    rows = tests.select("experiment", "fold", "held_out", "sample_id", "label", F.posexplode(vector).alias("k", "x")).withColumn("k", F.col("k") + 1)
    rows = rows.join(F.broadcast(centre), ["experiment", "fold", "k"]).withColumn("embedding", name).where("embedding is not null")

    def to(c: int) -> list[Column]:
        y = F.col(f"c{c}")
        return [F.sum((x - y) * (x - y)).alias(f"e{c}"), F.sum(F.abs(x - y)).alias(f"l{c}"), F.sum(x * y).alias(f"d{c}"), F.sum(y * y).alias(f"n{c}")]

    key = ["experiment", "embedding", "fold", "held_out"]
    rows = rows.groupBy(*key, "sample_id", "label").agg(*to(0), *to(1))
    rules = F.explode(F.array(*(F.struct(F.lit(c).alias("classifier"), F.expr(r).alias("yes")) for c, r in RULES.items()))).alias("r")
    p = rows.select(*key, "label", rules).select(*key, "label", "r.classifier", F.col("r.yes").cast("int").alias("pred"))
    key = [*key, "classifier"]
    c = metrics.cells(p, key)
    return c.select(*key, *metrics._bundle(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))).select("experiment", "embedding", "classifier", "fold", "held_out", "f1")
