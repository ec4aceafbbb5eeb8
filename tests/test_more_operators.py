import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import contamination, embeddings, metrics, results, splits, taxonomy
from sievework.sources import loaders, sinks

LABELLED = "sample_id bigint, label int, text string, attack_category string, is_indirect boolean, language string"


def rows(spark, n):
    return spark.range(n).selectExpr("id as sample_id", "cast(id % 3 = 0 as int) as label", "concat('text ', id % 50) as text", "case when id % 3 = 0 then if(id % 6 = 0, 'a', 'b') end as attack_category", "id % 9 = 0 as is_indirect", "if(id % 5 = 0, 'fr', 'en') as language")


def test_numbers_follow_the_hash(spark):
    d = rows(spark, 500)
    got = splits._numbered(d, ["label"], 42).select("sample_id", "label", "_r").collect()
    key = {r.sample_id: r.k for r in d.select("sample_id", F.sha2(F.concat_ws(":", F.lit("42"), F.col("sample_id").cast("string")), 256).alias("k")).collect()}
    for label in (0, 1):
        mine = sorted((r for r in got if r.label == label), key=lambda r: r._r)
        assert [r.sample_id for r in mine] == sorted((r.sample_id for r in mine), key=key.get)
        assert [r._r for r in mine] == list(range(1, len(mine) + 1))
    for n in (0, 1, 77, 500, 900):
        assert [r[0] for r in splits._first(d, n, 42).orderBy("sample_id").collect()] == sorted(sorted(key, key=key.get)[:n])
    assert splits._first(d.limit(0), 5, 42).count() == 0
    assert splits.plot_sample(d, 40).count() == 40


def test_locked_splits(spark):
    d = rows(spark, 300)
    s = splits.locked_splits(d, 20, ("b",))
    assert s.where("lock is null").isEmpty() and s.join(d.where("attack_category = 'b'"), "sample_id").isEmpty()
    again = splits.locked_splits(d.repartition(5), 20, ("b",))
    key = ["experiment", "fold", "role", "lock"]
    assert sorted(map(tuple, s.select(*key).distinct().collect())) == sorted(map(tuple, again.select(*key).distinct().collect()))
    assert sorted(r.attack_category for r in splits.categories_left(d, 60).collect()) == ["a", "b"]


def test_bootstrap_against_rows(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 80)
    p = np.round(np.clip(0.3 * y + 0.7 * rng.random(80), 0, 1), 2)
    q = (p >= 0.5).astype(int)
    d = spark.createDataFrame([(int(i), int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(y, q, p, strict=True))], "sample_id bigint, label int, pred int, prob double")
    got = metrics.bootstrap(d, 2000).first()
    for m, v in metrics.evaluate(d).first().asDict().items():
        assert abs(got[m] - v) < 1e-9, m

    def brute(k):
        a, b, c = y[k], q[k], p[k]
        f = lambda s, t: 2 * (s & t).sum() / max(1, s.sum() + t.sum())
        pairs = c[a == 1][:, None] - c[a == 0][None]
        return (a == b).mean(), (f(a == 1, b == 1) + f(a == 0, b == 0)) / 2, (pairs > 0).mean() + (pairs == 0).mean() / 2

    draws = np.array([brute(rng.integers(0, 80, 80)) for _ in range(2000)])
    for i, m in enumerate(("accuracy", "f1", "auc_roc")):
        for side, at in (("lower", 2.5), ("upper", 97.5)):
            assert abs(got[f"{m}_{side}"] - np.percentile(draws[:, i], at)) < 0.03
    assert metrics.bootstrap(d.limit(0), 10).first().f1 is None


def test_sweep_has_no_slack(spark):
    at = [0.01 + 0.0, 100 * (0.98 / 199) + 0.01, 0.5]
    d = spark.createDataFrame([(1, x) for x in at], "label int, prob double")
    got = {r.threshold: r.recall for r in metrics.sweep(d).collect()}
    for t, recall in got.items():
        assert abs(recall - sum(x >= t for x in at) / 3) < 1e-12, t


def test_tiers(spark):
    d = spark.createDataFrame([(1, 1, "ignore all previous", None), (2, 1, "known", None), (3, 1, "new", None), (4, 1, "new", None), (5, 0, "benign", None), (6, 1, None, None), (7, 1, "late", None)], "sample_id bigint, label int, text string, attack_category string")
    cache = d.where("sample_id = 2").select(taxonomy.T.hash16(F.col("text")).alias("sample_hash"), F.lit("other").alias("category_slug"))
    provider = lambda texts: [" Social_Engineering " if "\nnew\n" in t else "no idea" for t in texts]
    out = {r.sample_id: r.attack_category for r in taxonomy.apply_tiers(d, cache=cache, provider=provider).collect()}
    assert out == {1: "instruction_override", 2: "other", 3: "social_engineering", 4: "social_engineering", 5: None, 6: None, 7: None}
    _, new = taxonomy.tier3(d.where("sample_id > 1"), cache, provider, budget=1)
    assert [r.category_slug for r in new.collect()] == ["social_engineering"]
    assert taxonomy.tier3(d, cache, provider, budget=0)[1].isEmpty()
    assert taxonomy.model_tag("gpt-4.1-mini") == "gpt_4_1_mini"


def test_cache_of_answers(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert taxonomy.read_cache(spark, path).isEmpty()
    taxonomy.write_cache(spark.createDataFrame([("h", "other")], "sample_hash string, category_slug string"), path)
    (tmp_path / "cache" / "bad.json").write_text("not json\n[1]\n")
    assert [tuple(r) for r in taxonomy.read_cache(spark, path).drop("line_no").collect()] == [("h", "other")]


def test_embeddings(spark, tmp_path):
    embeddings.register("length", lambda: lambda texts: [[len(t), 1] for t in texts])
    d = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "")], "sample_id bigint, text string")
    out = embeddings.embedded(d, "length")
    assert {r.sample_id: r.embedding for r in out.collect()} == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: None, 4: [0.0, 1.0]}
    with pytest.raises(ValueError):
        embeddings.model("unknown")
    path = str(tmp_path / "vectors")
    assert embeddings.load_embeddings(d, path, "v1") is None
    embeddings.save_embeddings(out, path, "v1")
    assert embeddings.load_embeddings(d.repartition(3), path, "v1").count() == 4
    assert embeddings.load_embeddings(d, path, "v2") is None
    assert embeddings.load_embeddings(d.withColumn("text", F.concat("text", F.lit("x"))), path, "v1") is None
    embeddings.clear_embeddings(spark, path)
    assert embeddings.load_embeddings(d, path, "v1") is None


def test_all_splits_are_checked(spark):
    d = spark.createDataFrame([(1, "one two three four five six", [1.0, 0.0]), (2, "one two three four five six", [1.0, 0.0]), (3, "quite another text is here now", [0.0, 1.0])], "sample_id bigint, text string, embedding array<float>")
    split = spark.createDataFrame([("cv", 0, 1, "train"), ("cv", 0, 2, "test"), ("cv", 1, 1, "train"), ("cv", 1, 3, "test"), ("cv", 2, 3, "test")], "experiment string, fold int, sample_id bigint, role string")
    got = {r.split_id: r for r in contamination.check_all(d, split).collect()}
    assert set(got) == {"cv_0", "cv_1"}
    assert got["cv_0"].total_flagged == 1 and not got["cv_0"].passed
    assert got["cv_1"].total_flagged == 0 and got["cv_1"].passed


def test_results_files(spark, tmp_path):
    (tmp_path / "llm.json").write_text('{"test_pool": "x", "model": "m", "metrics": {"f1": {"value": 0.5}}, "cost": {"total_cost_usd": 1.0, "total_queries": 4}}')
    r = loaders.read_llm_results(spark, str(tmp_path / "llm.json")).first()
    assert (r.f1, r.accuracy, r.cost_per_query) == (0.5, None, 0.25)
    for side in ("train", "test"):
        spark.range(1).write.parquet(str(tmp_path / "s" / "cv" / "fold_0" / f"{side}.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "s" / "lone" / "train.parquet"))
    assert loaders.discover_split_pairs(spark, str(tmp_path / "s")) == [f"file:{tmp_path}/s/cv/fold_0"]
    folds = spark.createDataFrame([("cv", "a", "svm", 0, 0.5), ("cv", "b", "svm", 0, 0.6)], "experiment string, embedding string, classifier string, fold int, f1 double")
    sinks.write_run(folds, str(tmp_path / "runs"))
    sinks.write_run(folds.where("embedding = 'a'").withColumn("f1", F.lit(0.7)), str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert {r.embedding: r.f1 for r in loaders.result_grid(back, ["cv"], ["svm"], ["a", "b", "c"]).collect()} == {"a": 0.7, "b": 0.6}
    sinks.write_json(folds, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_comparison_text(spark):
    d = spark.createDataFrame([("p", "x", 0.5, 0.25, 1.0, 0.00001, "—"), ("p", "y", 0.75, 0.5, 1.0, 0.0008, "y")], "test_pool string, system string, f1 double, precision double, recall double, cost_per_query double, winner string")
    text = results.comparison_markdown(d)
    assert "| p | x | 0.5000 | 0.2500 | 1.0000 | ~$0 |" in text and "**0.7500**" in text and "$0.0008" in text
