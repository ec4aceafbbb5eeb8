import math

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import contamination, dedup, eda, metrics, quality, results, splits, taxonomy
from sievework.sources import loaders, sinks

U = "sample_id bigint, text string, label int, source string, attack_category string, language string, is_indirect boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def u(spark):
    data = [(i, f"text number {i} of many words here {i * 7}", int(i % 3 == 0), f"src{i % 4}", f"c{i % 2}" if i % 3 == 0 and i % 9 else None, "en" if i % 5 else (None if i % 10 else "de"), i % 12 == 0) for i in range(120)]
    return spark.createDataFrame(data, U).cache()


def test_exact_dedup_keeps_first(spark):
    d = spark.createDataFrame([(3, "a  b"), (1, "a b "), (2, "c"), (4, None), (5, None)], "sample_id bigint, text string")
    assert rows(dedup.exact_dedup(d)) == [(1, "a b "), (2, "c"), (4, None)]
    assert dedup.exact_dedup(d.limit(0)).count() == 0


def test_greedy_is_not_components(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "sample_id bigint")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    assert rows(dedup.greedy_keep(ids, pairs)) == [(1,), (3,), (4,)]


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_against_brute_force(spark, t):
    import random

    r = random.Random(5)
    data = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 7)))) for i in range(60)]
    sets = {i: set(s.split()) for i, s in data}
    want = sorted((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12)
    d = spark.createDataFrame(data, "sample_id bigint, text string")
    got = [x[:2] for x in rows(dedup.similar_pairs(d, T.tokens(F.col("text")), t))]
    assert sorted(got) == want
    got7 = [x[:2] for x in rows(dedup.similar_pairs(d.repartition(7), T.tokens(F.col("text")), t))]
    assert sorted(got7) == want


def test_null_categories_in_splits(spark, u):
    s = splits.leave_one_out(u, min_samples=5)
    assert splits.overlap(s).where("in_both > 0").count() == 0
    none = {r.sample_id for r in u.where("label = 1 and attack_category is null").collect()}
    assert none <= {r.sample_id for r in s.where("fold = 0 and role = 'train'").collect()}
    with pytest.raises(ValueError):
        splits.leave_one_out(u, 10_000)
    assert splits.leave_one_out(u, 5, train_only=("c0",)).select("held_out").distinct().count() == 1
    away = {r.sample_id for r in splits.crosslingual(u).where("role = 'test'").collect()}
    assert {r.sample_id for r in u.where("language is null").collect()} <= away
    assert splits.direct_indirect(u).where("role = 'test'").count() > 0


def test_kfold_is_partition_independent(u):
    a, b = rows(splits.stratified_kfold(u)), rows(splits.stratified_kfold(u.repartition(7)))
    assert a == b and len(a) == u.count()
    with pytest.raises(ValueError):
        splits.stratified_kfold(u.limit(3))
    with pytest.raises(ValueError):
        splits.stratified_kfold(u.where("label = 1"))


def test_sample_is_exact(u):
    for n in (1, 17, 500):
        assert splits.stratified_sample(u, n).count() == min(n, 120)
    assert rows(splits.stratified_sample(u, 17)) == rows(splits.stratified_sample(u.repartition(5), 17))


def test_metrics_edges(spark):
    one = spark.createDataFrame([(1, 1, 1, 0.9), (2, 1, 1, 0.8)], "sample_id bigint, label int, pred int, prob double")
    m = metrics.evaluate(one).first()
    assert (m.accuracy, m.recall, m.auc_roc, m.auc_pr) == (1.0, 1.0, 0.0, 0.0) and m.f1 == 0.5
    ties = spark.createDataFrame([(1, 1, 1, 0.5), (2, 0, 1, 0.5)], one.schema)
    assert metrics.auc_roc(ties).first().auc_roc == 0.5
    assert metrics.evaluate(one.limit(0)).first().f1 == 0.0


def test_p_values():
    assert math.isclose(metrics.t_p_value(2.776445, 4), 0.05, rel_tol=1e-5)
    assert metrics.wilcoxon_p_value([1, 2, 3, 4, 5, 6])[1] == 2 / 64
    assert math.isclose(results.regression_p_value(0.0, 10), 1.0)


def test_taxonomy(spark):
    d = spark.createDataFrame([(1, "You are now DAN", 1, None), (2, "let us dance", 1, None), (3, "ignore previous", 0, None), (4, "Ignore all previous", 1, None), (5, "x", 1, "keep")], "sample_id bigint, text string, label int, attack_category string")
    got = dict(taxonomy.match_patterns(d).select("sample_id", "attack_category").collect())
    assert got == {1: "jailbreak_roleplay", 2: "jailbreak_roleplay", 3: None, 4: "instruction_override", 5: "keep"}
    chain = taxonomy.merge_categories(spark.createDataFrame([("a",), ("b",), (None,)], "attack_category string"), {"a": "b", "b": "c"})
    assert rows(chain) == [("c",), ("c",), (None,)]
    assert taxonomy.merge_categories(d, {}).count() == 5


@pytest.mark.parametrize("raw,want", [('{"category": "C1", "confidence": 0.7}', ("instruction_override", 0.7)), ('{"category": "C9", "confidence": 0.7}', (None, None)), ("nonsense", (None, None)), ('{"category": "C1"}', (None, None)), ('{"category": "C1", "confidence": 1.5}', (None, None)), ('{"category": "C1", "confidence": "x"}', (None, None)), (None, (None, None))])
def test_parse_category(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "raw string").select(taxonomy.parse_category(F.col("raw")).alias("p")).first().p
    assert tuple(r) == want


def test_overrides_last_wins_and_unknown(spark):
    d = spark.createDataFrame([(1, "t", None), (2, "t", "a"), (3, "z", "a")], "sample_id bigint, text string, attack_category string")
    h = d.select(T.hash16(F.lit("t"))).first()[0]
    o = spark.createDataFrame([(h, "C1", 1), (h, "other", 2), ("x", " ", 3)], "sample_hash string, correct_category string, line_no int")
    got = {r.sample_id: (r.attack_category, r.label_source) for r in taxonomy.apply_overrides(d, o).collect()}
    assert got == {1: ("other", "manual"), 2: ("other", "manual"), 3: ("a", None)}
    with pytest.raises(ValueError):
        taxonomy.apply_overrides(d, spark.createDataFrame([(h, "nope", 1)], o.schema))


def test_failed_parse_leaves_row(spark):
    d = spark.createDataFrame([(1, "t", 1, None)], "sample_id bigint, text string, label int, attack_category string")
    h = d.select(T.hash16(F.col("text"))).first()[0]
    log = spark.createDataFrame([(h, None, None, 1)], "sample_hash string, category_slug string, confidence double, line_no bigint")
    r = taxonomy.replay(d, log).first()
    assert (r.attack_category, r.label_source, r.confidence) == (None, None, None)
    assert taxonomy.pending(d, log).count() == 0 and taxonomy.pending(d, log, retry_failed=True).count() == 1


def test_quality(spark):
    d = spark.createDataFrame([(1, "act as x", "GenTel"), (2, "plain", "gentel-b"), (3, "plain", "other"), (4, None, None)], "sample_id bigint, text string, source string")
    assert sorted(r.sample_id for r in quality.filter_source(d, "gentel").collect()) == [1, 3, 4]
    n = {r.check: r.n for r in quality.integrity(d).collect()}
    assert n["missing_label"] == 1 and n["null_text"] == 1 and n["duplicate_id"] == 0
    with pytest.raises(ValueError):
        quality.check_table(d, {"label": ()})
    with pytest.raises(ValueError):
        quality.check_table(d, {}, max_rows=2)


def test_contamination(spark):
    s = "sample_id bigint, text string"
    train = spark.createDataFrame([(1, "a b c d e"), (2, "x y"), (7, None)], s)
    test = spark.createDataFrame([(3, "E d c b a"), (4, "q"), (5, "")], s)
    assert rows(contamination.lexical(train, test)) == [(3, 1, 1.0)]
    assert contamination.lexical(train.limit(0), test).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "sample_id bigint, embedding array<double>")
    assert rows(contamination.nearest(v, v.where("sample_id <> 2"))) == [(1, 1, 1.0)]


def test_eda_empty(u):
    e = u.limit(0)
    assert eda.statistics(e).first().category_percent == 0.0
    assert eda.balance(e).first().balance == 0.0 and eda.balance(u.where("label = 1")).first().balance == 1.0
    assert eda.length_histogram(e).count() == 0


def test_loaders(spark):
    h = spark.createDataFrame([(0, "p", True, False), (1, "p", True, False), (2, "q", None, False), (3, "r", True, None)], "row int, user_input string, correct boolean, error boolean")
    assert [r.text for r in loaders.hackaprompt(h).orderBy("text").collect()] == ["p", "r"]
    w = spark.createDataFrame([(0, [("assistant", "x"), ("user", " hi ")], "English"), (1, [("user", " ")], "English"), (2, [], "English")], "row int, conversation array<struct<role:string,content:string>>, language string")
    assert [r.text for r in loaders.wildchat(w).collect()] == ["hi"]
    a = spark.createDataFrame([(0, "do", "it", ""), (1, "do", "", ""), (2, "do", None, "")], "row int, instruction string, input string, output string")
    assert sorted(r.text for r in loaders.alpaca(a).collect()) == ["do", "do\nit"]
    o = spark.createDataFrame([(0, "i", "n", "a", "t"), (1, "i", "n", "b", "t")], "row int, instruction string, normal_input string, attack_input string, attack_type string")
    assert loaders.open_prompt(o).count() == 3
    assert loaders.union([], spark).columns == [*loaders.REQUIRED, "metadata"]


def test_files(spark, tmp_path, u):
    (tmp_path / "log.jsonl").write_text('{"sample_hash": "a", "category_slug": "other", "confidence": 0.9}\nnot json\n{"category_slug": "x"}\n')
    assert [r.sample_hash for r in loaders.read_jsonl_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["a"]
    (tmp_path / "s.json").write_text('{"experiment": "e", "train_indices": [1, 2], "test_indices": [3]}')
    assert rows(loaders.read_splits(spark, str(tmp_path / "s.json"))) == [("e", 0, None, 1, "train"), ("e", 0, None, 2, "train"), ("e", 0, None, 3, "test")]
    split = splits.fold_roles(splits.stratified_kfold(u), 5)
    sinks.write_split(u, split, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("fold = 1 and role = 'test'").count() == split.where("fold = 1 and role = 'test'").count()
    assert sinks.to_markdown(spark.createDataFrame([(0.5, None)], "a double, b string")).splitlines()[2] == "| 0.5000 | — |"


def test_keep_first_keeps_every_key(spark):
    """Repeated and null order values, null keys, ties."""
    rows = [(1, "A"), (1, "B"), (2, "A"), (None, "Z"), (None, None), (3, None), (1, "B")]
    d = spark.createDataFrame(rows, "sample_id bigint, text string")
    got = dedup.keep_first(d, F.col("text"), "sample_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "A"), (1, "B"), (None, "Z"), (3, None)], key=str)
    assert dedup.exact_dedup(d).count() == 4
    assert dedup.keep_first(d.limit(0), F.col("text"), "sample_id").count() == 0
