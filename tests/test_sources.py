"""Lines in order, the versioned table, the labelling log, safe reading, loaders' metadata, languages."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from sievework.functions import profiles
from sievework.operators import labelling, quality, taxonomy
from sievework.sources import lines, loaders, versioned


def test_lines_keep_their_order(spark, tmp_path):
    """Over files of different sizes (listed by size) that are cut into many splits: the last line of a key wins."""
    want = {}
    for f, n in (("a.jsonl", 10), ("b.jsonl", 3000), ("c.jsonl", 200)):
        with open(tmp_path / f, "w") as out:
            for k in range(n):
                want[f"h{k % 7}"] = f"{f}-{k}"
                out.write(json.dumps({"sample_hash": f"h{k % 7}", "category_slug": f"{f}-{k}", "confidence": 0.5}) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = loaders.read_jsonl_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 4
        assert {r.sample_hash: r.category_slug for r in taxonomy.last_answers(log).collect()} == want
        ordered = [r.value for r in lines.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered == [x for f in "abc" for x in open(tmp_path / f"{f}.jsonl").read().splitlines()]


def test_overrides_are_in_order(spark, tmp_path):
    for name, slug in (("1.csv", "other"), ("2.csv", "social_engineering")):
        (tmp_path / name).write_text("sample_hash,correct_category\nx," + slug + "\ny, \n")
    o = loaders.read_overrides(spark, str(tmp_path))
    assert o.groupBy("sample_hash").agg(F.max_by("correct_category", "line_no").alias("c")).collect()[0].c == "social_engineering"


SCHEMA = "k bigint, v string"


def table(spark, path, buckets=4):
    return versioned.VersionedTable(spark, f"file://{path}/t", "k", SCHEMA, buckets)


def test_upsert(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and t.read().count() == 0
    assert t.upsert(spark.createDataFrame([(i, f"a{i}") for i in range(50)] + [(None, "lost")], SCHEMA)) == 1
    rows = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (70, "z", 1)], SCHEMA + ", n int")
    assert t.upsert(rows, order="n") == 2
    now = {r.k: r.v for r in t.read().collect()}
    assert now == {i: f"a{i}" for i in range(50)} | {3: "y", 70: "z"}
    assert t.read(1).where("k = 3").first().v == "a3" and t.read(1).count() == 50
    assert t.upsert(rows.limit(0)) == 2
    # only the buckets of the new rows have new folders
    assert sum(t._manifest(1)[b] != f for b, f in t._manifest(2).items() if b in t._manifest(1)) <= 2


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    failed = []

    def write(w):
        try:
            table(spark, tmp_path).upsert(spark.createDataFrame([(i, f"w{w}") for i in range(w * 10, w * 10 + 15)], SCHEMA))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    t = table(spark, tmp_path)
    assert not failed and t.version() == 5
    now = {r.k: r.v for r in t.read().collect()}
    assert now.keys() == set(range(55)) and t.read().count() == 55
    assert all(now[k] in {f"w{w}" for w in range(5) if w * 10 <= k < w * 10 + 15} for k in now)


def test_killed_task_loses_and_repeats_no_answer(spark, tmp_path):
    """A task is killed in the middle, and with it the run: the next one asks only for what has no answer."""
    asked = tmp_path / "asked"
    asked.mkdir()
    log = f"file://{tmp_path}/log"
    df = spark.createDataFrame([(i, 1, f"text {i % 20}", "other" if i == 25 else None) for i in range(26)] + [(30, 0, "benign", None)], "sample_id bigint, label int, text string, attack_category string")

    other = next(k for k, v in taxonomy.SLUG_OF.items() if v == "other")

    def provider(die):
        def answer(texts):
            out = []
            for t in texts:
                if die and len(os.listdir(asked)) >= 8:
                    os._exit(1)
                with open(asked / f"{t.replace(' ', '-')}-{os.urandom(4).hex()}", "w"):
                    pass
                out.append(json.dumps({"category": other, "confidence": 0.9 if t != "text 3" else 0.2}) if t != "text 4" else "no idea")
            return out

        return answer

    with pytest.raises(Exception):  # noqa: B017
        labelling.ask_pending(df, log, provider(True), tasks=3)
    first = len(os.listdir(asked))
    assert 0 < first < 20 and labelling.read_log(spark, log).count() >= first - 3
    once = labelling.label_samples(df, log, provider(False), tasks=3)
    by = {r.sample_id: r for r in once.collect()}
    times = [n.rsplit("-", 1)[0] for n in os.listdir(asked)]
    # an answer that a killed process had not yet given back is asked again, others never
    assert set(times) == {f"text-{i}" for i in range(20)} and len(times) <= 20 + 4
    again = labelling.label_samples(df, log, provider(False))
    assert len(os.listdir(asked)) == len(times) and again.count() == 27
    assert by[0].label_source == "llm" and by[0].attack_category == "other" and by[3].label_source == "uncertain"
    assert by[4].label_source is None and by[25].label_source == "tier1_2" and by[30].label_source is None
    labelling.ask_pending(df, log, provider(False), retry_failed=True)
    assert len(os.listdir(asked)) == len(times) + 1


def test_budget_of_a_run(spark, tmp_path):
    df = spark.createDataFrame([(i, 1, f"t{i}", None) for i in range(10)], "sample_id bigint, label int, text string, attack_category string")
    log = f"file://{tmp_path}/log"
    labelling.ask_pending(df, log, lambda texts: ["x"] * len(texts), max_calls=4, batch=3)
    assert labelling.read_log(spark, log).count() == 4
    assert labelling.label_samples(df, f"file://{tmp_path}/none").count() == 10


def test_safe_reading(spark, tmp_path):
    root = str(tmp_path / "data")
    good = spark.createDataFrame([("t", 1, "s", None, None, "en", False)], ", ".join(loaders.SCHEMA.split(", ")[:7]))
    good.write.parquet(f"{root}/ok.parquet")
    good.drop("source").write.parquet(f"{root}/few.parquet")
    good.write.parquet(f"{root}-other/ok.parquet")
    os.makedirs(f"{root}/bad.parquet")
    (tmp_path / "data" / "bad.parquet" / "x.parquet").write_text("no table")
    assert loaders.read_safely(spark, f"{root}/ok.parquet", root).count() == 1
    assert loaders.read_unified(spark, f"{root}/ok.parquet", root).count() == 1
    for path in (f"{root}-other/ok.parquet", f"{root}/../data-other/ok.parquet"):
        with pytest.raises(ValueError, match="not below"):
            loaders.read_safely(spark, path, root)
    with pytest.raises(FileNotFoundError):
        loaders.read_safely(spark, f"{root}/none.parquet", root)
    for path, more, say in ((f"{root}/ok.parquet", {"max_mb": 0}, "MB"), (f"{root}/ok.parquet", {"max_rows": 0}, "rows"), (f"{root}/few.parquet", {}, "source"), (f"{root}/bad.parquet", {}, "read")):
        with pytest.raises(ValueError, match=say):
            loaders.read_safely(spark, path, root, **more)


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"x": [1, 2]}')
    (tmp_path / "b.yaml").write_text("x:\n  - 1\n")
    (tmp_path / "c.yaml").write_text("")
    assert loaders.read_config(str(tmp_path / "a.json")) == {"x": [1, 2]}
    assert loaders.read_config(str(tmp_path / "c.yaml")) == {}
    assert loaders.read_config(str(tmp_path / "b.yaml")) == {"x": [1]}


def test_metadata_of_loaders(spark):
    one = spark.createDataFrame([(0, "a", 1)], "row int, text string, label int")
    two = spark.createDataFrame([(0, "b", 0), (1, "a", 1)], "row int, text string, label int")
    got = loaders.deepset(loaders.with_splits({"train": one, "test": two})).collect()
    assert sorted((r.text, r.label, r.metadata["split"]) for r in got) == [("a", 1, "test"), ("a", 1, "train"), ("b", 0, "test")]
    p = loaders.pint(spark.createDataFrame([(0, "x", "0.25"), (1, "y", None)], "row int, text string, similarity string")).collect()
    assert [r.metadata for r in sorted(p, key=lambda r: r.text)] == [{"similarity": "0.25"}, {}] and {r.label for r in p} == {1}
    d = loaders.dolly(spark.createDataFrame([(0, " q ", "c", "more"), (1, "r", None, " "), (2, "q", "c", ""), (3, " ", "c", "")], "row int, instruction string, category string, context string")).collect()
    assert {r.text: r.metadata for r in d} == {"q": {"category": "c", "has_context": "true"}, "r": {"has_context": "false"}}
    assert "metadata" not in loaders.drop_metadata(loaders.union([], spark)).columns
    h = loaders.hackaprompt(spark.createDataFrame([(0, "p", True, False), (1, "p", True, None), (2, "q", False, False), (3, "r", None, None)], "row int, user_input string, correct boolean, error boolean"))
    assert [r.text for r in h.collect()] == ["p"] and h.columns == loaders.COLUMNS


def test_issues_of_a_source(spark):
    say = lambda *x: spark.createDataFrame([x], "t bigint, l double, m double").select(quality.issues(F.col("t"), F.col("l"), F.col("m")).alias("i")).first().i
    assert len(say(20_000, 0.6, 0.2)) == 3 and "60.0%" in say(10, 0.6, 0.9)[0] and say(10, 0.5, 0.4) == ["nothing critical"]
    assert say(0, None, None) == ["no rows of this source"]


def test_zero_shot(spark):
    raw = ['{"label": "Injection", "confidence": 0.8}', '{"label": "benign", "confidence": 0.9}', '{"label": "benign"}', "nonsense", None, '{"label": "other", "confidence": 1}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").orderBy("i").select(taxonomy.zero_shot(F.col("raw")).alias("a")).collect()
    assert [(r.a.pred, round(r.a.prob, 6)) for r in got] == [(1, 0.8), (0, 0.1), (0, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)]


def test_languages(spark):
    text = {"xx": "abab abab baba abba", "yy": "xyxy yxyx xyyx yyxx"}
    df = spark.createDataFrame([(k, v) for k, v in text.items()] * 3 + [(None, "abab"), ("xx", None)], "language string, text string")
    p = profiles.learn(df, top=50)
    assert p.languages == ["xx", "yy"]
    ask = spark.createDataFrame([("ABAB  abba",), ("xyyx",), ("qqqq",), ("  ",), (None,), ("ab",)], "text string")
    assert [r.language for r in profiles.identified(ask, p).collect()] == ["xx", "yy", "unknown", "unknown", "unknown", "xx"]
    none = profiles.learn(df.where("language is null"))
    assert {r.language for r in profiles.identified(ask, none).collect()} == {"unknown"}
