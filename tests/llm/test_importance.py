"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    big = [(t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)) for b in range(10_000)]
    gain = [math.floor(1000 * math.log(x)) for x in big]
    rows = []
    for i, x in docs:
        n, f = features(x)
        w = sum(gain[zlib.crc32(g.encode()) % 10_000] for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=str)


def texts():
    r = random.Random(8)
    words = ["The", "of", "é", "ß1", "x9", "Zeit", "日本", "a"] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(200)]
    line = lambda n: r.choice((" ", "-", "\x00", "\n")).join(r.choice(words) for _ in range(n))
    out = [None, "", "--- !!!", "one", "one two", "ONE TWO three", "a" * 5000]
    return out + [line(r.randint(15, 60)) for _ in range(120)] + [line(5000)]


@pytest.mark.parametrize("chunk", [None, 7])
def test_resample(spark, chunk, monkeypatch):
    """Also with chunks of seven words, so that runs cross their bounds."""
    from sievework.llm import importance

    docs, target = list(enumerate(texts())), texts()[-30:] + [None]
    docs.append((None, texts()[-5]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("id", F.lit(1)).withColumn("bucket", F.lit("x")).withColumn("score", F.lit(0)).repartition(3)
    if chunk:
        monkeypatch.setattr(importance, "CHUNK_WORDS", chunk)
        from sievework.llm import arrays
        import numpy as np
        import pyarrow as pa

        total = np.zeros(importance.BUCKETS, np.int64)
        for block in arrays.blocks(pa.array([t for _, t in docs])):
            for _, name, bucket in importance.tuples(*importance._words(block)):
                np.add.at(total, bucket[name], 1)
        want = Counter(zlib.crc32(f.encode()) % 10_000 for _, t in docs for f in features(t)[1])
        assert dict(want) == {int(b): int(total[b]) for b in np.flatnonzero(total)}
        return
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), percent=20)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str)
    assert got == brute(docs, target, 20)


def test_repeated_rows_are_drawn_each(spark):
    from sievework.llm.importance import resample

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text)] * 50 + [(i, text + f" x{i}") for i in range(50)]
    got = resample(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(text,)], "text string"), percent=60).collect()
    assert len(got) == 100 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61))
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert all((a.score, -a.doc_id) >= (b.score, -b.doc_id) for a, b in zip(drawn, drawn[1:], strict=False))


def test_empty_tables_and_other_ids(spark):
    from sievework.llm.importance import resample

    docs = spark.createDataFrame([], "doc_id bigint, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample(docs, target).count() == 0
    some = spark.createDataFrame([("p", " ".join("abcdefghijklmnopqrstuvwxyz")), ("q", None)], "`my.id` string, body string")
    got = {r["my.id"]: r for r in resample(some, target.limit(0), percent=100, id_col="my.id", text_col="body").collect()}
    assert got["p"]["rank"] == 1 and got["q"]["rank"] is None and got["q"]["weight"] == 0
    with pytest.raises(ValueError, match="score"):
        resample(some.withColumnRenamed("my.id", "score"), target, id_col="score", text_col="body")


def test_crc32_in_sql():
    import duckdb

    from sievework.llm.shared import crc32_sql

    for t in ("", "a", "héllo wörld", "日本 x"):
        assert duckdb.connect().execute(f"select {crc32_sql(repr(t))}").fetchall() == [(zlib.crc32(t.encode()),)]
