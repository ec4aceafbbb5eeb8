"""The passes of the n-gram join behind the first links."""

import random

from pyspark.sql import functions as F

from sievework.llm import partenum


def near_misses(spark, n):
    """Pairs of texts whose shingle sets share about three quarters, and texts like no other."""
    r, rows = random.Random(3), []
    for i in range(n):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for at in range(0, 300, 36):
            words[at] = f"v{r.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_pairs_are_found_in_a_few_parts(spark):
    """Pairs that share many signatures and are no links: their rows do not grow with the number of buckets."""
    docs = near_misses(spark, 20)
    rows = partenum._documents(docs, "doc_id", "text", 5)
    reps = rows.select("set", F.col("n_shingles").alias("n"), "short")
    met = partenum._collisions(partenum._signed(docs, "text", 5, 128))
    none = spark.createDataFrame([], "vertex bigint, label bigint")
    parts = partenum._parts(met, 128)
    pairs = lambda m: [tuple(r) for r in partenum._pairs(m, none, reps, False).collect()]
    few, many = pairs(partenum._unsettled(met, none, parts)), pairs(met)
    assert set(few) == set(many) and few
    assert len(few) <= partenum.FIRST * len(set(few)) < len(many)


def test_components_are_found_again_only_after_new_links(spark, monkeypatch):
    docs = near_misses(spark, 3).union(spark.createDataFrame([(100 + i, " ".join(f"c{k}" for k in range(200)) + f" end{i}") for i in range(3)], "doc_id bigint, text string"))
    calls = []
    real = partenum.components
    monkeypatch.setattr(partenum, "components", lambda edges: calls.append(1) or real(edges))
    found = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs).collect()}
    assert found == {i: i for i in range(6)} | {100: 100, 101: 100, 102: 100}
    assert len(calls) == 1
