"""The exact nearest-neighbour join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import contamination
from sievework.operators.neighbours import nearest


def frame(spark, m, first=0, **more):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(m)]
    d = spark.createDataFrame(rows, "sample_id bigint, embedding array<float>")
    for k, v in more.items():
        d = d.withColumn(k, v)
    return d


def brute(train, test):
    """{test place: (train place, similarity)}; both lists may have None and zeros."""
    out = {}
    for j, v in enumerate(test):
        if v is None or not np.any(v):
            continue
        best = None
        for i, w in enumerate(train):
            if w is None or not np.any(w):
                continue
            a, b = np.float32(v).astype(float), np.float32(w).astype(float)
            s = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
            if best is None or s > best[1]:
                best = (i, s)
        if best:
            out[j] = best
    return out


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_nearest(spark, block):
    """Clusters, a large group of equal vectors on both sides, ties, nulls and zeros, with one or many pivots and blocks."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 5))
    train = [*(centres[r.integers(0, 6, 60)] + 0.2 * r.normal(size=(60, 5))), *[centres[0]] * 25, None, np.zeros(5), 2 * centres[1], centres[1]]
    test = [*(centres[r.integers(0, 6, 30)] + 0.3 * r.normal(size=(30, 5))), *[centres[0]] * 20, None, np.zeros(5), centres[1], -centres[2]]
    got = {q.test_id - 1000: (q.train_id, round(q.similarity, 9)) for q in nearest(frame(spark, train).repartition(3), frame(spark, test, 1000).repartition(2), block=block).collect()}
    want = brute(train, test)
    assert got.keys() == want.keys()
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    assert sum(got[k][0] == want[k][0] for k in want) == len(want)


def test_nearest_by_split(spark):
    r = np.random.default_rng(2)
    train, test = r.normal(size=(40, 4)), r.normal(size=(12, 4))
    folds = {f: ([i for i in range(40) if i % 3 != f], [i for i in range(12) if i % 2 == f % 2]) for f in range(3)}
    part = lambda m, k: spark.createDataFrame([(i, str(f), [float(x) for x in m[i]]) for f in folds for i in folds[f][k]], "sample_id bigint, fold string, embedding array<double>")
    got = {(q.fold, q.test_id): q.train_id for q in nearest(part(train, 0), part(test, 1), by="fold", block=5).collect()}
    for f, (a, b) in folds.items():
        want = brute([train[i] for i in a], [test[i] for i in b])
        assert {i: got[str(f), i] for i in b} == {b[k]: a[v[0]] for k, v in want.items()}
    none = part(train, 0).limit(0)
    assert nearest(none, part(test, 1)).count() == 0 and nearest(part(train, 0), none, by="fold").count() == 0


def test_all_splits_in_one_job_equal_single_reports(spark):
    r = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    text = lambda: " ".join(r.choice(words, r.integers(1, 7)))
    data = [(i, text() if i % 17 else None, [float(x) for x in r.normal(size=3)] if i % 13 else None) for i in range(90)]
    df = spark.createDataFrame(data, "sample_id bigint, text string, embedding array<double>")
    split = [("cv", f, i, "test" if i % 4 == f else "train") for f in range(4) for i in range(90)] + [("empty", 0, 1, "train")]
    split = spark.createDataFrame(split, "experiment string, fold int, sample_id bigint, role string")
    got = {q.split_id: q for q in contamination.check_all(df, split, 0.7, 0.97).collect()}
    assert got.keys() == {f"cv_{f}" for f in range(4)}
    for f in range(4):
        train, test = df.where(F.col("sample_id") % 4 != f), df.where(F.col("sample_id") % 4 == f)
        one = contamination.report(train, test, 0.7, 0.97, f"cv_{f}").first()
        assert one == got[f"cv_{f}"]
        sets = {i: frozenset(t.split()) for i, t, _ in data if t}
        similar = {i for i in sets if i % 4 == f and any(j % 4 != f and len(sets[i] & s) >= 0.7 * len(sets[i] | s) - 1e-12 for j, s in sets.items())}
        assert one.lexical_flagged == len(similar)
        a, b = [(i, v) for i, _, v in data if i % 4 != f], [(i, v) for i, _, v in data if i % 4 == f]
        near = brute([v for _, v in a], [v for _, v in b])
        assert one.semantic_flagged == sum(s >= 0.97 for _, s in near.values()) and abs(one.homogeneity - np.mean([s for _, s in near.values()])) < 1e-6
        assert len(one.worst_similarity) == min(3, one.semantic_flagged) and one.passed == (one.total_flagged <= 0.01 * one.n_test)
    with pytest.raises(ValueError):
        contamination.check_all(df, split.where("experiment = 'empty'"))


def test_rows_meet_pivots_in_pieces(spark, monkeypatch):
    """A batch of many rows is never compared with all pivots at once; nothing is lost between the pieces."""
    import pyarrow as pa

    from sievework.operators import neighbours

    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], names=["id"])
    parts = list(neighbours._slices(iter([batch, batch.slice(0, 0)])))
    assert [len(p) for p in parts] == [512, 512, 276] and sum((p.column(0).to_pylist() for p in parts), []) == list(range(1300))
    monkeypatch.setattr(neighbours, "_SENT", 3)
    d = spark.createDataFrame([(i, [float(i % 37), 1.0, float(i % 11)]) for i in range(700)], "sample_id bigint, embedding array<double>").coalesce(1)
    got = neighbours.nearest(d, d, block=20).collect()
    first = {}
    for i in range(700):
        first.setdefault((i % 37, i % 11), i)
    assert {r.test_id: r.train_id for r in got} == {i: first[i % 37, i % 11] for i in range(700)}
