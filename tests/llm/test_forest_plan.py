"""The forest as SQL: small in the plan, and the same scores as a walk through the fitted trees."""

import pytest


def test_forest_is_small_in_the_plan_and_scores_as_its_trees(spark):
    from sievework.llm.secret_scan import FEATURES, _with_features, forest_sql, labelled_findings, language_of, train

    language = language_of({"alpha": 3, "river": 2})
    forest = train(labelled_findings(spark, 900), language, trees=7, depth=6).forest
    rows = _with_features(labelled_findings(spark, 300), language)
    rows = rows.rdd.map(lambda r: [float(x) for x in r.features]).collect()

    def share(n, f):
        while n.getClass().getSimpleName() != "LeafNode":
            n = n.leftChild() if f[n.split().featureIndex()] <= n.split().threshold() else n.rightChild()
        stats = list(n.impurityStats().stats())
        return float(f"{stats[1] / max(sum(stats), 1e-9):.6f}")

    rows = rows[:120]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(rows)], "i int, f array<double>").selectExpr("i", f"{forest_sql(forest)} as score")
    got = {r.i: r.score for r in df.collect()}
    roots = [t._call_java("rootNode") for t in forest.trees]
    for i, f in enumerate(rows):
        assert len(f) == len(FEATURES) and got[i] == pytest.approx(sum(share(n, f) for n in roots) / len(roots), abs=1e-12)
    assert len(set(got.values())) > 5

    nodes, todo = 0, [df._jdf.queryExecution().analyzed().expressions()]
    while todo:
        x = todo.pop()
        for k in range(x.size()):
            nodes += 1
            todo.append(x.apply(k).children())
    assert nodes < 200  # a few for each array, whatever the number and depth of the trees
