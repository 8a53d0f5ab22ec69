"""Forests whose trees stay with the tasks, by brute force and beside MLlib's."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from antigen.operators import baselines, forest
from antigen.plans import registry


def rows(spark, n=400, seed=3):
    """Two features, so that each node chooses among both; the last rows are copies."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 2)), 1)
    y = (x[:, 0] + rng.normal(size=n) > 1).astype(int)
    data = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data + [(n + i, *r[1:]) for i, r in enumerate(data[:20])], "id long, a double, b double, y int").repartition(3)


def plain(x, y, n, depth, s):
    """The share of class 1 for every row that ends in this node, merged: a tree of nested tuples."""
    w = np.array([n[y == c].sum() * s.weight[c] for c in (0, 1)])
    leaf = (w[1] > w[0], w[1] / w.sum())
    best = (1e-13, None, None)
    gini = lambda v: (v**2).sum() / v.sum()
    if depth < s.depth and w.min() > 0:
        for f in range(x.shape[1]):
            for cut in range(s.bins - 1):
                left = x[:, f] <= cut
                sides = [np.array([n[m & (y == c)].sum() * s.weight[c] for c in (0, 1)]) for m in (left, ~left)]
                if min(n[left].sum(), n[~left].sum()) >= s.least:
                    gain = (sum(map(gini, sides)) - gini(w)) / w.sum()
                    if gain > best[0] + 1e-12 * (best[1] is not None):
                        best = (gain, f, cut)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    kids = [plain(x[m], y[m], n[m], depth + 1, s) for m in (left, ~left)]
    return leaf if all(len(k) == 2 for k in kids) and kids[0][0] == kids[1][0] else (best[1], best[2], *kids)


def ends(tree, x):
    while len(tree) > 2:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[1]


@pytest.mark.parametrize("own, block, nodes, held", [(1 << 16, 1 << 16, 1 << 19, 1 << 26), (60, 100, 50, 1), (1, 1000, 1, 1 << 26)])
def test_forest_by_brute_force(spark, monkeypatch, own, block, nodes, held):
    """Whatever is grown by histograms of all tasks, in one task, and however rows and trees are dealt."""
    for name, value in (("OWN", own), ("BLOCK", block), ("NODES", nodes), ("HELD", held)):
        monkeypatch.setattr(forest, name, value)
    df = rows(spark)
    of = RandomForestClassifier(numTrees=9, maxDepth=6, seed=5)
    got = {r.id: r.score for r in forest.scores(df, df, ["a", "b"], of).collect()}
    s, n = forest.settings(df, ["a", "b"], "y", of)
    assert n == 420 and len(got) == 420
    own_rows = df.select("id", "a", "b", "y", F.xxhash64(*df.columns).alias("key")).orderBy("id").toPandas()
    x = np.stack([np.searchsorted(c, own_rows[f]) for f, c in zip("ab", s.cuts)], axis=1)
    y, want = own_rows["y"].to_numpy(), np.zeros(420)
    for t in range(9):
        drawn = forest.draws(own_rows["key"].to_numpy(), t, s)
        some = drawn > 0
        tree = plain(x[some], y[some], drawn[some], 0, s)
        want += [ends(tree, row) / 9 for row in x]
    assert [got[i] for i in own_rows["id"]] == pytest.approx(want.tolist(), abs=1e-9)


def test_forest_is_as_good_as_mllibs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.5 * rng.normal(size=3000) > 1).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, " + ", ".join(f"f{i} double" for i in range(6)) + ", y int")
    train, later, names = df.where("id < 2000"), df.where("id >= 2000"), [f"f{i}" for i in range(6)]
    of = RandomForestClassifier(numTrees=60, maxDepth=12, seed=7, featuresCol="_v", labelCol="y", weightCol="weight")
    ours = {r.id: r.score for r in forest.scores(train, later, names, of).collect()}
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    put = VectorAssembler(inputCols=names, outputCol="_v").transform
    theirs = {r.id: r.score for r in of.fit(put(baselines.class_weighted(train))).transform(put(later)).select("id", vector_to_array("probability")[1].alias("score")).collect()}
    a, b, truth = (np.array([d[i] for i in range(2000, 3000)]) for d in (ours, theirs, dict(enumerate(y))))
    area = lambda v: (v[truth == 1][:, None] > v[truth == 0]).mean()
    assert np.corrcoef(a, b)[0, 1] > 0.95 and abs(area(a) - area(b)) < 0.02 and abs(a.mean() - b.mean()) < 0.02


def test_no_tree_reaches_the_driver(spark, monkeypatch):
    """The query's forests are not MLlib's, which gathers trees, and what a task grew stays in the tasks."""
    def gathers(*_):
        raise AssertionError("a forest was gathered on the driver")

    monkeypatch.setattr(RandomForestClassifier, "_fit", gathers)
    monkeypatch.setitem(baselines.MODELS, "rf", lambda seed, **k: RandomForestClassifier(numTrees=5, maxDepth=20, seed=seed, **k))
    held = []
    monkeypatch.setattr(forest, "tops", lambda *a, whole=forest.tops: (held.append(whole(*a)), held[-1])[1])
    df = rows(spark, 3000)
    assert baselines.scores(df, df, ["a", "b"], "rf").where("score BETWEEN 0 AND 1").count() == 3020
    assert sum(len(t.f) for t in held[0][0]) == 5


@pytest.mark.parametrize("name, runs", [("baseline_grid", 24), ("baseline_compare", 12)])
def test_queries_gather_no_forest(spark, monkeypatch, name, runs):
    """With ten trees rather than 200, as only where they grow is held here."""
    def gathers(*_):
        raise AssertionError("a forest was gathered on the driver")

    monkeypatch.setattr(RandomForestClassifier, "_fit", gathers)
    monkeypatch.setitem(baselines.MODELS, "rf", lambda seed, **k: RandomForestClassifier(numTrees=10, maxDepth=20, seed=seed, **k))
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == runs and any("rf" in tuple(r) for r in got)


def test_labels_and_values_that_a_forest_does_not_take(spark):
    of = RandomForestClassifier(numTrees=3)
    for bad, said in (("SELECT 1.0D AS a, 2 AS y", "labels"), ("SELECT 1.0D AS a, 1 AS y WHERE false", "labels"), ("SELECT CAST(null AS double) AS a, 1 AS y", "missing")):
        with pytest.raises(Exception, match=said):
            forest.scores(spark.sql(bad), spark.sql("SELECT 1.0D AS a"), ["a"], of).collect()
    one = spark.sql("SELECT 1.0D AS a, 1 AS y")
    assert [r.score for r in forest.scores(one, one.select("a"), ["a"], RandomForestClassifier(numTrees=50)).collect()] == [1.0]
