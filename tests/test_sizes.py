"""Shapes that only larger tables have: folders of files, patterns that leave no detector, many ranges."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from antigen.operators import baselines, features, sampling
from antigen.plans import registry, run_queries
from antigen.streaming import twins
from tests.oracle import SF, connect, differences


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Vectors in a folder of files, so many that every candidate is near a self pattern."""
    d = str(tmp_path_factory.mktemp("crowded"))
    value = lambda i: F.when(F.xxhash64("id", F.lit(i)) % 2 == 0, 1.0).otherwise(-1.0) + F.col("id") / 1e6
    rows = spark.range(24000).select(F.col("id").alias("vec_id"), F.array(*(value(i).cast("float") for i in range(64))).alias("embedding"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    rows.repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["deploy_batch", "deploy_weighted", "stream_score"])
def test_deployed_without_detectors(spark, crowded, name):
    con = connect()
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{crowded}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, crowded).toPandas()
    assert len(got) == 24000 and (name == "deploy_weighted" or all(map(math.isinf, got["score"])))
    assert not differences(got, con.execute(registry.ORACLES[name]).df())


def test_a_folder_of_files_is_streamed_whole(spark, tmp_path):
    spark.range(50).repartition(4).write.parquet(str(tmp_path / "in.parquet"))
    assert twins.drained(twins.stream_of(spark, str(tmp_path / "in.parquet")), str(tmp_path / "out")).count() == 50


def test_one_forest_at_a_time_and_one_fit_of_a_model_without_draws(spark, monkeypatch):
    import threading

    fits, at_once, most, lock = [], [0], [0], threading.Lock()

    def scores(train, rows, features, model, y="y", seed=42):
        with lock:
            fits.append((model, seed))
            at_once[0] += model == "rf"
            most[0] = max(most[0], at_once[0])
        rows.count()
        with lock:
            at_once[0] -= model == "rf"
        return rows.withColumn("score", F.col("e00"))

    monkeypatch.setattr(baselines, "scores", scores)
    got = run_queries.baseline_metrics(spark, SF, ["lr", "rf"], [1, 2, 3]).collect()
    assert sorted(fits) == [("lr", 1), ("rf", 1), ("rf", 2), ("rf", 3)] and most[0] == 1
    assert {(r.run, r.seed, r.target) for r in got} == {(m, s, t) for m in ("lr", "rf") for s in (1, 2, 3) for t in (0.05, 0.25)}


def test_trees_stay_with_the_executors():
    for model in ("dt", "rf"):
        assert baselines.MODELS[model](1).getCacheNodeIds()


@pytest.mark.parametrize("ordered", [1 << 20, 400, 1])
def test_column_quantiles_by_brute_force(spark, monkeypatch, ordered):
    import numpy as np

    monkeypatch.setattr(features, "ORDERED", ordered)
    monkeypatch.setattr(features, "COLUMN_CELLS", 64)
    rng = np.random.default_rng(5)
    data = {"even": rng.normal(size=3000), "ties": np.round(rng.normal(size=3000), 1), "one": np.full(3000, 4.0), "gaps": rng.lognormal(size=3000)}
    rows = [tuple(None if c == "gaps" and i % 7 == 0 else float(x[i]) for c, x in data.items()) + (None,) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*data, "none"]))
    data["gaps"] = np.array([x for i, x in enumerate(data["gaps"]) if i % 7])
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.feature, r.share): r.value for r in features.column_quantiles(df, [*data, "none"], shares).collect()}
    assert got == {(c, s): pytest.approx(float(np.quantile(x, s)), abs=1e-12) for c, x in data.items() for s in shares}


def test_pair_counts_bin_as_columns_do(spark):
    rows = [(float(i % 17), None if i % 5 == 0 else i % 13 / 3, i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    edges = {"a": [1.0, 4.5, 16.0], "b": [0.0, 2.0]}
    bins = df.select("y", *(features.binned(f, e) for f, e in edges.items()))
    for pairs in ([("a", "b"), ("a", "y")], [("b", "b")]):
        got = {tuple(r) for r in features.pair_counts(df, pairs, edges).collect()}
        assert got == {tuple(r) for r in features.pair_counts(bins, pairs).collect()}
        assert got == {(a, b, *r) for a, b in pairs for r in bins.select(F.col(a).alias("x"), F.col(b).alias("z")).groupBy("x", "z").count().collect()}
    with pytest.raises(Exception, match="0 to 99"):
        features.pair_counts(spark.createDataFrame([(100, 1)], "a int, y int"), [("a", "y")]).collect()


def test_splits_move_no_rows_and_count_copies(spark):
    """Places by brute force, also where copies of one key lie on both sides of an end, and where a stratum is missing."""
    rows = [(f"k{i}", "ab"[i % 2]) for i in range(999)] + [("same", "c")] * 10 + [("x", None), ("y", None), ("z", None)]
    for own in (rows, [r for r in rows if r[0] != "same"]):
        df = spark.createDataFrame(own, "id string, g string")
        got = {(r.g, r.split): r["count"] for r in sampling.stratified_split(df, "g", 0.3, 0.2, 42).groupBy("g", "split").count().collect()}
        for g in ("a", "b", *(["c"] if len(own) == len(rows) else [])):
            n = sum(r[1] == g for r in own)
            t = math.floor(n * 0.3 + 0.5)
            v = math.floor((n - t) * 0.2 + 0.5)
            assert [got[g, s] for s in ("test", "validation", "train")] == [t, v, n - t - v]
    plan = sampling.stratified_split(df, "g", 0.3, 0.2, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


@pytest.mark.parametrize("size", [1 << 18, 50, 1])
def test_neighbour_information_where_radii_reach_over_ranges(spark, monkeypatch, size):
    """By brute force: rare classes whose radii span many ranges, classes that ranges lack, ties, and a class of one row."""
    import numpy as np

    from antigen.operators import neighbours

    for name, value in (("RANGE", size), ("STEP", 4), ("PIECE", 16), ("CHUNK", 100)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(9)
    data = {
        "rare": ([*rng.normal(size=400), -9.0, 0.0, 9.0, 50.0, 7.0], ["a"] * 400 + ["b"] * 4 + ["c"]),
        "apart": ([*rng.normal(size=150), *rng.normal(1000, 1, 150), *rng.normal(500, 300, 20)], ["a"] * 150 + ["b"] * 150 + ["a"] * 20),
        "ties": (rng.integers(0, 9, 300).astype(float).tolist(), rng.choice(["a", "b"], 300, p=[0.9, 0.1]).tolist()),
    }
    rows = [(f, float(x), y) for f, (xs, ys) in data.items() for x, y in zip(xs, ys)] + [("rare", None, "a"), ("none", None, "a"), ("one", 1.0, "a")]
    df = spark.createDataFrame(rows, "feature string, x double, y string").repartition(3)
    got = {r.feature: r.mi for r in features.knn_information(df).collect()}
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    want = {}
    for f, (xs, ys) in data.items():
        kept = [(x, y) for x, y in zip(xs, ys) if ys.count(y) > 1]
        terms = []
        for i, (x, y) in enumerate(kept):
            same = sorted(abs(v - x) for j, (v, c) in enumerate(kept) if c == y and j != i)
            k = min(3, len(same))
            terms.append(psi(k) - psi(len(same) + 1) - psi(sum(x - r <= v <= x + r for r in [same[k - 1] * (1 - 1e-9)] for v, _ in kept)))
        want[f] = pytest.approx(max(0.0, psi(len(kept)) + sum(terms) / len(terms)), abs=1e-9)
    assert got == want


def test_digamma_of_large_counts():
    import numpy as np

    from antigen.operators.neighbours import digamma

    n = np.array([1, 2, 31, 32, 33, 1000, 10**6])
    assert digamma(n) == pytest.approx([-0.5772156649015329 + math.fsum(1 / i for i in range(1, m)) for m in n.tolist()], abs=1e-13)


@pytest.mark.parametrize("near", [1 / 128, 1 / 4, -1.0])
def test_splits_find_ends_near_shares_and_elsewhere(spark, monkeypatch, near):
    """Each row's part by brute force, for a large stratum, whose ends the counting pass keeps, and for small ones and copies."""
    monkeypatch.setattr(sampling, "NEAR", near)
    rows = [(f"k{i}", "a") for i in range(30000)] + [(f"s{i}", "b") for i in range(7)] + [("one", "c")] + [("x", None), (None, None)] + [("twice", "a")] * 2
    df = spark.createDataFrame(rows, "id string, g string")
    hashed = df.withColumn("h", sampling.uniform_hash(42, "id")).collect()
    want = {}
    for g in ("a", "b", "c", None):
        own = sorted((r.h, r.id is not None, r.id or "") for r in hashed if r.g == g)
        t = math.floor(len(own) * 0.3 + 0.5)
        v = math.floor((len(own) - t) * 0.2 + 0.5)
        want |= {(g, key if known else None): "test" if i < t else "validation" if i < t + v else "train" for i, (_, known, key) in enumerate(own)}
    reads = []
    monkeypatch.setattr(sampling, "materialized", lambda d, whole=sampling.materialized: (reads.append(d), whole(d))[1])
    got = sampling.stratified_split(df, "g", 0.3, 0.2, 42).collect()
    assert len(got) == len(rows) and {(r.g, r.id): r.split for r in got} == want
    if near > 0:  # the pass that counts keeps the rows of the ends of the large stratum
        assert reads[0].where("_p IS NOT NULL AND _by = 'a'").count() > 0
