from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from antigen.llm import ann, exact_topk
from antigen.llm.ann import axes_for, best_of, hadamard, nearest
from antigen.llm.exact_topk import bounds, exact_top, segment_statistics

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def table(spark, n: int = 400, dim: int = 24, spread: bool = True):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    if not spread:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0.0, 0) for i, v in enumerate(x)]
    inf, nan = float("inf"), float("nan")
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [inf] + [1.0] * (dim - 1)), (n + 4, [nan] * dim), (n + 5, [1.0, 2.0]), (n + 6, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim), (n + 7, x[5].tolist()), (n + 8, x[5].tolist())]
    x = np.vstack([x, x[5], x[5]])
    ids = np.concatenate([np.arange(n), [n + 7, n + 8]])
    return spark.createDataFrame(rows + [(i, v, 0.0, 0) for i, v in odd], SCHEMA), ids, x.astype(float)


def best(ids, x, i, k):
    score = (x * x[i]).sum(axis=1)
    order = [j for j in np.lexsort((ids, -score)) if j != i]
    return [(int(ids[j]), score[j]) for j in order[:k]]


def test_recall_and_scores(spark):
    for spread in (True, False):
        df, ids, x = table(spark, spread=spread)
        got: dict = {}
        for r in nearest(df, df.where("vec_id % 5 = 0")).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        hits = total = 0
        for i, own in enumerate(ids):
            if own % 5:
                continue
            want = best(ids, x, i, 20)
            found = [got[own][k] for k in sorted(got[own])]
            assert sorted(got[own]) == list(range(1, 21)) and own not in [f[0] for f in found]
            assert found == sorted(found, key=lambda f: (-f[1], f[0]))
            hits += len({w[0] for w in want} & {f[0] for f in found})
            total += 20
        assert hits / total > 0.9


def recall(spark, x, every: int) -> float:
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got: dict = {}
    for r in nearest(df, df.where(f"vec_id % {every} = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    asked = range(0, len(x), every)
    assert all(len(got[i]) == 20 for i in asked)
    return sum(len({w[0] for w in best(np.arange(len(x)), x, i, 20)} & set(got[i])) for i in asked) / (20 * len(asked))


@pytest.mark.parametrize("bucket_rows,rotations", [(40, 1), (10, 2), (0.5, 2)])
def test_recall_of_many_buckets(spark, monkeypatch, bucket_rows, rotations):
    """Buckets of few rows, so that most rows are never compared, with one rotation a table and with two."""
    monkeypatch.setattr(ann, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(ann, "PART", 4000)
    n, dim = 20000, 64
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, dim))[rng.integers(0, 400, n)] + 0.6 * rng.normal(size=(n, dim))
    used = []
    hashing = ann.hashing
    monkeypatch.setattr(ann, "hashing", lambda *a: (used.append(hashing(*a)), used[-1])[1])
    found = recall(spark, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 200)
    axes, probes, _ = used[0][dim][0]
    assert found >= 0.9 and len(axes) == rotations and probes < np.prod([2 * a for a in axes]) / 4, (found, axes, probes)


def test_best_of_by_brute_force():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 3)), 1)  # many ties
    ids = np.concatenate([np.arange(50), np.arange(10)])
    cells = [(np.array([0, 3, 7]), np.arange(20, 40)), (np.array([3, 50]), np.arange(0, 20)), (np.array([5]), np.arange(2))]
    got: dict = {}
    for a, r, s in zip(*best_of(ids, x, ids, x, 4, cells)):
        got.setdefault(int(a), []).append((int(ids[r]), float(s)))
    for q in (0, 3, 5, 7, 50):
        met = [r for asks, rows in cells for r in rows if q in asks and ids[r] != ids[q]]
        want = sorted(((-(x[r] * x[q]).sum(), ids[r]) for r in met))[:8]
        assert [(i, s) for i, s in got[q]] == [(int(i), -s) for s, i in want][: len(got[q])] and len(got[q]) >= min(4, len(met))


def test_recall_of_skewed_lengths(spark):
    n, dim = 40000, 64
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, dim))[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one = x.copy()
    one[7] *= 20
    for x in (one, x * rng.lognormal(size=(n, 1))):
        assert recall(spark, x, 400) > 0.9


def test_vectors_that_repeat_an_id(spark):
    """An id counts once, by its best score, for rows of the search and of the exact one."""
    rng = np.random.default_rng(2)
    rows = [(i % 40, rng.normal(size=8).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(1000, rng.normal(size=8).tolist())], df.schema)
    q = np.array(ask.first().embedding)
    for found, scaled in ((nearest(df, ask, 10), lambda v: v), (exact_top(df, ask, 10), lambda v: np.floor(256 * np.array(v)))):
        by: dict = {}
        for i, v in rows:
            by[i] = max(by.get(i, -1e30), float((scaled(v) * scaled(q)).sum()))
        want = sorted(((-s, i) for i, s in by.items()))[:10]
        assert [(r.vec_id, float(r.score)) for r in sorted(found.collect(), key=lambda r: r["rank"])] == [(i, pytest.approx(-s)) for s, i in want]


def test_exact_top_sends_queries_to_few_blocks(spark, monkeypatch):
    """Clustered rows: most blocks cannot reach a query's k-th best score, and the result is exact."""
    monkeypatch.setattr(exact_topk, "BLOCK", 50)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 32)), 50, axis=0) * 5 + 0.1 * rng.normal(size=(2000, 32))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(2000), "embedding": list(x)}))
    sent, pairs = exact_topk.sent, []
    monkeypatch.setattr(exact_topk, "sent", lambda *a: (pairs.append(sent(*a)), pairs[-1])[1])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top(df, df.where("vec_id % 50 = 0")).collect()}
    whole = np.floor(256 * x)
    for i in range(0, 2000, 50):
        assert [got[i, k] for k in range(1, 6)] == [(a, int(b)) for a, b in best(np.arange(2000), whole, i, 5)]
    assert pairs[0].count() == 40 and pairs[1].count() < 40 * 20


def test_few_candidates_ties_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, 2, 0)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 0")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_exact_top_keeps_large_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [1e6, 3.5]), (3, [-3e5, 1e5]), (4, [2.0**24, 1.0]), (5, [-(2.0**60), 0.0]), (6, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top(df.where("vec_id < 5"), df.where("vec_id in (1, 2)"), 3).collect()}
    scaled = {i: [int(256 * v) for v in x] for i, x in rows}
    for q in (1, 2):
        want = sorted((-sum(a * b for a, b in zip(scaled[i], scaled[q])), i) for i in range(1, 5) if i != q)
        assert [got[q, k] for k in (1, 2, 3)] == [(i, -n) for n, i in want]
    one = exact_top(df.where("vec_id in (2, 3, 5, 6)"), df.where("vec_id = 2"), 2).collect()  # 5 is far under a long and not asked for
    assert sorted(r.vec_id for r in one) == [3, 6]
    over = spark.createDataFrame([(9, [2.0**50, 1.0])], df.schema)
    for few in (df.where("vec_id in (2, 5)"), df.where("vec_id = 2").union(over)):
        with pytest.raises(Exception, match="exceeds a long"):
            exact_top(few, df.where("vec_id = 4"), 3).collect()


def test_exact_top(spark):
    df, ids, x = table(spark)
    whole = np.floor(256 * x)
    zero = (np.append(ids, 402), np.vstack([whole, np.zeros(whole.shape[1])]))
    got: dict = {}
    for r in exact_top(df, df.where("vec_id % 4 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for i, own in enumerate(zero[0]):
        if own % 4 == 0:
            assert [got[own][k] for k in range(1, 6)] == [(a, int(b)) for a, b in best(*zero, i, 5)], own
    assert exact_top(df.limit(0), df).count() == 0 and exact_top(df, df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = np.floor(100 * rng.normal(size=(40, 30))), np.floor(100 * rng.normal(size=(50, 30)))
    for n in (1, 4, 16, 64):
        assert (bounds(segment_statistics(a, n), segment_statistics(b, n)) >= a @ b.T - 1e-6).all()


def test_rotations_keep_lengths():
    x = np.random.default_rng(2).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert axes_for(100, 64) == [4] and np.prod([2 * n for n in axes_for(10**9, 64)]) > 10**6
