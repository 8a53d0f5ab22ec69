"""Tries and multi-index hashing against the plain product."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antigen.functions import bits
from antigen.operators import matching
from antigen.operators.matching import Jaccard, Weighted, hamming, nearest, nearest_hamming, parts_of, within


def frame(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "pattern long").repartition(3)


def plain(a: int, b: int, measure) -> float:
    if isinstance(measure, Weighted):
        return sum(w for i, w in enumerate(measure.weights) if (a ^ b) >> i & 1)
    return 1 - (bin(a & b).count("1") / bin(a | b).count("1") if a | b else 0.0)


MEASURES = [
    Weighted(tuple(bits.normalized([float((i * 7) % 11 + 1) for i in range(11)]))), Weighted(tuple(bits.normalized([0.0, 0.0, 5.0, 1.0, 0.2, 0.1, 0.05]))), hamming(9), Jaccard(10), Jaccard(3),
]


@pytest.mark.parametrize("measure,rows", [(MEASURES[0], 0), *((m, 200_000) for m in MEASURES[1:])])
def test_trie_by_hand(spark, monkeypatch, measure, rows):
    """With broadcast levels, and without."""
    monkeypatch.setattr(matching, "BROADCAST_ROWS", rows)
    rnd = random.Random(measure.k)
    own = [rnd.randrange(1 << measure.k) for _ in range(60)] + [0, 0, (1 << measure.k) - 1]
    other = [rnd.randrange(1 << measure.k) for _ in range(25)] + [0]
    got = {r.bits: r.distance for r in nearest(frame(spark, own), frame(spark, other), measure).collect()}
    assert got == {a: pytest.approx(min(plain(a, b, measure) for b in other), abs=1e-12) for a in own}
    for most in (0.0, 0.35, 3.0):
        got = sorted(r.bits for r in within(frame(spark, own), frame(spark, other), measure, most).collect())
        assert got == sorted({a for a in own if min(plain(a, b, measure) for b in other) <= most + 1e-12}), most
    assert nearest(frame(spark, own), frame(spark, []), measure).count() == 0 and within(frame(spark, []), frame(spark, other), measure, 1.0).count() == 0


@pytest.mark.parametrize("k,n", [(12, 300), (12, 1), (20, 3), (40, 50), (5, 32), (1, 1)])
def test_multi_index_by_hand(spark, k, n):
    rnd = random.Random(k)
    own, other = [rnd.randrange(1 << k) for _ in range(80)], [rnd.randrange(1 << k) for _ in range(n)]
    got = {r.bits: r.distance for r in nearest_hamming(frame(spark, own), frame(spark, other), k).collect()}
    assert got == {a: min(bin(a ^ b).count("1") for b in other) for a in own}
    assert sum(w for _, w in parts_of(k, n)) == k


def test_lookups_run_out(spark, monkeypatch):
    monkeypatch.setattr(matching, "LOOKUPS", 12)
    test_multi_index_by_hand(spark, 20, 3)
    assert nearest_hamming(frame(spark, [1]), frame(spark, []), 4).count() == 0


def test_large_sides_without_a_product(spark):
    """Twenty bits, 100,000 patterns and 100,000 detectors: no plan pairs all of both sides."""
    word = lambda s: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(1 << 20)).alias("pattern")
    own, other = spark.range(100_000).select(word("own")), spark.range(100_000).select(word("other"))
    found = nearest_hamming(own, other, 20)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = found.where("bits % 500 = 0").toPandas()
    assert found.count() == own.distinct().count()
    d = np.array([r.pattern for r in other.distinct().collect()], np.int64)
    want = [int(np.bitwise_count(np.int64(b) ^ d).min()) for b in got["bits"]]
    assert len(got) > 100 and got["distance"].tolist() == want
