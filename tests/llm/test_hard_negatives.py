from __future__ import annotations

import numpy as np
import pytest

from antigen.llm import hard_negatives as hn
from antigen.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score long, slot int"


def by_hand(rows: dict, anchors: list, scale: int = 256) -> list[tuple]:
    v = {i: ([int(np.floor(scale * c)) for c in x], y) for i, (x, y) in rows.items()}
    out = []
    for a in anchors:
        x, y = v[a]
        score = {i: sum(p * q for p, q in zip(x, z)) for i, (z, _) in v.items() if i != a and len(z) == len(x)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][1] == y][:5]:
            window = [i for i in order if v[i][1] != y and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(window)]
    return sorted(out)


def frame(spark, rows: list):
    return spark.createDataFrame([(i, x, y, 0, 0, 0) for i, x, y in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("size", [8192, 40])
@pytest.mark.parametrize("kind", ["spread", "ties", "hot"])
def test_by_hand(spark, monkeypatch, size, kind):
    """Blocks of all rows and of few; many equal scores; one label with a third of the rows, and negative scores."""
    monkeypatch.setattr(hn, "ROWS", size)
    monkeypatch.setattr(hn, "ANCHORS", size // 8)
    rng = np.random.default_rng(9)
    n, dim = 600, 8
    y = rng.integers(0, 6, n)
    x = rng.normal(size=(n, dim)) + (y[:, None] == np.arange(dim)) * 1.5
    if kind == "ties":
        x = np.round(x / 2)
    if kind == "hot":
        y[rng.random(n) < 0.4] = 3
        x[::7] = -np.abs(x[::7])
    rows = {i: (x[i].tolist(), int(y[i])) for i in range(n)}
    df = frame(spark, [(i, *r) for i, r in rows.items()])
    got = sorted(map(tuple, hard_negatives(df, df.where("vec_id % 10 = 0")).collect()))
    assert got == by_hand(rows, list(range(0, n, 10))) and len(got) > 100


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = {0: ([1.0, 2.0], 1), 1: ([1.0, 1.9], 1), 2: ([0.9, 1.8], 2), 3: ([0.0, 0.0], 2), 4: ([-1.0, -2.0], 1), 5: ([1.0, 1.7], 3), 6: ([1.0, 2.0, 3.0], 1), 7: ([1.0, 2.0, 2.5], 2), 8: ([1.0, 2.0, 3.1], 1), 9: ([3.0], 4), 10: ([0.0, 0.0], 9), 11: ([1.0, 2.0], 9)}
    odd = [(20, None, 1), (21, [], 1), (22, [inf, 1.0], 1), (23, [nan, 1.0], 2), (24, [None, 1.0], 2), (25, [1.0, 2.0], None), (None, [1.0, 2.0], 2)]
    twice = [(5, [1.0, 1.7], 3), (5, [2.0, 1.7], 3), (2, [9.0, 9.0], 3)]  # the least label, then vector, stays
    df = frame(spark, [(i, *r) for i, r in good.items()] + odd + twice)
    got = sorted(map(tuple, hard_negatives(df, df).collect()))
    assert got == by_hand(good, list(good)) and {r[0] for r in got} >= {0, 1, 6}
    assert hard_negatives(df.limit(0), df).count() == 0 and hard_negatives(df, df.limit(0)).count() == 0
    alone = frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])
    assert hard_negatives(alone, alone).count() == 0


def test_large_components(spark):
    rng = np.random.default_rng(1)
    rows = {i: ((rng.normal(size=3) * 10.0**e).tolist(), i % 3) for i, e in enumerate([0, 5, 6, 6, 6, 0, 3, 6, 5, 1] * 3)}
    df = frame(spark, [(i, *r) for i, r in rows.items()])
    assert sorted(map(tuple, hard_negatives(df, df, scale=256).collect())) == by_hand(rows, list(rows))
