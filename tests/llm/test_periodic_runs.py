from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from antigen.llm.periodic_runs import find_runs, op13_periodic_runs, periodic_runs, planted, scales, window_minima
from tests.llm.cases import docs, empty


def runs_by_hand(words: list) -> list[tuple[int, int, int]]:
    """Every lag and every stretch of it; of one stretch the smallest lag counts."""
    found: dict = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def sample(rnd: random.Random) -> list[int]:
    n, kinds = rnd.randint(0, 260), rnd.choice([1, 2, 3, 5, 50])
    words = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(rnd.randint(0, 4) if n >= 30 else 0):  # stretches of two and a half turns or more
        p, a = rnd.randint(1, n // 3), rnd.randrange(n)
        for i in range(a + p, min(n, a + int(p * rnd.uniform(2.5, 6)))):
            words[i] = words[i - p]
    if rnd.random() < 0.2:  # runs within the periods of others
        inner = words[: rnd.randint(1, 20)] * rnd.randint(1, 9) + [7] * rnd.randint(0, 3)
        words = (inner * rnd.randint(1, 6))[:260]
    return words


def test_runs_by_hand():
    rnd, total = random.Random(11), 0
    for _ in range(60):
        texts = [sample(rnd) for _ in range(rnd.randint(0, 12))]
        want = [runs_by_hand(t) for t in texts]
        assert find_runs([np.array(t, np.int64) for t in texts]) == want
        total += sum(map(len, want))
    assert total > 200


def test_borders_of_every_scale():
    """Periods around each scale's ends, in runs just long enough and a word too short."""
    for below, gram, _ in scales(2000):
        for p in {below, below + 1, gram, gram + 1}:
            for length in (3 * p, 3 * p - 1, 3 * p + 1):
                words = [10**6 + i for i in range(17)] + [i % p for i in range(length)] + [2 * 10**6 + i for i in range(9)]
                want = [(17, length, p)] if length >= max(24, 3 * p) else []
                assert find_runs([np.array(words, np.int64)]) == [want], (p, length)


def test_window_minima_by_hand():
    rng = np.random.default_rng(2)
    for width in range(1, 20):
        v = rng.integers(0, 6, 60).astype(np.uint64)
        assert window_minima(v, width).tolist() == sorted({i + int(np.argmin(v[i : i + width])) for i in range(60 - width + 1)})


def expected(doc_id, text, plan) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plan and n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *first, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_every_awkward_case(spark):
    d = docs(spark)
    rows = [r for r in d.collect() if len(r.text or "") < 60_000]  # by hand a very long text takes minutes
    for plan in (None, planted):
        got = [r for r in periodic_runs(d, plan=plan).collect() if r.doc_id != 12]
        want = [(r.doc_id, *expected(r.doc_id, r.text, plan)) for r in rows if r.doc_id != 12]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert periodic_runs(empty(spark)).count() == 0
    odd = d.withColumnsRenamed({"doc_id": "runs", "text": "period"}).select("*", *(d[c].alias(f"{c}_") for c in ("id", "size")))
    assert periodic_runs(odd, "runs", "period").count() == d.count()


def test_very_long_run(spark):
    text = "a b c d e f g h i " * 40_000 + "end"
    r = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 360_000, 9, 40_000_000) and r.collapsed_sha256 == hashlib.sha256(b"a b c d e f g h i end").hexdigest()


def test_query_by_hand(spark):
    """The query itself, on texts short enough for the plain version."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op13_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    short = [i for i, t in texts.items() if len(t or "") < 4000]
    assert len(short) > 100 and {i: got[i] for i in short} == {i: expected(i, texts[i], True) for i in short}
