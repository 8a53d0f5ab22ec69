from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from antigen.llm.common import Steps
from antigen.llm.mixing import WEIGHTS, draws, mixed_texts, mixture, place, sized, taken_pieces, targets, words_of
from tests.llm.cases import docs, empty


def shared(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "B": 70, "ä": 0, None: 33}, {"x": 5}, {"a": 1, "b": 1, "c": 1000}):
        got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = shared(sizes)
        assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_mixture(spark):
    rows = mixture(docs(spark)).collect()
    assert len(rows) == docs(spark).count()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
        assert 0 <= r.taken <= 3 * r.size
    want = shared(size)
    for s in size:
        of = [r for r in rows if r.source == s]
        assert {r.source_size for r in of} == {size[s]}
        assert abs(of[0].target - want[s]) < 1e-6 and abs(sum(r.taken for r in of) - want[s]) <= 0.5
    again = mixture(docs(spark).repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source or "", r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixture(empty(spark)).count() == 0


def test_each_pass_takes_every_block_once(spark):
    q = spark.createDataFrame([("a", 10_500, 25_000.0), ("b", 64, 64.0), ("c", 0, 0.0)], "source string, source_size long, target double")
    got = draws(q, Steps(spark), block_words=64, shard_blocks=16).collect()
    for s, size, target in (("a", 10_500, 25_000), ("b", 64, 64)):
        own = [r for r in got if r.source == s]
        assert sum(r.take for r in own) == target
        first = sorted(r.block for r in own if r["pass"] == 0)
        assert first == list(range(-(-size // 64)))
    slots = {n: sum(r.shard == n for r in got) for n in {r.shard for r in got}}
    assert sorted(slots) == list(range(-(-len(got) // 16))) and all(n == 16 for s, n in slots.items() if s < max(slots))


def test_shards_are_multinomial_draws(spark):
    sizes = {"a": 64_000, "b": 32_000, "c": 16_000, None: 48_000}
    q = spark.createDataFrame([(s, n, float(n)) for s, n in sizes.items()], "source string, source_size long, target double")
    counts: dict = {}
    for r in draws(q, Steps(spark), block_words=16, shard_blocks=100).collect():
        counts.setdefault(r.shard, Counter())[r.source] += 1
    assert len(counts) == 100 and all(sum(c.values()) == 100 for c in counts.values())
    for s, n in sizes.items():
        assert sum(c[s] for c in counts.values()) == n // 16
        p, own = n / 160_000, [counts[i][s] for i in range(90)]  # the last shards settle the totals
        spread = sum((x - 100 * p) ** 2 for x in own) / 90
        assert 0.5 < spread / (100 * p * (1 - p)) < 1.6, (s, spread)


def test_orders_differ_by_source_and_pass(spark):
    q = spark.createDataFrame([(s, 64 * 200, 64 * 600.0) for s in "abcdefgh"], "source string, source_size long, target double")
    orders: dict = {}
    for r in sorted(draws(q, Steps(spark), block_words=64, shard_blocks=64).collect(), key=lambda r: r.draw):
        orders.setdefault((r.source, r["pass"]), []).append(r.block)
    assert all(sorted(o) == list(range(200)) for o in orders.values())
    strides = {(o[2] - o[1]) % 199 for o in orders.values()}
    assert len(orders) == 24 and len({tuple(o) for o in orders.values()}) == 24 and len(strides) > 12


def mixed_by_hand(rows: list, drawn: list, block_words: int) -> dict:
    """Counts the words that each draw takes, one by one, over the streams written out in full."""
    streams: dict = {}
    for r in sorted((r for r in rows if r.size), key=lambda r: r.start):
        streams.setdefault(r.source, []).extend([(r.doc_id, r.text_hash, r.start)] * r.size)
    taken: Counter = Counter()
    for d in drawn:
        taken.update(streams[d.source][d.block * block_words :][: d.take])
    return taken


def test_taken_words_by_brute_force(spark):
    steps = Steps(spark)
    rows = steps(sized(docs(spark), "doc_id", "text", "source"))
    placed = steps(place(rows, rows.count()))
    quotas = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    drawn = steps(draws(quotas, steps, 100, 16))
    want = mixed_by_hand(placed.collect(), drawn.collect(), 100)
    got = taken_pieces(placed, drawn, 100).groupBy("source", "start").agg(F.sum("words").alias("n")).collect()
    assert {(r.source, r.start): r.n for r in got} == {(p.source, p.start): want[p.doc_id, p.text_hash, p.start] for p in placed.collect() if p.size and want[p.doc_id, p.text_hash, p.start]}


def test_mixed_texts_take_any_names(spark):
    d = docs(spark).where("doc_id is not null")
    odd = d.select("*", *(F.lit(7).alias(c) for c in ("_h", "_c", "row", "parts", "n", "copy", "s", "i", "_text_hash")))
    out = mixed_texts(odd)
    assert out.columns == odd.columns and out.where("_h <> 7 or `row` <> 7 or n <> 7").count() == 0
    assert out.count() == mixed_texts(d).count() and mixed_texts(d.limit(0)).count() == 0


def test_mixed_texts_hold_the_taken_words(spark):
    d = docs(spark).where("doc_id is not null")
    out = mixed_texts(d)
    assert out.columns == d.columns
    taken = {(r.doc_id, r.source): r.n for r in mixture(d).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    got = {(r.doc_id, r.source): r.n for r in out.groupBy("doc_id", "source").agg(F.sum(words_of("text")).alias("n")).collect()}
    assert got == taken
    known = {w for r in d.collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")}
    assert all(w in known for r in out.collect() for w in r.text.split(" ") if w.strip() and " " not in w and not re.search(r"[\t-\r]", w))
