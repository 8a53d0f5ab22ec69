from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antigen.llm import fingerprints as fp
from antigen.llm.fingerprints import containment, fingerprints, likeness, merged, shingle_hashes, sketch, sketch_of, text_of
from tests.llm.cases import docs, empty, prose


def by_hand(text: str) -> tuple[int, list[int]]:
    """The sketch from the hashes of all shingles, each hashed by itself."""
    parts = [text[i : i + fp.WIDTH] for i in range(max(1, len(text) - fp.WIDTH + 1))] if text else []
    every = sorted({int(shingle_hashes(np.array([ord(c) for c in p], np.uint32))[0]) for p in parts})
    limit = ((1 << 48) - 1) // fp.SCALE
    if sum(h <= limit for h in every) >= fp.LEAST:
        return limit, [h for h in every if h <= limit]
    return ((1 << 48) - 1, every) if len(every) <= fp.LEAST else (every[fp.LEAST] - 1, every[: fp.LEAST])


def test_sketch_by_hand(monkeypatch):
    rnd = random.Random(5)
    texts = ["", "a", "short", "x" * 8, "y" * 5000, "ab" * 900, "日本語のテキスト🙂" * 30, *(prose(rnd, n) for n in (3, 12, 40, 300, 9000))]
    for chunk in (1 << 20, 100):
        monkeypatch.setattr(fp, "CHUNK", chunk)
        for t in texts:
            limit, kept = sketch(t)
            assert (limit, kept.tolist()) == by_hand(t), (chunk, t[:20])
            again = sketch_of(text_of((limit, kept)))
            assert again[0] == limit and again[1].tolist() == kept.tolist()


def test_fraction_kept():
    text = prose(random.Random(1), 60_000)
    limit, kept = sketch(text)
    n = len({text[i : i + fp.WIDTH] for i in range(len(text) - fp.WIDTH + 1)})
    assert limit == ((1 << 48) - 1) // fp.SCALE and abs(len(kept) * fp.SCALE / n - 1) < 0.15


def test_likeness_and_containment(spark):
    rnd = random.Random(3)
    part, rest = prose(rnd, 2000), prose(rnd, 30_000)
    whole = part + rest
    other = prose(rnd, 30_000)
    a, b, c = sketch(part), sketch(whole), sketch(other)
    shingles = lambda t: {t[i : i + fp.WIDTH] for i in range(len(t) - fp.WIDTH + 1)}
    true = len(shingles(part) & shingles(whole)) / len(shingles(part) | shingles(whole))
    assert abs(likeness(a, b) - true) < 0.03 and likeness(a, a) == 1.0 and likeness(sketch(""), sketch("")) == 1.0 and likeness(sketch(""), a) == 0.0
    rows = [(text_of(a), text_of(b)), (text_of(a), text_of(c)), (text_of(sketch("")), text_of(a)), (None, text_of(a)), (text_of(b), text_of(a))]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(containment("a", "b")).collect()]
    held = lambda x, y: len(shingles(x) & shingles(y)) / len(shingles(x))
    assert got[0] == 1.0 and abs(got[1] - held(part, other)) < 0.1 and got[2] == 1.0 and got[3] is None and abs(got[4] - held(whole, part)) < 0.05


def test_merged_is_the_sketch_of_all(spark):
    rnd = random.Random(4)
    texts = [(g, prose(rnd, n)) for g, n in [("a", 500), ("a", 3000), ("a", 20), ("b", 9000), ("b", 8000)]] + [(None, "one two three four"), ("e", "")]
    rows = [(g, text_of(sketch(t))) for g, t in texts] + [("e", None)]
    got: dict = {}
    for r in merged(spark.createDataFrame(rows, "g string, fingerprint string"), ["g"]).collect():
        got.setdefault(r.g, (r.limit, []))[1].append(r.hash)
    for g in ("a", "b", None):
        own = [sketch(t) for h, t in texts if h == g]
        limit = min(s[0] for s in own)
        assert got[g][0] == limit and sorted(got[g][1]) == sorted({int(h) for s in own for h in s[1] if h <= limit})
    assert got["e"] == ((1 << 48) - 1, [None])


@pytest.mark.parametrize("rows_a_range", [64, 1])
def test_neighbours_by_hand(spark, monkeypatch, rows_a_range):
    """Every awkward case, in one range and in many."""
    monkeypatch.setattr(fp, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(fp, "KEYS", 1)
    d = docs(spark)
    got = fingerprints(d)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    keyed = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).distinct().collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = {}
    for r, after in zip(order, order[1:] + order[:1]):
        k = len(r.text) // 3
        edited = r.text[: len(r.text) - k] + after.text[:k]
        a, b, c = sketch(r.text), sketch(edited), sketch(after.text)
        want[r.doc_id, r.text] = (len(r.text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), likeness(a, b), likeness(a, c))
    expected = sorted((r.doc_id is None, r.doc_id or 0, *want[r.doc_id, r.text or ""]) for r in d.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in got.collect()) == expected


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(4, "a text of some words")], "doc_id long, text string")
    r = fingerprints(one).first()
    assert r.near_next == 1.0 and r.n_chars == 20 and r.edited_sha256 == hashlib.sha256(b"a text of some" + b"a text").hexdigest()
    assert fingerprints(empty(spark)).count() == 0


def test_equal_texts_have_equal_fingerprints_and_many_unique_ids(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, 30) if i % 3 else "the same text in many rows") for i in range(1000)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    texts = dict(rows)
    assert len(got) == 1000 and len({r.fingerprint for i, r in got.items() if i % 3 == 0}) == 1
    for i, r in got.items():
        after = texts[i - 1 if i else 999]
        k = len(texts[i]) // 3
        assert r.edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - k] + after[:k]).encode()).hexdigest() and r.near_next == likeness(sketch(texts[i]), sketch(after))
