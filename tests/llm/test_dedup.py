from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from antigen.llm import near_dedup, span_dedup
from antigen.llm.components import connected_components
from antigen.llm.line_dedup import dedup_lines
from antigen.llm.near_dedup import near_duplicates
from antigen.llm.shingles import shingle_sets
from antigen.llm.span_dedup import dedup_spans
from tests.llm.cases import docs, empty, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups(rows: dict) -> dict:
    sets = {i: shingles(t) for i, t in rows.items()}
    lead = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]) and lead[a] != lead[b]:
                    lead[a] = lead[b] = min(lead[a], lead[b])
                    changed = True
    return lead


def test_shingle_counts():
    rows = list(texts().values())
    assert [len(s) for s in shingle_sets([None if t is None else t.encode() for t in rows])] == [len(shingles(t)) for t in rows]


def test_near_duplicates_by_brute_force(spark):
    rows = {i: t for i, t in texts().items()}
    got = near_duplicates(docs(spark)).where("doc_id is not null and doc_id <> 6").collect()
    want = groups(rows)
    for r in got:
        assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(shingles(rows[r.doc_id]))), r.doc_id


def test_nulls_and_repeats_in_near_duplicates(spark):
    got = near_duplicates(docs(spark)).collect()
    assert len(got) == docs(spark).count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicates(empty(spark)).count() == 0


def test_hot_groups_lose_no_link(spark, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "LIST_SIZE", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rnd = random.Random(5)
    base = prose(rnd, 90).split(" ")
    rows = {}
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"edit{rnd.randint(0, 999)}"
        rows[i] = " ".join(words)
    line = prose(rnd, 20)
    rows |= {100 + i: prose(rnd, 60) + " " + line for i in range(20)}
    got = near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == groups(rows)


def test_hot_texts_that_no_star_links(spark, monkeypatch):
    """Copies of copies, each a few edits from the last: far ones are linked through those between only."""
    import random

    monkeypatch.setattr(near_dedup, "LIST_SIZE", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rnd = random.Random(8)
    words, rows = prose(rnd, 200).split(" "), {}
    for i in range(40):
        words = list(words)
        for _ in range(2):
            words[rnd.randrange(len(words))] = f"edit{rnd.randint(0, 9999)}"
        rows[i] = " ".join(words)
    passage = prose(rnd, 150)
    rows |= {100 + i: passage + " " + prose(rnd, rnd.randint(20, 90)) for i in range(30)}
    got = near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == groups(rows)


def test_rows_without_near_copies(spark):
    base, other = texts()[1], texts()[5]
    near = base.replace(" ", "  ", 3)
    rows = [(1, base, 0), (2, near, 1), (2, other, 2), (2, other, 3), (2, other, 3), (3, base, 4), (4, None, 5), (4, None, 5), (5, "", 6), (None, "a text of no id, more than five words", 7), (None, base, 8), (6, "", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r.doc_id, r.key) for r in near_dedup.without_near_copies(d).collect()), key=str)
    assert [k for k in got if k not in ((2, 2), (2, 3))] == sorted([(4, 5), (4, 5), (5, 6), (6, 6), (None, 7), (None, 8)], key=str)
    assert len([k for k in got if k in ((2, 2), (2, 3))]) == 1
    one = d.where("key in (0, 4, 1) or doc_id > 3")
    assert sorted((r.doc_id, r.key) for r in near_dedup.without_near_copies(one).collect()) == [(1, 0), (4, 5), (4, 5), (5, 6), (6, 6)]
    assert near_dedup.without_near_copies(d.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (7, 7), (100, 50)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 70: 50, 100: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    long = "this line has surely more than ten words in it all told"
    rows = [(1, f"{long}\nshort\nother line"), (2, f"start\n{long}\nshort\nend here"), (3, f"alone\n{long}"), (4, None), (5, ""), (6, "short\nshort"), (7, "a b c d e f\ng h i j k l"), (8, "a b c d e f\ng h i j k l")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].text == "start\nend here" and got[2].n_removed == 2
    assert got[3].text == "alone"
    assert got[4].text is None and got[4].n_lines == 0
    assert got[5].text == "" and got[5].n_lines == 1
    assert got[6].text == "short\nshort"
    assert got[7].text == rows[6][1] and got[8].text == ""


def test_line_dedup_keeps_columns_and_rows(spark):
    d = docs(spark)
    out = dedup_lines(d)
    assert out.columns == [*d.columns, "n_lines", "n_removed"] and out.count() == d.count()
    assert {r.text for r in out.where("doc_id = 1").collect()} == {texts()[1]}
    assert dedup_lines(empty(spark)).count() == 0


def without_repeats(rows: dict[int, str | None]) -> dict[int, str | None]:
    """By comparing every run of lines with every earlier one."""
    lines = {i: [(p, x) for p, x in enumerate(t.split("\n")) if WORD.search(x)] for i, t in rows.items() if t is not None}
    seen: dict[tuple, tuple] = {}
    gone: set = set()
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                run = tuple(x for _, x in lines[i][a:b])
                if sum(len(WORD.findall(x)) for x in run) >= 10 and seen.setdefault(run, (i, a)) < (i, a):
                    gone |= {(i, k) for k in range(a, b)}
    out = {}
    for i, t in rows.items():
        if t is None:
            out[i] = None
            continue
        flags = {p: (i, k) in gone for k, (p, _) in enumerate(lines[i])}
        n = len(t.split("\n"))
        goes = [flags[p] if p in flags else any(q < p for q in flags) and any(q > p for q in flags) and flags[max(q for q in flags if q < p)] and flags[min(q for q in flags if q > p)] for p in range(n)]
        out[i] = "\n".join(x for x, g in zip(t.split("\n"), goes) if not g)
    return out


def test_line_dedup_by_brute_force(spark):
    import random

    rnd = random.Random(6)
    few = [" ".join(f"{chr(97 + i)}{j}" for j in range(n)) for i, n in enumerate([1, 2, 3, 5, 6, 6, 9, 10, 12])] + ["", " \t"]
    rows = {i: "\n".join(rnd.choice(few) for _ in range(rnd.randint(0, 12))) for i in range(60)}
    rows[60], rows[61] = None, "\n".join(rnd.choice(few) for _ in range(200))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == without_repeats(rows)


def test_line_dedup_of_runs_around_a_known_line(spark):
    a, x, b = "a1 a2 a3 a4 a5 a6", " ".join(f"x{i}" for i in range(12)), "b1 b2 b3 b4 b5 b6"
    rows = [(1, f"start\n{x}\nend"), (2, f"{a}\n{x}\n{b}"), (3, f"{a}\n{x}\n\n{b}\nmore"), (4, f"{b}\n{a}")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"{a}\n{b}", 3: "more", 4: rows[3][1]}


def test_line_dedup_takes_any_names(spark):
    d = docs(spark).where("doc_id < 6").withColumn("gone", F.lit(1)).withColumn("row", F.lit("r")).withColumn("__id", F.lit(2)).withColumn("hash", F.lit(3)).withColumn("n_lines", F.lit(-1))
    out = dedup_lines(d)
    assert out.columns == [c for c in d.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert {(r.gone, r.row, r.__getitem__("__id"), r.hash) for r in out.collect()} == {(1, "r", 2, 3)}


def windows(text: str | None, n: int = 50) -> set:
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_span_dedup_removes_later_passages_only(spark):
    rows = texts()
    got = {r.doc_id: r for r in dedup_spans(docs(spark)).where("doc_id is not null and doc_id <> 6").collect()}
    for i in (1, 4, 7, 8, 10, 11, 13, 14, 17):
        assert got[i].text == rows[i], i
    assert got[2].text == "" and got[2].n_removed == got[2].n_sentences
    assert not windows(got[4].text) & windows(got[5].text) and windows(rows[4]) & windows(rows[5])
    assert len(got[5].text) > 0.5 * (len(rows[5]) - 60 * 8)
    assert dedup_spans(empty(spark)).count() == 0


def test_span_dedup_of_one_long_sentence(spark):
    sentence = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(1, f"First one here. {sentence} Then more of it."), (2, f"Quite another start.\n{sentence}\nAnd its end.")]
    got = {r.doc_id: r.text for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and "w30" not in got[2] and "Quite another start." in got[2] and "And its end." in got[2]


def test_span_dedup_of_short_sentences_and_prefixes(spark):
    rng = np.random.default_rng(3)
    slogans = "\n".join(" ".join(f"S{n}" for n in rng.integers(0, 9999, k)) + "!!" for k in rng.integers(1, 4, 40))
    bare = " ".join(f"w{n}" for n in rng.integers(0, 9999, 80))
    rows = [(1, f"First one here. {slogans}\nMore of it."), (2, f"Another start.\n{slogans}\nAn end."), (3, f"a b c {bare} d"), (4, f"e f g h i j k {bare} l m n")]
    got = {r.doc_id: r.text for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "Another start.\nAn end."
    assert not passages(got[4]) & passages(bare) and "e f g" in got[4] and "l m n" in got[4]


def spans_by_hand(rows: dict[int, str | None]) -> dict[int, str | None]:
    """Every run of sentences as its words, in a dictionary of first places."""
    seen: dict[tuple, tuple] = {}
    out = {}
    for i, text in sorted(rows.items()):
        raw = (text or "").encode()
        _, starts, _, _, whole = span_dedup.units([raw])
        parts = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)])]
        words = [tuple(w.lower() if w.isascii() else w for w in WORD.findall(p)) for p in parts]
        gone = set()
        enough = lambda a, b: b - a >= 3 and sum(map(len, words[a:b])) >= 12
        runs = {(a, next((b for b in range(a, len(parts) + 1) if enough(a, b)), None)) for a in range(len(parts))}
        runs |= {(next((a for a in range(b, -1, -1) if enough(a, b)), None), b) for b in range(1, len(parts) + 1)}
        runs |= {(a, a + 3) for a in range(len(parts) - 2) if all(whole[a : a + 3])}
        for a, b in sorted(r for r in runs if None not in r):
            if seen.setdefault(tuple(words[a:b]), (i, a, b)) != (i, a, b):
                gone |= set(range(a, b))
        out[i] = text if not gone else "".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def short_sentences_by_hand(rows: dict[int, str]) -> dict[int, str]:
    """Texts of short sentences, one behind another with a space: all three in a row are a run, whatever they hold."""
    seen: dict[tuple, tuple] = {}
    out = {}
    for i, text in sorted(rows.items()):
        parts = re.findall(r"[^.!?]+[.!?]+ ?", text)
        assert "".join(parts) == text
        key = [tuple(p.lower().split()) for p in parts]
        gone: set = set()
        for a in range(len(parts) - 2):
            if seen.setdefault(tuple(key[a : a + 3]), (i, a)) != (i, a):
                gone |= {a, a + 1, a + 2}
        out[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def test_every_run_of_short_sentences_counts(spark):
    rnd = random.Random(12)
    one = lambda n: " ".join(rnd.choice(["buy", "it", "Now"]) for _ in range(n)).capitalize() + rnd.choice(".!?")
    rows = {i: " ".join(one(rnd.choice([1, 1, 2, 5])) for _ in range(rnd.randint(1, 14))) for i in range(120)}
    rows |= {200: "Buy it now. Call us today. Offer ends soon.", 201: "Buy it now. Call us today. Offer ends soon.", 202: "First. buy it NOW. Call us today. Offer ends soon."}
    got = {r.doc_id: r.text for r in dedup_spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect()}
    want = short_sentences_by_hand(rows)
    assert got == want and got[201] == "" and got[202] == "First. " and sum(want[i] != rows[i] for i in rows) > 5


def test_span_dedup_by_brute_force(spark):
    import random

    rnd = random.Random(3)
    known = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(n)) + rnd.choice([". ", "! ", ".\n", "\n"]) for n in (1, 1, 2, 3, 4, 6, 9, 14, 30, 70)]
    rows = {i: "".join(rnd.choice(known) for _ in range(rnd.randint(0, 9))) for i in range(60)}
    rows[60] = None
    got = {r.doc_id: r.text for r in dedup_spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == spans_by_hand(rows)


def passages(text: str) -> set:
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 50]) for i in range(len(words) - 49)}


def test_span_dedup_leaves_no_passage_of_50_words(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = spark.read.parquet(path).where("doc_id < 10000 and doc_id % 2 = 0 or doc_id in (3139, 1386, 9122)").select("doc_id", "text")
    seen: dict = {}
    for r in sorted(dedup_spans(rows).collect(), key=lambda r: r.doc_id):
        for p in passages("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")):
            assert seen.setdefault(hash(p), r.doc_id) == r.doc_id, (r.doc_id, p)


def test_blocks_agree_with_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    groups = np.arange(30) // 2 * 10
    edges = near_dedup.block_links(groups, sets)
    lead = {int(i): int(i) for i in groups}

    def find(x: int) -> int:
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        lead[find(a)] = find(b)
    linked = {(i, j) for i in range(30) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - both)}
    for i, j in linked:
        assert find(int(groups[i])) == find(int(groups[j]))
    assert len({find(int(g)) for g in groups}) == 15 - len(edges)
