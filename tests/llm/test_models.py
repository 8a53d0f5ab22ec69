from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from antigen.llm import language_id, toxicity
from antigen.llm.lexicon import Trie, edits_allowed
from tests.llm.cases import docs, empty, prose

SF = "/root/testdata/sf0.1"
TERMS = "vilest rotter worthless scoundrel blaggard".split()


def edits(a: str, b: str) -> int:
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i, j - 1] + 1, d[i - 1, j] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    trie, rnd = Trie([(t, False, 5.0) for t in TERMS]), random.Random(4)
    for _ in range(4000):
        word = list(rnd.choice(TERMS))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(word))
            if rnd.random() < 0.3 and i:
                word[i - 1], word[i] = word[i], word[i - 1]
                continue
            word[i : i + rnd.randint(0, 1)] = rnd.choice(["", "e", "r", "z", "ss"])
            if not word:
                word = ["x"]
        word = "".join(word)
        short = re.sub(r"(.)\1{2,}", r"\1", word)
        best = min((edits(short, t) for t in TERMS if edits(short, t) <= edits_allowed(t)), default=None)
        found = trie.match(word)
        assert (found[2] if found else None) == best or word in TERMS, word


def toxic_table(spark):
    rnd, rows, labels = random.Random(9), [], []
    for i in range(600):
        words, toxic = prose(rnd, rnd.randint(40, 120)).split(" "), i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(TERMS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_misspelt_terms_and_spares_quotations(spark):
    d, labels = toxic_table(spark)
    model = toxicity.fit(d, labels)
    assert {t for t, stem, _ in model.entries if not stem} == set(TERMS)
    rnd = random.Random(11)
    plain = prose(rnd, 60)
    extra = [(1000, plain + " you rottter and scoundre1l"), (1001, plain + ' he said "rotter" once'), (1002, plain), (1003, ""), (1004, None)]
    got = {r.doc_id: r for r in toxicity.toxicity(d.union(spark.createDataFrame(extra, d.schema)), model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(got[i].predicted != t for i, t in truth.items()) <= 3
    assert got[1000].predicted == 1 and got[1001].score < got[1000].score
    assert [got[i].predicted for i in (1002, 1003, 1004)] == [0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_handles_every_case(spark):
    d, labels = toxic_table(spark)
    model = toxicity.fit(d, labels)
    out = toxicity.toxicity(docs(spark), model)
    assert out.count() == docs(spark).count() and out.where("doc_id is null and held_out").count() == 1
    assert toxicity.toxicity(empty(spark), model).count() == 0
    nothing = toxicity.fit(empty(spark), labels.limit(0))
    assert toxicity.toxicity(docs(spark), nothing).where("predicted = 1").count() == 0


def features_by_reading(text: str, entries: list, ordinary: frozenset) -> list[float]:
    """The features again, word by word with plain edit distances."""
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:[*@$!'’][^\W_]+)*", text.lower())]
    hits = []
    for i, (w, start, end) in enumerate(words):
        found = [(wt, 0) for t, stem, wt in entries if (w.startswith(t) if stem else w == t)]
        if not found:
            short = re.sub(r"(.)\1{2,}", r"\1", w)
            found = [(wt, 0) for t, stem, wt in entries if (short.startswith(t) if stem else short == t)]
            if not found and len(short) >= 4:
                near = [(edits(short, t), -wt, t) for t, stem, wt in entries if not stem and 0 < edits(short, t) <= edits_allowed(t)]
                found = [(-min(near)[1], min(near)[0])] if near and w not in ordinary else []
        if found:
            weight, n = max(found)
            hits.append((i, weight * toxicity.EDIT**n, start, end))
    out, last = [0, 0.0, 0.0, 0.0, 0], -99
    for i, weight, start, end in hits:
        left = text.lower()[words[max(0, i - 6)][1] : start]
        right = text.lower()[end : words[min(len(words) - 1, i + 6)][1]]
        quoted = any(w in toxicity.REPORTING for w, _, _ in words[max(0, i - 3) : i]) or (sum(c in toxicity.QUOTES for c in left) % 2 == 1 and any(c in toxicity.QUOTES for c in right))
        if quoted:
            out[2] += weight
            weight *= toxicity.QUOTED
        elif i - last <= 6:
            out[4] += 1
        last = i
        out[3] += weight
        out[0] += weight >= toxicity.STRONG
        out[1] = max(out[1], weight)
    return [math.log1p(out[0]), out[1], math.log1p(out[2]), out[3] / math.sqrt(max(1, len(words))), math.log1p(out[4])]


def test_features_by_brute_force():
    rnd = random.Random(12)
    entries = [(t, False, 3.0 + i) for i, t in enumerate(TERMS)] + [("scum", True, 5.5), ("foul", False, 2.0)]
    own = toxicity.Scorer(toxicity.Model(entries, frozenset({"rather"})))
    vocabulary = TERMS + "scumbag foul fool rather rotters vilset rottennn he said calls word the a of you".split()
    for _ in range(400):
        words = [rnd.choice(vocabulary if rnd.random() < 0.4 else prose(rnd, 3).split()) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randrange(len(words) + 1)
            words.insert(i, rnd.choice(['"', "«", "»", ".", "“"]))
        text = " ".join(words).replace('" ', '"')
        assert own.features(text) == pytest.approx(features_by_reading(text, entries, frozenset({"rather"}))), text


def test_each_model_scores_by_itself(spark):
    d, _ = toxic_table(spark)
    for weight in (0.5, 3.0, 1.0):  # workers are reused from one to the next
        model = toxicity.Model([(t, False, 5.0) for t in TERMS], weights=[weight] * 5)
        want = toxicity.scores(np.array([toxicity.Scorer(model).features(r.text) for r in d.limit(20).collect()]), model)
        got = [r.score for r in toxicity.toxicity(d.limit(20), model).collect()]
        assert got == pytest.approx(want.tolist())
        del model


def test_no_cap_on_the_lexicon(spark):
    rnd = random.Random(2)
    terms = ["".join(rnd.choice("bcdfghjklmnprstvwz") for _ in range(9)) for _ in range(2600)]
    rows = [(i, prose(rnd, 60) if i % 8 else " ".join(rnd.sample(terms, 200)), int(i % 8 == 0)) for i in range(1600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert len(model.entries) > 2000


def test_toxicity_held_out_accuracy(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(d, toxicity.fit(d, labels)).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in got) / sum(r.toxic for r in got)
    false = sum(not r.toxic and r.predicted for r in got) / sum(not r.toxic for r in got)
    assert hit > 0.9 and false < 0.01


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(d)
    got = language_id.language_id(d, model).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.language_id(docs(spark), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (7, 10, 11))
    assert odd[1].lang_pred in model.languages
    assert language_id.language_id(empty(spark), model).count() == 0


def test_language_with_nothing_or_one_to_learn(spark):
    none = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.language_id(docs(spark), none).collect()} == {"und"}
    one = language_id.fit(spark.createDataFrame([(i, f"some text {i}", "en") for i in range(20)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.language_id(docs(spark).where("doc_id = 1"), one).collect()} == {"en"}


def test_gram_vectors_by_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 7)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abC é日 1.") for _ in range(n)).encode() for n in (0, 1, 3, 40, 0, 7)]
    got = language_id.gram_vectors(texts)
    for t, v in zip(texts, got):
        raw, want = [int(language_id._FOLD[b]) for b in b"  " + t + b"  "], np.zeros(language_id.BUCKETS)
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if a != 32 or b != 32:
                want[((a * 2654435761 + b * 2246822519) % 2**32 >> 13) % language_id.BUCKETS] += 1
                want[((a * 3266489917 + b * 668265263 + c * 374761393) % 2**32 >> 13) % language_id.BUCKETS] += 1
        want = np.sqrt(want)
        assert np.allclose(v, want / max(1e-9, np.linalg.norm(want)), atol=1e-6)


def test_votes_by_brute_force():
    rng = np.random.default_rng(5)
    classes = list("abcd")
    machines = [language_id.Machine(a, b, rng.normal(size=6).astype(np.float32), float(rng.normal())) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    x = rng.normal(size=(50, 6)).astype(np.float32)
    best, score = language_id.vote(x, classes, machines)
    for row, k, s in zip(x, best, score):
        wins, shares = dict.fromkeys(classes, 0.0), dict.fromkeys(classes, 0.0)
        for m in machines:
            p = 1 / (1 + math.exp(-2 * (float(row @ m.weights) + m.intercept)))
            wins[m.high if p > 0.5 else m.low] += 1
            shares[m.high] += p
            shares[m.low] += 1 - p
        want = max(classes, key=lambda c: wins[c] + shares[c] / 7)
        assert classes[k] == want and abs(shares[want] / 3 - s) < 1e-6


@pytest.mark.parametrize("lang,family", [("en", "germanic"), ("fr", "romance"), ("xx", "only xx")])
def test_families(lang, family):
    assert language_id.family_of(lang) == family


def test_no_cap_on_languages(spark):
    """Every language that occurs is learnt, each a family of its own."""
    names = [f"l{i:02d}" for i in range(4)]
    rows = [(100 * i + k, chr(0x4E00 + 40 * i) * 3 + f" {k}", n) for i, n in enumerate(names) for k in range(4)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == names and len(model.between) == 6
