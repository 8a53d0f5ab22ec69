from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers

from antigen.llm import byte_bpe
from antigen.llm.byte_bpe import ByteBpe, decode, encode, round_trip, vocabulary
from antigen.llm.common import by_bytes
from antigen.llm.token_counts import JsonCounter, safe_split, split_words, token_counts
from tests.llm.cases import docs, empty, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference() -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(spark):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts(docs(spark), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == len(texts()) + 3
    for r in got:
        if r.doc_id is None or r.doc_id == 6:
            continue
        text = texts()[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 2048), r.doc_id


def test_counts_by_sentencepiece(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts(docs(spark).where("doc_id in (1, 8, 13)"), path).collect():
        assert r.n_tokens == len(p.encode(texts()[r.doc_id]))


def test_round_trip_equals_the_library(spark, reference):
    for r in round_trip(docs(spark), RANKS, public_tokenizers.PATTERN).where("doc_id is not null and doc_id <> 6").collect():
        text = texts()[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_offsets_and_split_characters(spark, reference):
    got = {r.doc_id: r for r in encode(docs(spark), RANKS, public_tokenizers.PATTERN).where("doc_id = 13").collect()}[13]
    text = texts()[13]
    assert got.ids == reference.encode_ordinary(text)
    raw = text.encode()
    for i, (start, char) in enumerate(zip(got.byte_starts, got.char_starts)):
        piece = reference.decode_single_token_bytes(got.ids[i])
        assert raw[start : start + len(piece)] == piece
        assert char == len(raw[: start + 1].decode("utf-8", "ignore")) - (0 if (raw[: start + 1].decode("utf-8", "ignore")).encode() != raw[: start + 1] else 1)
    cut = spark.createDataFrame([(1, got.ids[:-1]), (2, None), (3, got.ids)], "doc_id long, ids array<int>")
    back = {r.doc_id: r for r in decode(cut, RANKS, public_tokenizers.PATTERN).collect()}
    assert bytes(back[3].bytes) == raw and back[3].text == text and back[2].text == "" and raw.startswith(bytes(back[1].bytes))


def test_random_texts_equal_the_library(reference):
    own, rnd = ByteBpe(vocabulary(open(RANKS, "rb").read()), public_tokenizers.PATTERN), random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice("ab eT  \n\t's é　日🙂12!.-aaaa\r\x1c\x85") for _ in range(rnd.randint(0, 25)))
        assert own.encode([text])[0] == reference.encode_ordinary(text), repr(text)


def test_empty_tables(spark):
    assert token_counts(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 95, "", "c" * 10])], ["text"])
    assert [b.num_rows for b in by_bytes(batch, "text", limit=100)] == [2, 2, 1]
    assert [b.num_rows for b in by_bytes(batch, "text", limit=100, rows=1)] == [1] * 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_by_other_vocabularies(name):
    path, rnd = public_tokenizers.path(name), random.Random(5)
    content = open(path, "rb").read()
    own, library = JsonCounter(content), tokenizers.Tokenizer.from_file(path)
    assert (safe_split(content) is split_words) == (name == "word_bpe_49k.json")
    texts = ["a  b   c", " x", "y ", "", *("".join(rnd.choice("ab eT  \n\t's é　日🙂12!.-\r\x1c\x85\u0301") for _ in range(rnd.randint(0, 25))) for _ in range(3000)), "a <|endoftext|> b<|endoftext|>"]
    for text, n in zip(texts, own.counts(texts)):
        assert n == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_vocabularies_of_unknown_settings_get_texts_whole():
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    assert safe_split(json.dumps(spec).encode())("a b") == ["a b"]


def test_a_full_memo_starts_anew(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 5)
    own, rnd = ByteBpe(vocabulary(open(RANKS, "rb").read()), public_tokenizers.PATTERN), random.Random(4)
    for _ in range(20):
        text = " ".join(str(rnd.randint(0, 999)) for _ in range(9))
        assert own.encode([text, None]) == [reference.encode_ordinary(text), []]
    assert len(own.memo) < 40


def test_frequent_pieces_are_encoded_once(monkeypatch):
    """However many rare pieces pass through a memo that is soon full; ids stay the same."""
    import public_tokenizers

    from antigen.llm import byte_bpe

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = byte_bpe.vocabulary(f.read())
    texts = [f"the frequent words and rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    want = byte_bpe.ByteBpe(content, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 20)
    small = byte_bpe.ByteBpe(content, public_tokenizers.PATTERN)
    encoded = []

    class Counting:
        def encode_batch_fast(self, part, **k):
            encoded.extend(part)
            return own.encode_batch_fast(part, **k)

    own, small.tokenizer = small.tokenizer, Counting()
    assert [small.encode([t])[0] for t in texts] == want
    assert encoded.count(" frequent") == encoded.count(" words") == 1 and len(small.memo) <= 20 and len(small.old) <= 20
