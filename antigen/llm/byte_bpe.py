"""Operator 7, byte-level BPE: the tokenizers library over Arrow batches, and the way back."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from antigen.llm.common import by_bytes, held, table

#: Distinct pieces whose ids a worker keeps in each of two generations, about 50 MB each; it changes speed only.
MEMO_PIECES = 200_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(n) for a, n in (line.split() for line in content.splitlines() if line)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes a token: what lower ranks leave of its bytes."""
    own, parts = ranks[token], [bytes([b]) for b in token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            raise ValueError(f"rank {own} cannot be made by lower ranks")
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def vocabulary(content: bytes) -> bytes:
    """The tokenizers library's form of a rank file: what the workers load."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(content), byte_characters()
    spell = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
    merges = [tuple(spell[p] for p in merge_of(t, ranks)) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE({spell[t]: n for t, n in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str().encode()


class ByteBpe:
    """Encodes texts to ids by the ranks, and decodes ids to bytes. Each match of the pattern is encoded by itself,
    and equal matches once."""

    def __init__(self, content: bytes, pattern: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share out the cores already
        self.tokenizer = Tokenizer.from_str(content.decode())
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = {n: bytes(map(back.__getitem__, t)) for t, n in self.tokenizer.get_vocab(False).items()}
        self.digits_of = {n: str(n) for n in self.bytes_of}
        self.one = {n: (n,) for n in self.bytes_of}
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def decode(self, ids) -> bytes:
        """The bytes of the ids; characters that tokens share are whole again once their tokens stand side by side."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that are new. A memo that is full becomes the old one, from which pieces that come again are
        taken over, so frequent ones are encoded once."""
        if len(self.memo) + len(pieces) > MEMO_PIECES:
            self.memo, self.old = {}, self.memo
        new = [p for p in pieces if p not in self.memo]
        if self.old:
            self.memo |= {p: self.old[p] for p in new if p in self.old}
            new = [p for p in new if p not in self.old]
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for piece, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                ids = found.ids
                self.memo[piece] = self.one[ids[0]] if len(ids) == 1 else tuple(ids)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        parts = [self.pieces(t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        return [list(chain.from_iterable(map(self.memo.__getitem__, p))) for p in parts]


def character_starts(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The index of the character that holds each byte offset: how many characters begin up to it, less one."""
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.cumsum(begins)[starts] - 1 if len(starts) else starts


def _shared(docs: DataFrame, ranks: str):
    with open(ranks, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(vocabulary(f.read()))  # of a rank file: about 1.5 MB, whatever the input


def bpe(content: bytes, pattern: str) -> ByteBpe:
    return held(content + pattern.encode(), lambda: ByteBpe(content, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, byte_starts, char_starts): the tokens of each text, each with the offset of its first byte and the
    index of the character that holds this byte.

    A null text counts as empty and gives empty arrays; ids may be null or repeated; an empty table gives no rows;
    other columns are not read. Strings that look like special tokens are ordinary text."""
    shared = _shared(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(shared.value, pattern)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                texts = batch.column("text").to_pylist()
                ids, starts, chars = [], [], []
                for text, flat in zip(texts, own.encode(texts)):
                    sizes = np.array([len(own.bytes_of[i]) for i in flat], np.int64)
                    at = np.cumsum(sizes) - sizes
                    ids.append(flat)
                    starts.append(at)
                    chars.append(character_starts((text or "").encode(), at))
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(ids, kind), pa.array(starts, kind), pa.array(chars, kind)],
                    ["id", "ids", "byte_starts", "char_starts"],
                )

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>, byte_starts array<int>, char_starts array<int>"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes, text): the bytes that the ids stand for, and the text. Bytes that are no whole character, as when
    a list was cut within one, show as U+FFFD in `text` and stay as they are in `bytes`. Null ids count as none."""
    shared = _shared(encoded, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(shared.value, pattern)
        for batch in batches:
            raw = [own.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])],
                ["id", "bytes", "text"],
            )

    kept = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, bytes binary, text string"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes the ids, and returns digests of both,
    so that neither ids nor bytes leave the worker. Nulls and empty tables as in `encode`."""
    shared = _shared(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(shared.value, pattern)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                counts, of_ids, of_bytes = [], [], []
                for ids in own.encode(batch.column("text").to_pylist()):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(own.digits_of.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
