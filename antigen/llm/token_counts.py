"""Operator 3, token counts: lengths only, encoded in Arrow batches balanced by bytes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from antigen.llm.common import by_bytes, held, table

#: Distinct pieces whose lengths a worker keeps, about 15 MB; past it the memo starts anew, which changes speed only.
MEMO_PIECES = 100_000
#: In front of ASCII white space that follows what no library takes for white space.
CUTS = regex.compile(r"(?<=\S)(?=[ \t\r\n])")


def split_words(text: str) -> list[str]:
    """Cuts a text at ASCII white space, which goes."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def safe_split(content: bytes) -> Callable[[str], list[str]]:
    """How texts may be cut so that the counts of the parts add up to the count of the text, by the vocabulary's own
    settings. Where its words never hold white space, white space itself can go; where a byte-level pattern begins anew
    at each run of white space, a text is cut in front of them; any other vocabulary gets texts whole."""
    spec = json.loads(content)
    steps = lambda x, inner: x[inner] if x and x["type"] == "Sequence" else [x] if x else []
    before, words = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    plain = all(not regex.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
    if not plain or not words or spec["post_processor"]:
        return lambda text: [text]
    first, pattern = words[0], words[0].get("pattern", {}).get("Regex", "(?")
    local = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in before)
    if local and first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "(?" not in pattern and not regex.search(pattern, " \t\r\n"):
        return split_words
    if not before and len(words) == 1 and first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        return CUTS.split
    return lambda text: [text]


class JsonCounter:
    """Counts tokens with the tokenizers library; repeated pieces are encoded once."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = safe_split(content)
        self.memo: dict[str, int] = {"": 0}

    def learn(self, pieces: list[str], limit: int = 1 << 20) -> None:
        """Encodes unseen pieces in calls of about `limit` characters."""
        start = size = 0
        for i, piece in enumerate(pieces):
            size += len(piece) + 16
            if size >= limit or i == len(pieces) - 1:
                part = pieces[start : i + 1]
                found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
                self.memo.update(zip(part, map(len, found)))
                start, size = i + 1, 0

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.memo) > MEMO_PIECES:
            self.memo = {"": 0}
        parts = [self.split(t) if t else [] for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(p)
        self.learn([w for w in seen if w not in self.memo])
        return [sum(map(self.memo.__getitem__, p)) for p in parts]


class PieceCounter:
    """Counts tokens with sentencepiece, which sees a text whole because its first word gets a prefix."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=content)

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(self.processor.encode(t, num_threads=1)) if t else 0 for t in texts]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, by the vocabulary file at `vocabulary`.

    A `.json` file is read by the tokenizers library, a `.model` file by sentencepiece. A null text counts as
    empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated rows; an empty table gives none.
    Other columns are not read, so their names cannot clash. Texts of any length are counted whole: they are cut
    only where the vocabulary's own settings make it safe (`safe_split`)."""
    kind = PieceCounter if vocabulary.endswith(".model") else JsonCounter
    with open(vocabulary, "rb") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary file: a few MB, whatever the input

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(shared.value, lambda: kind(shared.value))
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                n_tokens = pa.array(own.counts(batch.column("text").to_pylist()), pa.int64())
                n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), n_bytes, n_tokens, pc.greater(n_tokens, limit)],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return kept.mapInArrow(count, schema).withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
