"""Operator 4, substring dedup: every run of several consecutive sentences is hashed, runs meet globally, and sentences
that any run but the first of its kind covers are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.llm.common import Steps, by_bytes, join_counted, table
from antigen.llm.shingles import mix, word_hashes

#: Consecutive sentences that a run has at least, and words, if any of them is a piece of a longer sentence.
RUN, LEAST_WORDS = 3, 12
#: A sentence of so many words or more is cut at the word of the least hash in each CUT words, wherever it begins, so that a
#: passage of it is a run as well. A passage's first CUT words hold a cut or a sentence's start, and units have up to CUT
#: words: one of RUN + 1 times CUT words, 48, so holds a run, whatever stands around it.
CUT = 12
#: A sentence ends after its stop and white space, or with its line.
SENTENCE = re.compile(rb"[^\n]*?(?:[.!?\xe2\x80\xa6][\"')\]]*(?=[ \t\r\n])|\n|$)[ \t\r]*\n*", re.S)
_WEIGHTS = mix(np.arange(1, LEAST_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of texts (pieces of long ones): how many units each text has, and all units' byte starts in their texts,
    hashes, word counts and whether they are whole sentences; hashes ignore case of A-Z and white space. What has no word
    belongs to the unit before it."""
    raw = b"\n".join(texts)  # which ends a text's last sentence
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    words, at = word_hashes(raw)
    if not len(words):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.array([m.end() for m in SENTENCE.finditer(raw) if m.end() > m.start()], np.int64)
    sentence = np.searchsorted(ends, at, side="right")
    new = np.flatnonzero(np.diff(sentence, prepend=-1))
    length = np.diff(new, append=len(words))
    # each window within a long sentence cuts before its least word, the last of equal ones
    inside = np.arange(len(words)) - np.repeat(new, length) + CUT <= np.repeat(length, length)
    window = np.flatnonzero(inside & np.repeat(length > CUT, length))
    least, cut = words[window + CUT - 1], window + CUT - 1
    for i in range(CUT - 2, -1, -1):
        less = words[window + i] < least
        least, cut = np.where(less, words[window + i], least), np.where(less, window + i, cut)
    marked = np.zeros(len(words), bool)
    marked[new] = marked[cut] = True
    first = np.flatnonzero(marked)
    counts = np.diff(first, append=len(words))
    begins = np.append(np.isin(first, new, assume_unique=True), True)
    place = (np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64)
    hashes = mix(np.add.reduceat(mix(words + place * np.uint64(0xD6E8FEB86659FD93)), first))
    text = np.searchsorted(ends_of_text, at[first], side="right")
    per_text = np.bincount(text, minlength=len(texts))
    starts = at[first] - np.concatenate([[0], ends_of_text])[text]
    starts[(np.cumsum(per_text) - per_text)[per_text > 0]] = 0
    return per_text, starts, hashes, counts, begins[:-1] & begins[1:]


def runs(per_text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, place and hash of each run: every RUN whole sentences, however short; and from each unit the shortest run of
    enough units and words, and the shortest that ends with each unit, so that a passage's end is in a run. A place is 16 times the position in the text plus the number
    of units, which is LEAST_WORDS at most as each has a word."""
    n, total = len(hashes), np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(per_text)), per_text)
    begins = (np.cumsum(per_text) - per_text)[text]
    stops = begins + per_text[text]
    start = np.arange(n)
    end = np.maximum(start + RUN, np.searchsorted(total, total[:-1] + LEAST_WORDS))
    stop = start + 1
    back = np.minimum(stop - RUN, np.searchsorted(total, total[1:] - LEAST_WORDS, side="right") - 1)
    short = np.flatnonzero((start + RUN <= stops) & (np.convolve(whole, np.ones(RUN, np.int64))[RUN - 1 :][:n] == RUN))
    place = np.unique(np.concatenate([(start * 16 + end - start)[end <= stops], (back * 16 + stop - back)[back >= begins], short * 16 + RUN]))
    start, size = place >> 4, place & 15
    out = np.zeros(len(place), np.uint64)
    for i in range(LEAST_WORDS):
        of = np.flatnonzero(size > i)
        if not len(of):
            break
        out[of] += hashes[start[of] + i] * _WEIGHTS[i]
    return text[start], place - (begins[start] << 4), mix(out).view(np.int64)


def spans(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, text_hash, pos) for every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                per_text, _, hashes, counts, complete = units([(t or "").encode() for t in batch.column("text").to_pylist()])
                owner, pos, found = runs(per_text, hashes, counts, complete)
                own = pa.array(owner.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), batch.column("doc_id").take(own), batch.column("text_hash").take(own), pa.array(pos.astype(np.int32))],
                    ["hash", "doc_id", "text_hash", "pos"],
                )

    return docs.mapInArrow(run, f"hash long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, pos int")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_sentences, n_removed) for each row: the text without the sentences that repeat.

    A run's first place is its smallest (id, text hash, position); a null id comes before all. Rows that repeat both id and
    text are one document and get the same result. n_sentences counts whole sentences and the pieces of long ones.
    Null texts stay null, texts of fewer sentences than a run stay as they are, an empty table gives no rows, other columns are not read. A text may become empty; its row stays."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = own.where("text is not null").groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"))
    if texts.where("lo <> hi").isEmpty():  # ids tell the texts apart, so that each run is spared eight random bytes
        own = own.withColumn("text_hash", F.when(F.col("text").isNotNull(), F.lit(0).cast("long")))
    steps = Steps(docs.sparkSession)
    found = steps(spans(own.where("text is not null")))
    # one partial row for each run and task goes to the shuffle; a run's place as one sortable value keeps this cheap
    place = F.struct("doc_id", "text_hash", "pos")
    first = steps(found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_counted(found, first, "hash").where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    gone = steps(gone.select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2"), "gone"))
    steps.forget(found)
    both = own.join(gone, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("hash2")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                texts, removed = batch.column("text").to_pylist(), np.zeros(batch.num_rows, np.int64)
                raws = [(t or "").encode() for t in texts]
                per_text, every, _, _, _ = units(raws)
                begins = np.cumsum(per_text) - per_text
                for i, at in enumerate(batch.column("gone").to_pylist()):
                    if not at:
                        continue
                    raw, starts = raws[i], every[begins[i] : begins[i] + per_text[i]]
                    covered = np.zeros(len(starts), bool)
                    for p in at:
                        covered[p >> 4 : (p >> 4) + (p & 15)] = True
                    ends = np.append(starts[1:], len(raw))
                    texts[i] = b"".join(raw[a:b] for a, b, c in zip(starts, ends, covered) if not c).decode()
                    removed[i] = covered.sum()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(per_text.astype(np.int64)), pa.array(removed)], ["doc_id", "text", "n_sentences", "n_removed"]
                )

    kind = own.schema["doc_id"].dataType.simpleString()
    out = both.select("doc_id", "text", "gone").mapInArrow(cut, f"doc_id {kind}, text string, n_sentences long, n_removed long")
    return out.withColumnRenamed("doc_id", id_col)


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))
