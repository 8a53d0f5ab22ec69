"""The corpus pipeline: five stages from raw documents to token ids, each an operator of antigen.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.llm.byte_bpe import encode
from antigen.llm.common import Steps, table
from antigen.llm.line_dedup import dedup_lines
from antigen.llm.mixing import mixed_texts
from antigen.llm.near_dedup import without_near_copies
from antigen.llm.toxicity import fit, without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more by a model of the labelled ones among `docs`. Null, empty and wordless texts have no
    hits and stay; rows that repeat are judged alike; where nothing is labelled, or the table is empty, all rows stay."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return without_toxic(docs.select(*COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later repeated runs of lines out of the texts; every document stays, also one whose lines all go. Null texts stay
    null; rows that repeat id and text are one document; an empty table gives no rows."""
    return with_length(dedup_lines(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates. Rows of a null id count as well, an id
    that occurs with two texts is two documents, and of rows that repeat id and text one stays. Null, empty and wordless
    texts stay. An empty table gives no rows."""
    return without_near_copies(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: what each pass takes of a document is a row. Null, empty and blank texts give no words and
    so no rows; a null source is a source of its own; rows that repeat are taken apart; an empty table gives no rows."""
    return with_length(mixed_texts(docs.select(*COLUMNS)))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row that the mix returned. A null text has none; ids may repeat; an empty table gives no rows."""
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("of"), "text")
    found = encode(keyed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_col="of")
    return found.select("of.*", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again, so that no stage is computed twice."""
    steps, docs, before = Steps(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, before = steps(stage(spark, docs, sf_dir)), docs
        steps.forget(before)  # nothing reads an earlier stage's rows any more
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity model and the token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
