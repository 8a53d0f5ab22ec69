"""Operator 2, toxicity: Levenshtein automata over a lexicon trie, and context windows.

The lexicon is learnt from labelled documents: words and word stems that toxic ones have far more often. A word counts
as a hit if it is a term, begins with a stem, or is within a few edits of a term without being a word of clean texts. Each
hit is weighed by its context: within quotation marks or behind a reporting word it counts as quotation, else as abuse,
more so where hits crowd. A logistic regression turns a document's sums into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.llm.common import by_bytes, checkpoint, fold, table
from antigen.llm.lexicon import WORD, Trie
from antigen.llm.shingles import shingle_sets

#: Labelled documents that the lexicon and the regression are fitted on, at most about so many of each class.
TOXIC_SAMPLE, CLEAN_SAMPLE = 4000, 8000
#: Log likelihood ratio from which a term is telling: chance gives one in a million that much.
LEAST_GAIN = 13.0
STEM_LENGTHS = range(3, 9)
#: Words to each side of a hit that are its context.
WINDOW = 6
#: Words that report speech (fixed values).
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term phrase sagte nannte wort dijo llamó palabra dit appelé mot".split())
QUOTES = '"“”„«»‹›'
#: What a quoted hit, and each edit of a misspelt one, leave of its weight.
QUOTED, EDIT = 0.2, 0.8
#: Log odds from which a hit is strong by itself.
STRONG = 4.0
#: Distinct words that a task keeps, about 10 MB; it changes speed only.
MEMO_WORDS = 50_000


@dataclass
class Model:
    entries: list[tuple[str, bool, float]]
    ordinary: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)
    intercept: float = -5.0


class Scorer:
    """Features of texts under a lexicon."""

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.entries)
        self.memo: dict[str, tuple[str, float, int] | None] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        for word in words:
            if word not in self.memo:
                found = self.trie.match(word)
                self.memo[word] = None if found and found[2] and word in self.model.ordinary else found

    def features(self, text: str | None) -> list[float]:
        """log(1 + strong hits), heaviest abuse, log(1 + quotation), abuse by the root of the words, crowding."""
        text = (text or "").lower()
        seen = set(WORD.findall(text))
        self.learn(seen)
        if not any(map(self.memo.__getitem__, seen)):
            return [0.0] * 5
        spans = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        abuse = strong = heaviest = quotation = crowding = 0.0
        last = -(WINDOW + 1)
        for i, (start, end, word) in enumerate(spans):
            found = self.memo[word]
            if found is None:
                continue
            weight = found[1] * EDIT ** found[2]
            if self.is_quoted(text, spans, i):
                quotation += weight
                weight *= QUOTED
            elif i - last <= WINDOW:
                crowding += 1
            last = i
            abuse += weight
            strong += weight >= STRONG
            heaviest = max(heaviest, weight)
        return [float(np.log1p(strong)), heaviest, float(np.log1p(quotation)), float(abuse / np.sqrt(len(spans))), float(np.log1p(crowding))]

    @staticmethod
    def is_quoted(text: str, spans: list[tuple[int, int, str]], i: int) -> bool:
        """Whether quotation marks open before the hit and close after it in its window, or a reporting word stands
        up to three words before it."""
        if any(w in REPORTING for _, _, w in spans[max(0, i - 3) : i]):
            return True
        left = text[spans[max(0, i - WINDOW)][0] : spans[i][0]]
        right = text[spans[i][1] : spans[min(len(spans) - 1, i + WINDOW)][1]]
        marks = [c for c in left if c in QUOTES]
        return len(marks) % 2 == 1 and any(c in QUOTES for c in right)


def scores(features: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ np.array(model.weights) + model.intercept, -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text): a bounded sample of labelled documents off fold 0, one of each group of near copies (texts that share
    their smallest shingle hash), so that a copied text's words don't pass for telling ones."""
    own = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold("doc_id") != 0))
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_SAMPLE / max(1, n.get(1, 0)))).otherwise(min(1.0, CLEAN_SAMPLE / max(1, n.get(0, 0))))
    chosen = own.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                least = [int(s[0]) if len(s) else None for s in shingle_sets([t.encode() for t in batch.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *batch.columns], ["least", "doc_id", "toxic", "text"])

    # about TOXIC_SAMPLE + CLEAN_SAMPLE rows of two numbers: a bound that the sampling share sets
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int"), "text")
    rows = rows.mapInArrow(sign, f"least long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, text string").where("least is not null")
    return rows.groupBy("least").agg(F.min_by(F.struct("toxic", "text"), "doc_id").alias("r")).select("r.*")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, is_stem, toxic, clean): how many toxic and clean documents have each word and stem."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                by_class = [Counter(), Counter()]
                for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                    words = set(WORD.findall(text.lower()))
                    found = {(w, False) for w in words}
                    found.update((w[:n], True) for w in words for n in STEM_LENGTHS if len(w) > n)
                    by_class[toxic].update(found)
                keys = list(by_class[0].keys() | by_class[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([by_class[1][k] for k in keys], pa.int64()), pa.array([by_class[0][k] for k in keys], pa.int64())],
                    ["term", "is_stem", "toxic", "clean"],
                )

    partial = rows.mapInArrow(count, "term string, is_stem boolean, toxic long, clean long")
    return partial.groupBy("term", "is_stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def without_repeats(found: list[tuple[str, bool, int, float]]) -> list[tuple[str, bool, float]]:
    """Drops stems that one longer entry explains, and entries that add nothing to a stem they begin with."""
    toxic = {(t, s): n for t, s, n, _ in found}
    odds = {(t, s): o for t, s, _, o in found}
    explained = set()
    for (text, is_stem), n in toxic.items():
        for k in range(1, len(text) + (not is_stem)):
            if n >= (0.95 if is_stem else 0.8) * toxic.get((text[:k], True), n * 9):
                explained.add(text[:k])
    stems = {t for t, s in toxic if s and t not in explained}
    kept = []
    for (text, is_stem), o in odds.items():
        shorter = [odds[text[:k], True] for k in range(1, len(text) + (not is_stem)) if text[:k] in stems]
        if not (is_stem and text in explained) and (not shorter or o > max(shorter) + 0.7):
            kept.append((text, is_stem, min(6.0, o)))
    return kept


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns lexicon, exceptions and weights from labelled rows that are not held out."""
    rows = checkpoint(training_rows(docs, labels))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([])
    counts = checkpoint(term_counts(rows))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    # the likelihood ratio of a term's split into classes against that of all documents
    base, n = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * share))).otherwise(0.0)
    gain = part("toxic", base) + part("clean", 1 - base)
    telling = counts.where(F.col("toxic") >= 5).withColumn("odds", odds).where((odds >= 1.5) & (gain >= LEAST_GAIN))
    # terms that at least five of the sampled toxic documents hold: the sample bounds them
    best = telling.orderBy((F.col("odds") * F.col("toxic")).desc(), "term", "is_stem").collect()
    model = Model(without_repeats([(r["term"], r["is_stem"], r["toxic"], float(r["odds"])) for r in best]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.entries)
        for batch in batches:
            words = [w for w in batch.column("term").to_pylist() if (m := trie.match(w)) and m[2]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["term"])

    # words of clean training texts within the edits of a term; the sample bounds them
    model.ordinary = frozenset(r["term"] for r in counts.where("not is_stem and clean > 0 and toxic <= clean").select("term").mapInArrow(near, "term string").collect())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model)
        for batch in batches:
            found = [own.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["label", "features"])

    data = checkpoint(rows.select("toxic", "text").mapInArrow(extract, "label int, features array<double>"))
    data = data.select(F.col("label").cast("double"), array_to_vector("features").alias("features"))
    # more abuse never lowers a score
    least = Matrices.dense(1, 5, [0.0, 0.0, -100.0, 0.0, 0.0])
    found = LogisticRegression(maxIter=50, regParam=1e-4, lowerBoundsOnCoefficients=least).fit(data)
    model.weights, model.intercept = [float(w) for w in found.coefficients], float(found.intercept)
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row.

    `held_out` marks ids whose crc32 modulo 5 is 0 (a null id too), which labels are never learnt from. Null, empty
    and wordless texts have no hits and get the score of none. Whole texts are read; ties don't matter, as each row
    stands for itself; repeated rows repeat; an empty table gives no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms of the sample and the words near them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                x = np.array([own.features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 5)
                s = scores(x, own.model)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kept = docs.select(docs[id_col].alias("id"), (fold(id_col) == 0).alias("held_out"), docs[text_col].cast("string").alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic. Rows pass through the scoring task, so
    that no join has to bring scores and texts together. Null, empty and wordless texts stay, each row is judged by its own
    text, rows that repeat are kept or rejected alike, an empty table gives no rows, and no column name can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for whole in batches:
            for batch in by_bytes(whole, text_col):
                x = np.array([own.features(t) for t in batch.column(text_col).to_pylist()], np.float64).reshape(-1, 5)
                yield batch.filter(pa.array(scores(x, own.model) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
