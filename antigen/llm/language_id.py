"""Operator 9, language identification in two steps: the family first, then the language within it.

A text is the unit vector of its hashed byte bigrams and trigrams, case and non-letters of ASCII folded. One-versus-one
linear support vector machines, fitted by Spark on a bounded sample, tell families apart and then the languages of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.llm.common import by_bytes, checkpoint, fold, table

#: Documents of each language that are fitted on, at most about so many; and machines that are fitted at a time.
LANGUAGE_SAMPLE, PARALLEL = 1500, 4
#: Bytes that are counted at a time, and texts whose vectors are held at a time.
CHUNK, ROWS = 1 << 18, 256
BUCKETS = 2048
#: Families of language codes (fixed values); a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "turkic": "tr az kk uz ky".split(),
    "uralic": "fi et hu".split(),
    "indic": "hi bn ur mr gu pa ne".split(),
    "semitic": "ar he am".split(),
}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[np.arange(97, 123)] = np.arange(97, 123)
_FOLD[np.arange(65, 91)] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def gram_vectors(texts: list[bytes]) -> np.ndarray:
    """A unit vector of BUCKETS counts for each text (zero if it has no letter), over all of its bytes, CHUNK at a time."""
    whole = b"".join(b"  " + t + b"  " for t in texts)
    ends = np.cumsum([len(t) + 4 for t in texts])
    counts = np.zeros(len(texts) * BUCKETS, np.float32)
    for start in range(0, len(whole) - 2, CHUNK):
        raw = _FOLD[np.frombuffer(whole, np.uint8, min(CHUNK + 2, len(whole) - start), start)].astype(np.uint32)
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        letters = np.flatnonzero((a != 32) | (b != 32))
        a, b, c = a[letters], b[letters], c[letters]
        at = np.searchsorted(ends, start + letters, side="right") * BUCKETS
        two = ((a * np.uint32(2654435761) + b * np.uint32(2246822519)) >> np.uint32(13)) % np.uint32(BUCKETS)
        three = ((a * np.uint32(3266489917) + b * np.uint32(668265263) + c * np.uint32(374761393)) >> np.uint32(13)) % np.uint32(BUCKETS)
        if len(at):
            first = int(at[0])
            seen = np.bincount(np.concatenate([at + two, at + three]) - first)
            counts[first : first + len(seen)] += seen
    x = np.sqrt(counts.reshape(len(texts), BUCKETS))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Machine:
    """Tells class `high` (margin over 0) from class `low`."""

    low: str
    high: str
    weights: np.ndarray
    intercept: float


@dataclass
class Model:
    languages: list[str]
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def vote(x: np.ndarray, classes: list[str], machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
    """The class that most machines prefer (ties: the larger sum of their shares) and its mean share of them, in 0..1."""
    wins, shares = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
    for m in machines:
        p = 1 / (1 + np.exp(-np.clip(2 * (x @ m.weights + m.intercept), -50, 50)))
        lo, hi = classes.index(m.low), classes.index(m.high)
        wins[:, hi] += p > 0.5
        wins[:, lo] += p <= 0.5
        shares[:, hi] += p
        shares[:, lo] += 1 - p
    best = np.argmax(wins + shares / (len(machines) + 1), axis=1)
    return best, shares[np.arange(len(x)), best] / max(1, len(classes) - 1) if machines else np.ones(len(x))


def predict(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray]:
    x = gram_vectors(texts)
    names = sorted(model.families)
    family, score = vote(x, names, model.between)
    langs = [""] * len(texts)
    for i, name in enumerate(names):
        rows = np.flatnonzero(family == i)
        if len(rows):
            best, inner = vote(x[rows], model.families[name], model.within[name])
            score[rows] *= inner
            for r, b in zip(rows, best):
                langs[r] = model.families[name][b]
    return langs, score


def fit(docs: DataFrame) -> Model:
    """Learns from text and lang of rows off fold 0 that have a letter: all languages that occur, from a sample of each."""
    own = docs.where(F.col("lang").isNotNull() & (fold("doc_id") != 0) & F.col("text").rlike(r"\p{L}"))
    counts = own.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return Model([], {}, [], {})
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, LANGUAGE_SAMPLE / r["count"])).otherwise(share)
    chosen = own.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", rows=ROWS):
                x = gram_vectors([t.encode() for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(x), pa.list_(pa.float32()))], ["lang", "x"])

    rows = checkpoint(chosen.mapInArrow(vectors, "lang string, x array<float>"))
    rows = rows.select("lang", array_to_vector(F.col("x").cast("array<double>")).alias("features")).cache()
    languages = sorted(r["lang"] for r in counts)
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(family_of(lang), []).append(lang)

    def machine(low: str, high: str, lows: list[str], highs: list[str]) -> Machine:
        two = rows.where(F.col("lang").isin(*lows, *highs)).withColumn("label", F.col("lang").isin(*highs).cast("double"))
        found = LinearSVC(maxIter=15, regParam=1e-3, standardization=False).fit(two)
        return Machine(low, high, np.array(found.coefficients.toArray(), np.float32), float(found.intercept))

    asked = [(a, b, families[a], families[b]) for a, b in combinations(sorted(families), 2)]
    asked += [(a, b, [a], [b]) for langs in families.values() for a, b in combinations(langs, 2)]
    with ThreadPool(PARALLEL) as pool:  # Spark runs the jobs of several fits side by side
        machines = pool.starmap(machine, asked)
    found = {(m.low, m.high): m for m in machines}
    between = [found[p] for p in combinations(sorted(families), 2)]
    within = {f: [found[p] for p in combinations(langs, 2)] for f, langs in families.items()}
    rows.unpersist()
    return Model(languages, families, between, within)


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row.

    `held_out` marks ids whose crc32 modulo 5 is 0 (a null id too), which are never learnt from. A text that is null or
    has no letter is `und` with score 0, and so is every text if there was nothing to learn from. Whole texts are read;
    repeated rows repeat; an empty table gives no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each pair of families, and of languages of one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in by_bytes(whole, "text", rows=ROWS):
                texts, known = batch.column("text").to_pylist(), batch.column("known").to_pylist()
                rows = [i for i, k in enumerate(known) if k and own.languages]
                langs, score = ["und"] * len(texts), np.zeros(len(texts))
                if rows:
                    found, s = predict([texts[i].encode() for i in rows], own)
                    score[rows] = s
                    for i, lang in zip(rows, found):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(langs), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    kept = docs.select(
        docs[id_col].alias("id"), (fold(id_col) == 0).alias("held_out"), docs[text_col].cast("string").alias("text"),
        F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("known"),
    )
    schema = f"id {kept.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs, fit(docs))
