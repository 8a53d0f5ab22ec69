"""One fitted pipeline from raw rows to predictions: the same columns in batch and in a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antigen.functions import bits
from antigen.operators import features as X
from antigen.operators.cleaning import coerced


@dataclass
class Deployed:
    """What was fitted on training rows. `transform` adds bits, score and prediction to raw rows by expressions of columns
    alone, without a shuffle. Detectors are those of one run, a few thousand at most."""

    numeric: list[str]
    categories: dict[str, list[str]]
    selected: list[str]
    parameters: dict[str, dict] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    detectors: list[int] = field(default_factory=list)
    threshold: float | None = 0.0
    strict: bool = False
    weights: list[float] | None = None

    def encoded(self, raw: DataFrame, keys: list[str]) -> DataFrame:
        """Numbers from texts, a column for each category seen in training; columns that raw rows lack are missing."""
        have = raw.select(*raw.columns, *(F.lit(None).cast("string").alias(c) for c in [*self.numeric, *self.categories] if c not in raw.columns))
        numbers = have.select(*keys, *(coerced(c).alias(c) for c in self.numeric), *self.categories)
        for column, words in self.categories.items():
            numbers = X.one_hot(numbers, column, words).drop(column)
        every = [*self.numeric, *(f"{c}_{w}" for c, words in self.categories.items() for w in words)]
        return X.reindexed(numbers, every, keys)

    def scaled(self, encoded: DataFrame, keys: list[str]) -> DataFrame:
        """Missing values imputed, then scaled, by training rows."""
        filled = encoded.select(*keys, *(X.imputed(c, self.parameters[c]).cast("double").alias(c) for c in self.columns))
        return filled.select(*keys, *(X.scaled(c, self.parameters[c]) for c in self.columns))

    def with_bits(self, raw: DataFrame, keys: list[str]) -> DataFrame:
        ready = self.scaled(self.encoded(raw, keys), keys)
        return ready.select(*keys, bits.pack([F.col(c) > self.medians[c] for c in self.selected]).alias("bits"))

    def transform(self, raw: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, bits, score, pred): the Hamming distance to the nearest detector, infinite without any, and whether it is within
        the threshold; with weights the largest weighted similarity, 0 without any, and whether it reaches the threshold. Without
        a threshold (None) the prediction is null."""
        known = F.array(*(F.lit(d).cast("bigint") for d in self.detectors)).cast("array<bigint>")
        measure = (lambda m: bits.weight_of(m, self.weights)) if self.weights else F.bit_count
        near = F.array_min(F.transform(known, lambda d: measure(d.bitwiseXOR(F.col("bits"))))).cast("double")
        score = F.coalesce(1 - near, F.lit(0.0)) if self.weights else F.coalesce(near, F.lit(float("inf")))
        scored = self.with_bits(raw, keys).withColumn("score", score)
        limit = F.lit(self.threshold).cast("double")
        if self.weights:
            hit = F.col("score") > limit if self.strict else F.col("score") >= limit
        else:
            hit = F.col("score") < limit if self.strict else F.col("score") <= limit
        return scored.withColumn("pred", hit.cast("int"))


def fit(train: DataFrame, numeric: list[str], categorical: list[str], selected: list[str] | None = None) -> Deployed:
    """Vocabulary, medians, ranges and thresholds of bits by training rows. Features without any training value are left
    out. Detectors and the threshold are set by the caller, from the bits."""
    out = Deployed(numeric, {c: X.vocabulary(train, c) for c in categorical}, list(selected or []))
    encoded = out.encoded(train, []).select("*")
    doubles = encoded.select(*(F.col(c).cast("double").alias(c) for c in encoded.columns))
    out.parameters = X.fitted(X.statistics(doubles, doubles.columns))
    out.columns = X.with_values(out.parameters, doubles.columns)
    out.medians = {f: p["median"] for f, p in X.fitted(X.statistics(out.scaled(doubles, []), out.columns)).items()}
    out.selected = [c for c in (out.selected or out.columns) if c in out.columns]
    return out
