"""Negative selection over bit patterns: candidates, selection against self, nearest-detector scores.

Patterns are deduplicated before any comparison: there are at most 2^k. Matches within a threshold and nearest detectors are
found by the ways of `matching`, and Hamming radii of few masks by equi-joins on the patterns of the ball; a run's own few
detectors are compared in one pass over the distinct patterns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.functions import bits
from antigen.functions.hashing import uniform_hash
from antigen.operators import matching
from antigen.operators.matching import Measure, small

#: Detectors that all distinct patterns are compared with in one pass, at most; and detectors of all runs of a grid.
FEW, GRID_DETECTORS = 1024, 1_000_000
#: Masks of a ball, at most.
MASKS = 4096


def candidates(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """(detector_id, pattern): n masks of k random bits (62 at most), the same on any partitioning. Bits beyond the 32nd come
    from a second hash."""
    if not 0 < k <= 62:
        raise ValueError("a pattern has 1 to 62 bits")
    ids = spark.range(n).withColumnRenamed("id", "detector_id")
    word = uniform_hash(seed, "detector_id")
    if k > 32:
        word = word.bitwiseOR(F.shiftleft(uniform_hash(f"{seed}-high", "detector_id"), 32))
    return ids.select("detector_id", word.bitwiseAND(F.lit((1 << k) - 1).cast("bigint")).alias("pattern"))


def masks_within(k: int, radius: int) -> list[int]:
    """All masks of up to `radius` of k bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(k), r)]


def ball(df: DataFrame, pattern: str, k: int, radius: int) -> DataFrame:
    """(near): all distinct patterns within the radius of any pattern."""
    masks = F.array(*(F.lit(m).cast("bigint") for m in masks_within(k, radius)))
    return df.select(F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col(pattern)))).alias("near")).distinct()


def ball_masks(k: int, radius: int) -> int:
    return sum(math.comb(k, r) for r in range(radius + 1))


def select_detectors(pool: DataFrame, self_patterns: DataFrame, k: int, radius: int) -> DataFrame:
    """Candidates that no self pattern is within the Hamming radius of. Empty self keeps all."""
    if ball_masks(k, radius) > MASKS:
        return select_by(pool, self_patterns, matching.hamming(k), radius)
    return pool.join(ball(self_patterns.distinct(), self_patterns.columns[0], k, radius), F.col("pattern") == F.col("near"), "left_anti")


def select_by(pool: DataFrame, self_patterns: DataFrame, matches: Measure | Callable[[str, str], Column], most: float = 0.0) -> DataFrame:
    """Candidates that match no self pattern: within the distance `most` by a measure of `matching`, or by any predicate of two
    columns, which takes the product of candidates and distinct self patterns."""
    if isinstance(matches, Measure):
        return pool.join(matching.within(pool.select("pattern"), self_patterns, matches, most), F.col("pattern") == F.col("bits"), "left_anti")
    own = self_patterns.distinct().toDF("self_pattern")
    return pool.join(small(own), matches("pattern", "self_pattern"), "left_anti")


def compared(own: DataFrame, pools: dict[int, np.ndarray], measure: Measure, pattern: str = "bits") -> DataFrame:
    """(fit, pattern, distance) of each distinct pattern to its nearest in each pool of patterns, GRID_DETECTORS in all at most."""
    if sum(map(len, pools.values())) > GRID_DETECTORS:
        raise ValueError(f"the pools hold more than {GRID_DETECTORS} detectors")
    fits = {f: d for f, d in pools.items() if len(d)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                x = whole.column(0).to_numpy()[start : start + 256]
                near = [measure.between(x[:, None], d[None, :]).min(axis=1) for d in fits.values()]
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(fits), len(x)).astype(np.int32)), pa.array(np.tile(x, len(fits))), pa.array(np.concatenate(near))], ["fit", pattern, "distance"])

    return own.select(pattern).distinct().mapInArrow(run, f"fit int, `{pattern}` long, distance double")


def nearest(records: DataFrame, detectors: DataFrame, measure: Measure | Callable[[str, str], Column], distance: bool, pattern: str = "bits") -> DataFrame:
    """Adds `score`: the least distance or largest similarity to any detector, infinity or 0 without detectors. Distinct patterns
    are scored and joined back.

    A measure of `matching` is compared with a run's few detectors in one pass, and searched beyond FEW of them; its
    similarity is 1 less the distance. Any other function of two columns takes the product."""
    own = records.select(pattern).distinct()
    d = detectors.select(F.col("pattern").alias("detector")).distinct()
    if isinstance(measure, Measure):
        known = [r[0] for r in d.limit(FEW + 1).collect()]
        if len(known) <= FEW:
            scores = compared(own, {0: np.array(known, np.int64)}, measure, pattern)
        elif measure == matching.hamming(measure.k):
            scores = matching.nearest_hamming(own, d, measure.k).withColumnRenamed("bits", pattern)
        else:
            scores = matching.nearest(own, d, measure).withColumnRenamed("bits", pattern)
        scores = scores.select(pattern, F.col("distance").alias("score") if distance else (1 - F.col("distance")).alias("score"))
    else:
        best = F.min if distance else F.max
        scores = own.crossJoin(small(d)).groupBy(pattern).agg(best(measure(pattern, "detector")).cast("double").alias("score"))  # distinct patterns by detectors
    return records.join(scores, pattern, "left").withColumn("score", F.coalesce("score", F.lit(float("inf") if distance else 0.0)))


def detected(records: DataFrame, detectors: DataFrame, k: int, radius: int, pattern: str = "bits") -> DataFrame:
    """Adds `pred`: 1 for records within the Hamming radius of a detector, else 0; without detectors all are 0."""
    if ball_masks(k, radius) > MASKS:
        return detected_by(records, detectors, matching.hamming(k), radius, pattern)
    hit = ball(detectors, "pattern", k, radius)
    return records.join(hit, F.col(pattern) == F.col("near"), "left").withColumn("pred", F.col("near").isNotNull().cast("int")).drop("near")


def detected_by(records: DataFrame, detectors: DataFrame, measure: Measure, most: float, pattern: str = "bits") -> DataFrame:
    """The same by any measure of `matching` and distance."""
    hit = matching.within(records.select(pattern), detectors.select("pattern"), measure, most).withColumnRenamed("bits", "_near")
    return records.join(hit, F.col(pattern) == F.col("_near"), "left").withColumn("pred", F.col("_near").isNotNull().cast("int")).drop("_near")


def pattern_bits(df: DataFrame, features: list[str], medians: dict[str, float]) -> Column:
    """The mask of features over their training medians; a tie is 0."""
    return bits.pack([F.col(f) > medians[f] for f in features])


def bit_counts(rows: DataFrame, k: int) -> DataFrame:
    """(split, y, bit, v, n): patterns are counted first, then their bits."""
    p = rows.groupBy("split", "y", "bits").agg(F.count("*").alias("n"))
    return p.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("v", F.expr("(bits >> bit) & 1"))


def bit_prevalence(rows: DataFrame, k: int) -> DataFrame:
    """For each split and bit its share of ones, and the support and share of each class; null where a class is absent."""
    part = lambda c: F.sum(F.when(c, F.col("v") * F.col("n"))) / F.sum(F.when(c, F.col("n")))
    support = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    benign, attack = F.col("y") == 0, F.col("y") == 1
    return bit_counts(rows, k).groupBy("split", "bit").agg(
        part(F.lit(True)).alias("prevalence"), support(benign).alias("benign_support"), part(benign).alias("benign"), support(attack).alias("attack_support"), part(attack).alias("attack")
    )


def pattern_diagnostics(rows: DataFrame, k: int) -> DataFrame:
    """For each split: records, distinct patterns, the most frequent one's records, the share of distinct ones, patterns of both
    classes, records whose pattern training lacks, and bits that are constant or rare (up to 1 % ones or zeros)."""
    seen = rows.where("split = 'train'").select("bits").distinct().withColumn("known", F.lit(True))
    p = rows.groupBy("split", "bits").agg(F.count("*").alias("n"), (F.min("y") < F.max("y")).alias("mixed")).join(seen, "bits", "left")
    unseen = F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0))
    out = p.groupBy("split").agg(
        F.sum("n").alias("records"), F.count("*").alias("patterns"), F.max("n").alias("largest"), F.round(F.count("*") / F.sum("n"), 9).alias("unique_share"), F.count_if("mixed").alias("shared"), unseen.alias("unseen_records")
    )
    m = F.col("prevalence")
    bits_of = bit_prevalence(rows, k).groupBy("split").agg(F.count_if((m == 0) | (m == 1)).alias("constant_bits"), F.count_if((m <= 0.01) | (m >= 0.99)).alias("rare_bits"))
    return out.join(bits_of, "split")
