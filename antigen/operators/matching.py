"""Nearest patterns and patterns within a distance, without the product of both sides.

Two ways, both exact and made of equi-joins:

* a prefix trie. Patterns are written with the heaviest bits first, and cut into levels of LEVEL bits; a level is a table of
  the prefixes that occur, with the values that follow each. All queries go down together, a join a level. What the prefix
  has cost so far bounds the distance of every pattern under it from below; that and the weight of the bits still open
  bound it from above. A branch is left when it cannot match, or not beat what is known, and taken whole when all of it
  must match. Heavy bits first make bounds tight early. It serves weighted distances and Jaccard's.
* multi-index hashing for whole Hamming distances (Norouzi, Punjani and Fleet, 2012). Patterns are cut into parts. Two
  patterns within a distance agree in one part up to their share of it, so parts are met at radius 0, then 1, 2 and on,
  until the best found for a query is proven to be nearest.

Tables of a trie have at most one row a pattern; they are broadcast only where their count allows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.functions import bits
from antigen.sources.steps import materialized

#: Patterns (a few bytes each) that may be sent to every executor.
BROADCAST_ROWS = 200_000
#: Bits of a level, and branches that the first, inexact descent keeps of each query.
LEVEL, BEAM = 4, 4
#: Lookups of a query and round, at most, before the trie takes over.
LOOKUPS = 2048
#: Bounds are sums of fractions; a branch is left only if it is worse by more than this.
ROOM = 1e-9


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if its count allows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@dataclass(frozen=True)
class Weighted:
    """The sum of the weights of the bits that differ; equal weights of 1 make it Hamming's distance."""

    weights: tuple[float, ...]

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def order(self) -> list[int]:
        return sorted(range(self.k), key=lambda i: (-self.weights[i], i))

    def start(self) -> list[Column]:
        return [F.lit(0.0).alias("_a"), F.lit(0.0).alias("_b")]

    def step(self, at: int, width: int, mine: Column, other: Column) -> list[Column]:
        own = [self.weights[i] for i in self.order[at : at + width]][::-1]
        sums = [sum(w for i, w in enumerate(own) if v >> i & 1) for v in range(1 << width)]
        cost = F.element_at(F.array(*map(F.lit, sums)), (mine.bitwiseXOR(other) + 1).cast("int"))
        return [(F.col("_a") + cost).alias("_a"), F.col("_b")]

    def bounds(self, at: int, query: Column) -> tuple[Column, Column]:
        """The least and largest distance of patterns under a prefix of `at` bits."""
        return F.col("_a"), F.col("_a") + sum(self.weights[i] for i in self.order[at:])

    def distance(self, a: str, b: str) -> Column:
        return bits.weighted_hamming(a, b, self.weights)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distances of arrays of patterns, added up as `distance` does."""
        differ = a ^ b
        if set(self.weights) == {1.0}:
            return np.bitwise_count(differ).astype(float)
        total = np.zeros(differ.shape)
        for start in range(0, self.k, 8):
            part = self.weights[start : start + 8]
            sums = np.array([sum(w for i, w in enumerate(part) if byte >> i & 1) for byte in range(1 << len(part))])
            total += sums[differ >> start & (len(sums) - 1)]
        return total


@dataclass(frozen=True)
class Jaccard:
    """One less the share of common set bits among those of either; 1 where neither has any."""

    k: int

    @property
    def order(self) -> list[int]:
        return list(range(self.k))

    def start(self) -> list[Column]:
        return [F.lit(0.0).alias("_a"), F.lit(0.0).alias("_b")]

    def step(self, at: int, width: int, mine: Column, other: Column) -> list[Column]:
        return [(F.col("_a") + F.bit_count(mine.bitwiseAND(other))).alias("_a"), (F.col("_b") + F.bit_count(mine.bitwiseOR(other))).alias("_b")]

    def bounds(self, at: int, query: Column) -> tuple[Column, Column]:
        """At best all open bits of the query are shared and no others come; at worst none is and all others do."""
        left = self.k - at
        own = F.bit_count(query.bitwiseAND(F.lit((1 << left) - 1).cast("bigint")))
        share = lambda common, either: 1 - F.when(either > 0, common / either).otherwise(0.0)
        return share(F.col("_a") + own, F.col("_b") + own), share(F.col("_a"), F.col("_b") + left)

    def distance(self, a: str, b: str) -> Column:
        return 1 - bits.jaccard(a, b)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        either = np.bitwise_count(a | b)
        return 1 - np.where(either > 0, np.bitwise_count(a & b) / np.maximum(either, 1), 0.0)


Measure = Weighted | Jaccard


def hamming(k: int) -> Weighted:
    return Weighted((1.0,) * k)


def moved(pattern: Column, places: dict[int, int]) -> Column:
    """The mask whose bit places[i] is the pattern's bit i."""
    total = F.lit(0).cast("bigint")
    for i, to in places.items():
        total = total.bitwiseOR(F.shiftleft(F.shiftright(pattern, i).bitwiseAND(F.lit(1).cast("bigint")), to))
    return total


def heaviest_first(pattern: Column, measure: Measure) -> Column:
    return moved(pattern, {i: measure.k - 1 - n for n, i in enumerate(measure.order)})


def as_written(pattern: Column, measure: Measure) -> Column:
    return moved(pattern, {measure.k - 1 - n: i for n, i in enumerate(measure.order)})


def bits_at(pattern: Column, measure: Measure, at: int, width: int) -> Column:
    return F.shiftright(pattern, measure.k - at - width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


Trie = list[tuple[int, int, DataFrame]]


def trie(patterns: DataFrame, measure: Measure) -> Trie:
    """(first bit, width, table) of each level; a table has the prefixes and the values that follow each, 2^LEVEL at most."""
    own = patterns.select(heaviest_first(F.col(patterns.columns[0]), measure).alias("p")).distinct()
    levels = [(at, min(LEVEL, measure.k - at)) for at in range(0, measure.k, LEVEL)]
    seat = lambda at, width: F.struct(F.lit(at).alias("at"), F.shiftright("p", measure.k - at).alias("prefix"), bits_at(F.col("p"), measure, at, width).alias("v"))
    each = own.select(F.explode(F.array(*(seat(*level) for level in levels))).alias("s")).select("s.*")
    every = materialized(each.groupBy("at", "prefix").agg(F.collect_set("v").alias("next")))
    rows = {r["at"]: r["count"] for r in every.groupBy("at").count().collect()}  # a row a level
    table = lambda at: every.where(F.col("at") == at).drop("at")
    return [(at, width, F.broadcast(table(at)) if rows.get(at, 0) <= BROADCAST_ROWS else table(at)) for at, width in levels]


def queries_of(patterns: DataFrame, measure: Measure) -> DataFrame:
    """(bits, _q, prefix, _a, _b): distinct patterns at the root."""
    name = patterns.columns[0]
    return patterns.distinct().select(F.col(name).alias("bits"), heaviest_first(F.col(name), measure).alias("_q"), F.lit(0).cast("bigint").alias("prefix"), *measure.start())


def below(front: DataFrame, level: tuple[int, int, DataFrame], measure: Measure, more: list[str]) -> DataFrame:
    """The branches one level deeper, with `lower` and `upper` bounds; `_next` (if there) chooses among a prefix's values."""
    at, width, table = level
    values = F.col("next")
    if "_sure" in more:  # all under it match: any one branch leads on
        values = F.when(F.col("_sure"), F.slice("next", 1, 1)).otherwise(values)
    down = front.join(table, "prefix").select("bits", "_q", "prefix", "_a", "_b", *more, F.explode(values).alias("_v"))
    stepped = down.select("bits", "_q", F.shiftleft("prefix", width).bitwiseOR(F.col("_v")).alias("prefix"), *measure.step(at, width, bits_at(F.col("_q"), measure, at, width), F.col("_v")), *more)
    lower, upper = measure.bounds(at + width, F.col("_q"))
    return stepped.withColumns({"lower": lower, "upper": upper})


def nearest(patterns: DataFrame, others: DataFrame, measure: Measure) -> DataFrame:
    """(bits, distance) of each distinct pattern to the nearest of the others; none without others.

    A first descent keeps the BEAM best branches of each query and so finds some pattern near it; its distance is the bound
    of the second, which leaves only branches that cannot be nearer, and so is exact."""
    levels = trie(others, measure)
    start = queries_of(patterns, measure)
    front = start
    best = Window.partitionBy("bits").orderBy("lower", "upper", "prefix")
    for level in levels:
        front = below(front, level, measure, []).withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= BEAM)
    bound = materialized(front.groupBy("bits").agg(F.min("lower").alias("_bound")))
    front = start.join(bound, "bits")
    for level in levels:
        front = below(front, level, measure, ["_bound"]).where(F.col("lower") <= F.col("_bound") + ROOM)
    found = front.select("bits", as_written(F.col("prefix"), measure).alias("_other"))
    return found.groupBy("bits").agg(F.min(measure.distance("bits", "_other")).cast("double").alias("distance"))


def within(patterns: DataFrame, others: DataFrame, measure: Measure, most: float) -> DataFrame:
    """(bits) the distinct patterns that any of the others is within the distance `most` of, inclusive."""
    front = queries_of(patterns, measure).withColumn("_sure", F.lit(False))
    for level in trie(others, measure):
        down = below(front, level, measure, ["_sure"])
        front = down.where(F.col("_sure") | (F.col("lower") <= most + ROOM)).withColumn("_sure", F.col("_sure") | (F.col("upper") <= most - ROOM))
        front = front.drop("lower", "upper")
    found = front.withColumn("_other", as_written(F.col("prefix"), measure))
    return found.where(F.col("_sure") | (measure.distance("bits", "_other") <= most)).select("bits").distinct()


def parts_of(k: int, n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each part: as many that a part has about as many values as there are patterns."""
    b = min(k, max(1, round(k / max(1.0, math.log2(max(2, n))))))
    edges = [k * i // b for i in range(b + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def nearest_hamming(patterns: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(bits, distance): as `nearest` with equal weights of 1, by multi-index hashing."""
    mine = patterns.select(F.col(patterns.columns[0]).alias("bits")).distinct()
    other = materialized(others.select(F.col(others.columns[0]).alias("_other")).distinct())
    n = other.count()
    if not n:
        return mine.select("bits", F.lit(None).cast("double").alias("distance")).limit(0)
    parts = parts_of(k, n)
    value = lambda c, lo, width: F.shiftright(c, lo).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    seat = lambda i, v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    kept = other.select("_other", F.explode(F.array(*(seat(i, value(F.col("_other"), *p)) for i, p in enumerate(parts)))).alias("s")).select("_other", "s.i", "s.v")
    kept = small(kept)
    open_, done = mine.withColumn("distance", F.lit(None).cast("double")), []
    for radius in range(max(w for _, w in parts) + 1):
        lookups = [(i, p, sum(1 << b for b in c)) for i, p in enumerate(parts) for c in combinations(range(p[1]), radius)] if sum(math.comb(p[1], radius) for p in parts) <= LOOKUPS else []
        if not lookups:  # so many lookups cost more than bounds
            done.append(nearest(open_.select("bits"), other, hamming(k)))
            break
        probes = open_.select("bits", F.explode(F.array(*(seat(i, value(F.col("bits"), *p).bitwiseXOR(F.lit(m).cast("bigint"))) for i, p, m in lookups))).alias("s"))
        near = probes.select("bits", "s.i", "s.v").join(kept, ["i", "v"]).groupBy("bits").agg(F.min(bits.hamming("bits", "_other")).cast("double").alias("_near"))
        open_ = materialized(open_.join(near, "bits", "left").select("bits", F.least("distance", "_near").alias("distance")))
        proven = F.coalesce(F.col("distance") <= len(parts) * (radius + 1) - 1, F.lit(False))
        done.append(open_.where(proven))
        open_ = open_.where(~proven)
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
