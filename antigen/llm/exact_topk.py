"""Operator 8, exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, each known by its mean and its deviation from it. By Cauchy and Schwarz the product of two
segments is at most the product of the means times the length plus that of the deviations; with the vectors' lengths this is
the lower bound of the distance (|q|^2 + |x|^2 - 2 q.x). Bounds go from coarse to fine, and what cannot beat a query's
k-th best so far drops out at each step:

1. rows are dealt to blocks by their nearest pivot, and a block is known by the ranges of its rows' segment statistics. A
   query is first sent to the block with its best bound, whose rows give it k scores;
2. then only to the blocks whose bound reaches the k-th of these;
3. in a block, rows are bounded by few segments, then by many, and the survivors are multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.llm.ann import by_length, matrix, usable
from antigen.llm.common import Steps, table

SCALE, BEST = 256, 5
#: Segments of each resolution, coarse to fine.
LEVELS = (4, 16)
#: Rows of a block, and rows and queries that meet in one task, on the average.
BLOCK, ROWS, QUERIES = 2048, 4096, 4096
#: Rows that blocks form around, at most; against these each query finds its first k-th best score. Any rows do.
PIVOTS = 1024
#: Scores lie between this and its negative; it stands for all that are less.
LEAST_LONG = -(1 << 63)


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each segment over the root of its length, and the lengths of the deviations from its mean."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    sizes = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    rest = x - np.repeat(sums / sizes, sizes, axis=1)  # not a difference of squares, which loses digits of large values
    return sums / np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Upper bounds of the inner products of rows of a with rows of b."""
    return a[0] @ b[0].T + a[1] @ b[1].T


def envelope_bounds(q: np.ndarray, envelopes: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with all rows of each block. An envelope has, for the segments of the
    finest level, the least and largest means and the largest deviations, and the largest length, of a block's rows."""
    mean, deviation = segment_statistics(q, LEVELS[-1])
    n = mean.shape[1]
    low, high, most = envelopes[:, :n], envelopes[:, n : 2 * n], envelopes[:, 2 * n : 3 * n]
    positive, negative = np.maximum(mean, 0), np.minimum(mean, 0)
    length = np.linalg.norm(q, axis=1)[:, None] * envelopes[:, -1][None, :]
    return np.minimum(positive @ high.T + negative @ low.T + deviation @ most.T, length) + 1 + 1e-9 * length


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they and all partial sums stay under 2^53, in 64-bit integers under 2^62, else
    in Python's. One that is over a long raises an error, as the best score of its query is then as well; one that is
    under it becomes LEAST_LONG, which is an error only where it is among the best."""
    reach = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if reach < 2**53:
        return (x @ q).astype(np.int64)
    if reach < 2**62 and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    asks = [int(v) for v in q]
    score = [sum(int(v) * a for v, a in zip(row, asks)) for row in x]
    if max(score, default=0) >= 1 << 63:
        raise OverflowError("a score exceeds a long")
    return np.array([max(n, LEAST_LONG) for n in score], np.int64)


def top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~score))[:k]  # the complement orders as the negative does, and no long overflows


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[list, list, list]:
    """For each query its k best of the rows that can reach `least`."""
    out: tuple[list, list, list] = ([], [], [])
    if len(ids) != len(np.unique(ids)):  # an id counts once in the end
        k *= int(np.unique(ids, return_counts=True)[1].max(initial=1))
    rows = [segment_statistics(x, n) for n in LEVELS]
    asks = [segment_statistics(q, n) for n in LEVELS]
    room = 1 + 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    for start in range(0, len(q), 256):
        coarse = bounds(tuple(s[start : start + 256] for s in asks[0]), rows[0])
        for i in range(start, min(len(q), start + 256)):
            near = np.flatnonzero(~(coarse[i - start] + room[i] < least[i]) & (ids != query_ids[i]))  # a NaN drops none
            for level in range(1, len(LEVELS)):
                fine = rows[level][0][near] @ asks[level][0][i] + rows[level][1][near] @ asks[level][1][i]
                near = near[~(fine + room[i] < least[i])]
            score = products(x[near], q[i])
            best = top(ids[near], score, k)
            out[0].extend([int(query_ids[i])] * len(best))
            out[1].extend(ids[near][best].tolist())
            out[2].extend(score[best].tolist())
    return out


def meet(t: pa.Table, k: int) -> pa.Table:
    asks, ids = t.column("asks").to_numpy(), t.column("vec_id").to_numpy()
    x = matrix(t.column("v").combine_chunks())
    found = search(ids[~asks], x[~asks], ids[asks], x[asks], t.column("least").to_numpy()[asks], k) if asks.any() and not asks.all() else ([], [], [])
    return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})


class Blocks:
    """The pivots of each length of vectors, and what is known of the blocks around them."""

    def __init__(self, pivots: dict[int, tuple[np.ndarray, np.ndarray]], blocks: dict[int, int]):
        self.pivots, self.centres = pivots, {d: x[: blocks[d]] for d, (_, x) in pivots.items()}
        self.envelopes: dict[int, np.ndarray] = {}

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The block of each row; rows of a length without pivots are one block."""
        c = self.centres.get(x.shape[1])
        return np.zeros(len(x), np.int64) if c is None else np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)

    def first_scores(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query among the pivots."""
        known = self.pivots.get(x.shape[1])
        out = np.full(len(x), -np.inf)
        for i in range(len(x) if known else 0):
            one = known[0] != ids[i]
            score = np.sort(products(known[1][one], x[i]))
            if len(score) >= k:
                out[i] = float(score[-k])
        return out


def dealt(own: DataFrame, blocks: Blocks) -> DataFrame:
    """Adds the block of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in by_length(whole, 4096):
                block = blocks.nearest(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), dim, np.int32)), pa.array(block.astype(np.int32)), *batch.columns], ["dim", "block", "vec_id", "v"])

    return own.mapInArrow(run, "dim int, block int, vec_id long, v array<double>")


def envelopes(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the blocks' envelopes, from partial ones of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for dim, batch in by_length(whole, 4096):
                x, block = matrix(batch.column("v")), batch.column("block").to_numpy()
                mean, deviation = segment_statistics(x, LEVELS[-1])
                per_row = np.concatenate([-mean, mean, deviation, np.linalg.norm(x, axis=1)[:, None]], axis=1)
                for b in np.unique(block):
                    most = per_row[block == b].max(axis=0)
                    found[dim, int(b)] = np.maximum(found.get((dim, int(b)), most), most)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["dim", "block", "most"]
            )

    parts = rows.mapInArrow(run, "dim int, block int, most array<double>").select("dim", "block", F.posexplode("most").alias("at", "value"))
    parts = parts.groupBy("dim", "block", "at").agg(F.max("value").alias("value")).groupBy("dim", "block")
    found = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("most")).collect()  # PIVOTS rows a length
    out: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in found}:
        of = {r["block"]: np.array(r["most"]) for r in found if r["dim"] == dim}
        width = len(next(iter(of.values())))
        out[dim] = np.full((max(of) + 1, width), np.nan)
        for b, most in of.items():
            out[dim][b] = most
        n = (width - 1) // 3
        out[dim][:, :n] *= -1
    return out


def sent(asked: DataFrame, blocks: Blocks, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(dim, block, vec_id, v, least): each query for each block that `choose` marks, by bounds, k-th best scores, and the
    block that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in by_length(whole, 512):
                if dim not in blocks.envelopes:
                    continue
                reach = envelope_bounds(matrix(batch.column("v")), blocks.envelopes[dim])
                least, seen = batch.column("least").to_numpy(), batch.column("seen").to_numpy()
                i, b = np.nonzero(choose(reach, least, seen) & ~np.isnan(blocks.envelopes[dim][:, -1]))
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), dim, np.int32)), pa.array(b.astype(np.int32)), *(batch.column(c).take(at) for c in ("vec_id", "v", "least"))], ["dim", "block", "vec_id", "v", "least"]
                )

    return asked.mapInArrow(run, "dim int, block int, vec_id long, v array<double>, least double")


def compared(rows: DataFrame, asks: DataFrame, steps: Steps, k: int) -> DataFrame:
    """(query_id, vec_id, score): what the queries find in the blocks that they are sent to. A block of many rows or queries
    is dealt to several tasks."""
    count = lambda df, n, each: df.groupBy("dim", "block").agg(F.ceil(F.count("*") / each).cast("int").alias(n))
    both = F.broadcast(steps(count(rows, "parts", ROWS).join(count(asks, "qparts", QUERIES), ["dim", "block"])))  # PIVOTS rows a length
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    key = ["dim", "block", "part", "qpart"]
    left = rows.join(both, ["dim", "block"]).select("dim", "block", place("parts").alias("part"), every("qparts").alias("qpart"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("least"))
    right = asks.join(both, ["dim", "block"]).select("dim", "block", every("parts").alias("part"), place("qparts").alias("qpart"), F.lit(True).alias("asks"), "vec_id", "v", "least")
    met = left.union(right).groupBy(*key).applyInArrow(lambda t: meet(t, k), "query_id long, vec_id long, score long")
    return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def exact_top(rows: DataFrame, queries: DataFrame, k: int = BEST, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest inner product of the vectors of
    floor(scale * x), ties to the smaller id, without rows of its own id.

    Vectors that are null, empty or hold a null, NaN or infinite component, and rows with a null id, take no part; zero
    vectors do. A best score beyond a long, or a component beyond a double after scaling, is an error. Rows of another length than a query's are no candidates of it. Rows that
    repeat an id count once, by their best score. Empty tables give no rows; other columns are not read."""
    steps = Steps(rows.sparkSession)
    # doubles from 2^53 on are whole, and floor gives a long
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y).otherwise(F.raise_error(F.lit("a scaled component exceeds a double")).cast("double"))
    pick = lambda df: (
        df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("x"))
        .select("vec_id", F.when(F.col("vec_id").isNotNull() & usable("x", zero=True), F.transform("x", lambda x: whole(x * scale))).alias("v")).where("v is not null")
    )
    own = pick(rows)
    n = {r["dim"]: r["n"] for r in own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row a length
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # PIVOTS rows
    pivots = {}
    for dim in {len(r["v"]) for r in sample}:
        of = {r["vec_id"]: r["v"] for r in sample if len(r["v"]) == dim}  # an id counts once
        pivots[dim] = np.array(list(of)), np.array(list(of.values()), np.float64)
    blocks = Blocks(pivots, {d: max(1, n.get(d, 0) // BLOCK) for d in pivots})
    placed = steps(dealt(own, blocks))
    blocks.envelopes = envelopes(placed)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, batch in by_length(whole, 1024):
                least = blocks.first_scores(batch.column("vec_id").to_numpy(), matrix(batch.column("v")), k)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(least), pa.array(np.full(len(least), -1, np.int32))], ["vec_id", "v", "least", "seen"])

    asked = steps(pick(queries).mapInArrow(begin, "vec_id long, v array<double>, least double, seen int"))

    def best_block(reach: np.ndarray, least: np.ndarray, seen: np.ndarray) -> np.ndarray:
        best = np.nan_to_num(reach, nan=-np.inf).argmax(axis=1)
        return np.arange(reach.shape[1])[None, :] == best[:, None]

    def other_blocks(reach: np.ndarray, least: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return ~(reach < least[:, None]) & (np.arange(reach.shape[1])[None, :] != seen[:, None])

    first = steps(sent(asked, blocks, best_block))
    found = steps(compared(placed, first, steps, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    seen = first.select("vec_id", F.col("block").alias("seen")).distinct()
    # a query that repeats an id with another vector may only be bounded by the pivots
    once = first.groupBy("vec_id").agg(F.count("*").alias("times"))
    again = asked.drop("seen").join(once, "vec_id", "left").join(seen.join(once.where("times = 1"), "vec_id", "left_semi"), "vec_id", "left").join(kth, F.col("vec_id") == F.col("query_id"), "left")
    tight = F.when(F.col("times") == 1, F.greatest("least", F.coalesce("kth", "least"))).otherwise(F.col("least"))
    again = steps(sent(again.select("vec_id", "v", tight.alias("least"), F.coalesce("seen", F.lit(-1)).alias("seen")), blocks, other_blocks))
    met = found.union(compared(placed, again, steps, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    score = F.when(F.col("score") > LEAST_LONG, F.col("score")).otherwise(F.raise_error(F.lit("a score exceeds a long")).cast("long"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top(rows, rows.where("vec_id % 50 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
