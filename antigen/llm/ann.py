"""Operator 1, approximate nearest neighbours by cross-polytope hashing.

Vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard transform); the
nearest signed axis is a vector's bucket, and more than one rotation is used in a table where one has too few axes. A query
probes its best buckets of every table. Rows of unlike length are hashed apart, in bands of length, and a query probes all
bands. How many buckets it probes is measured, at every size: the true neighbours of a bounded sample of queries among all
rows, found in one pass, tell how many probes find `RECALL` of them; where even many don't, coarser buckets are taken.

Buckets are dealt to groups of about `PART` rows. A row goes to one group of each table, and a query once to each group that
holds buckets it probes, with their list; there it is compared with the rows of these buckets alone. A query that finds
fewer rows than it asks for meets all, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from antigen.llm.common import Steps, checkpoint, table

TABLES, NEIGHBOURS = 3, 20
#: Rows that a bucket should hold on the average.
BUCKET_ROWS = 200
#: Rows and queries that meet in one task, on the average, and groups of buckets of one table at most; a group of more rows
#: is dealt to parts.
PART, QUERY_PART, MOST_GROUPS = 16384, 2048, 4096
#: Rows of one band differ in length by this factor at most.
BAND = 1.5
#: Queries whose true neighbours are found to set the probes, the share of them that the probes must find, and probes of a
#: table at most, beyond which coarser buckets are taken.
SAMPLE, RECALL, MOST_PROBES = 200, 0.95, 2048
#: A band or length of vectors with fewer sampled neighbours than this goes by the others' share of buckets.
LEAST_PAIRS = 100


def usable(v: str, zero: bool = False) -> Column:
    """Whether a vector has components and all are finite, and (unless `zero`) not all are 0."""
    inf = float("inf")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < inf) & ~F.isnan(x), F.lit(False)))
    some = F.lit(True) if zero else F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) > 0) & finite & some, F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def axes_for(rows: int, width: int) -> list[int]:
    """How many axes each rotation of a table offers, so that buckets hold about BUCKET_ROWS rows. Another rotation comes in
    only once its eight signed axes are wanted, as buckets that are too small lose neighbours."""
    left, out = max(8.0, rows / BUCKET_ROWS), []
    while left >= 8:
        n = 4
        while n < width and 2 * n < left:
            n *= 2
        out.append(min(n, width))
        left /= 2 * n
    return out


def rotated(x: np.ndarray, width: int, index: int, axes: list[int]) -> list[np.ndarray]:
    """For each rotation of a table the inner products with its signed axes."""
    out = []
    for k, n in enumerate(axes):
        rng = np.random.default_rng([index, k, width])
        y = np.zeros((len(x), width))
        y[:, : x.shape[1]] = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], width))
        out.append(np.concatenate([y[:, :n], -y[:, :n]], axis=1))
    return out


def buckets(x: np.ndarray, index: int, axes: list[int], probes: int) -> np.ndarray:
    """The best `probes` buckets of each row in a table, the nearest signed axes first."""
    width = 1
    while width < x.shape[1]:
        width *= 2
    codes, costs = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for y in rotated(x, width, index, axes):
        near = np.argsort(-y, axis=1, kind="stable")[:, :probes]
        loss = np.take_along_axis(y, near[:, :1], 1) - np.take_along_axis(y, near, 1)
        codes = (codes[:, :, None] * y.shape[1] + near[:, None, :]).reshape(len(x), -1)
        costs = (costs[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
        best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        codes, costs = np.take_along_axis(codes, best, 1), np.take_along_axis(costs, best, 1)
    return codes


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; dividing by the largest component first keeps squares from running over or under."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def width_of(dim: int) -> int:
    return 1 << (dim - 1).bit_length()


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, which have one length, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch whose vectors have one length."""
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        dims = part.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            yield int(dim), part if (dims == dim).all() else part.take(pa.array(np.flatnonzero(dims == dim)))


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, cells: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) positions of each query's k best rows, by inner product and then by id, without rows of its own
    id. `cells` lists pairs of positions of queries and rows that meet; all do without it. Products of matrices choose, with
    room for their rounding; sums in a fixed order decide, so that equal vectors score equally everywhere."""
    if len(ids) != len(np.unique(ids)):  # an id counts once in the end
        k *= int(np.unique(ids, return_counts=True)[1].max())
    cells = [(np.arange(len(q)), np.arange(len(ids)))] if cells is None else cells
    rough, tops = [], []
    for asks, rows in cells:
        y = q[asks] @ x[rows].T
        y[query_ids[asks][:, None] == ids[rows][None, :]] = -np.inf
        rough.append(y)
        best = -np.partition(-y, k - 1, axis=1)[:, :k] if y.shape[1] > k else y
        tops.append((np.repeat(asks, best.shape[1]), best.ravel()))
    none = np.zeros(0, np.int64)
    who = np.concatenate([none, *(t[0] for t in tops)])
    value = np.concatenate([np.zeros(0), *(t[1] for t in tops)])
    order = np.lexsort((-value, who))
    who, value = who[order], value[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    least = np.full(len(q), -np.inf)
    least[who[place == k - 1]] = value[place == k - 1]
    room = 1e-9 * (1 + np.abs(value[np.isfinite(value)]).max(initial=0))
    pairs = [(none, none)]
    for (asks, rows), y in zip(cells, rough):
        i, j = np.nonzero((y >= least[asks][:, None] - room) & (y > -np.inf))
        pairs.append((asks[i], rows[j]))
    asks, rows = (np.concatenate(p) for p in zip(*pairs))
    score = np.concatenate([np.zeros(0), *((x[rows[i : i + 65536]] * q[asks[i : i + 65536]]).sum(axis=1) for i in range(0, len(asks), 65536))])
    order = np.lexsort((ids[rows], -score, asks))
    asks, rows, score = asks[order], rows[order], score[order]
    chosen = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
    return asks[chosen], rows[chosen], score[chosen]


def ranked(pairs: DataFrame, k: int, *more: str) -> DataFrame:
    """(query_id, rank, vec_id, score, ...): the k best of each query, an id once, ties to the smaller one."""
    met = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), *(F.first(c).alias(c) for c in more))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def true_neighbours(own: DataFrame, asked: DataFrame, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the sampled queries and their k nearest rows, a pair a row, by one pass over all rows."""
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["v"]) for r in sample}:
        of = [r for r in sample if len(r["v"]) == dim]
        known[dim] = np.array([r["vec_id"] for r in of]), np.array([r["v"] for r in of], np.float64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for dim, batch in by_length(whole, 8192):
                if dim not in known:
                    continue
                query_ids, q = known[dim]
                ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
                asks, rows, score = best_of(ids, x, query_ids, q, k)
                new = (asks, ids[rows], x[rows], score)
                if dim in best:
                    new = tuple(np.concatenate(p) for p in zip(best[dim], new))
                    order = np.lexsort((new[1], -new[3], new[0]))
                    order = order[np.arange(len(order)) - np.searchsorted(new[0][order], new[0][order]) < k]
                    new = tuple(p[order] for p in new)
                best[dim] = new
        for dim, (asks, ids, x, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(known[dim][0][asks]), pa.array(ids), pa.array(score), pa.array(list(x), pa.list_(pa.float64()))], ["query_id", "vec_id", "score", "v"])

    found = ranked(own.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score double, v array<double>"), k, "v").collect()  # k * SAMPLE rows
    out = {}
    for dim, (query_ids, q) in known.items():
        of, at = [r for r in found if len(r["v"]) == dim], {n: i for i, n in enumerate(query_ids)}
        if of:
            out[dim] = q[[at[r["query_id"]] for r in of]], np.array([r["v"] for r in of])
    return out


def needed_probes(q: np.ndarray, x: np.ndarray, axes: list[int]) -> np.ndarray:
    """For each pair of a query and a neighbour how many probes of each table find it, MOST_PROBES + 1 if so many don't."""
    limit = min(MOST_PROBES, math.prod(2 * n for n in axes))
    out = np.full(len(q), MOST_PROBES + 1)
    for t in range(TABLES):
        own = buckets(x, t, axes, 1)
        for start in range(0, len(q), 64):
            probed = buckets(q[start : start + 64], t, axes, limit) == own[start : start + 64]
            found = np.where(probed.any(axis=1), probed.argmax(axis=1) + 1, MOST_PROBES + 1)
            out[start : start + 64] = np.minimum(out[start : start + 64], found)
    return out


def hashing(sizes: dict[int, dict[int, int]], pairs: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, dict[int, tuple[list[int], int, int]]]:
    """For each length and band of vectors: the axes of its tables, the probes, and the groups of buckets."""
    measured: dict[tuple, int] = {}

    def probes(dim: int, axes: list[int]) -> int:
        key = (dim, *axes)
        if key not in measured:
            q, x = pairs[dim]
            order = np.sort(needed_probes(unit(q), unit(x), axes))
            measured[key] = int(order[min(len(order) - 1, math.ceil(RECALL * len(order)) - 1)])
        return measured[key]

    out: dict[int, dict[int, tuple[list[int], int, int]]] = {}
    for dim, bands in sizes.items():
        for band, n in bands.items():
            axes = axes_for(n, width_of(dim))
            if dim in pairs and len(pairs[dim][0]) >= LEAST_PAIRS:
                while len(axes) > 1 and probes(dim, axes) > MOST_PROBES:
                    axes = axes[:-1]
                found = min(probes(dim, axes), math.prod(2 * a for a in axes))
            else:  # too few were sampled: a half of the buckets
                axes = axes[:1]
                found = axes[0]
            out.setdefault(dim, {})[band] = axes, found, min(MOST_GROUPS, max(1, round(n / PART)))
    return out


def hashed(rows: DataFrame, settings: dict[int, dict[int, tuple[list[int], int, int]]], queries: bool) -> DataFrame:
    """(dim, band, tbl, grp, bucket, vec_id, v): a row for each table, and for queries for each band, table and group that
    holds buckets they probe, with the list of these. Only directions are hashed, as lengths within a band are alike."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in by_length(whole, 256 if queries else 2048):
                x, bands = unit(matrix(batch.column("v"))), batch.column("band").to_numpy(zero_copy_only=False)
                for band, (axes, probes, groups) in settings.get(dim, {}).items():
                    own = np.arange(len(x)) if queries else np.flatnonzero(bands == band)
                    for t in range(TABLES if len(own) else 0):
                        codes = buckets(x[own], t, axes, probes if queries else 1)
                        at = np.repeat(own, codes.shape[1])
                        flat = codes.ravel()
                        grp = (flat * 40503 >> 4) % groups
                        order = np.lexsort((flat, grp, at))
                        at, flat, grp = at[order], flat[order], grp[order]
                        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (grp[1:] != grp[:-1])]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(flat))
                        where = pa.array(at[first])
                        number = lambda n: pa.array(np.full(len(first), n, np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [number(dim), number(band), number(t), pa.array(grp[first].astype(np.int32)), lists, batch.column("vec_id").take(where), batch.column("v").take(where)],
                            ["dim", "band", "tbl", "grp", "bucket", "vec_id", "v"],
                        )

    return rows.mapInArrow(run, f"dim int, band int, tbl int, grp int, bucket array<long>, vec_id long, v {kind}")


def meet(k: int):
    """The function of one task: the queries' best rows among those of the buckets that they probe."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids, lists = t.column("asks").to_numpy(), t.column("vec_id").to_numpy(), t.column("bucket").combine_chunks()
        x = matrix(t.column("v").combine_chunks())
        owner, bucket = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
        out = ([], [], [])
        if asks.any() and not asks.all():
            order = np.lexsort((owner, ~asks[owner], bucket))
            owner, bucket = owner[order], bucket[order]
            cells = []
            for part in np.split(owner, np.flatnonzero(np.diff(bucket)) + 1):
                q = part[asks[part]]
                if len(q) and len(q) < len(part):
                    cells.extend((q[i : i + 512], part[len(q) :]) for i in range(0, len(q), 512))
            asking, found, score = best_of(ids, x, ids, x, k, cells)
            out = ids[asking], ids[found], score
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows found with the largest inner product, ties to the
    smaller id, without rows of its own id.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component, and rows with a null id, take no part.
    Rows of another length than a query's are no candidates of it. Rows that repeat an id count once, by their best
    score; queries that repeat an id are one query. Empty tables give no rows; other columns are not read."""
    exact = isinstance(rows.schema[vector_col].dataType, T.ArrayType) and isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "array<float>" if exact and rows.schema[vector_col].dataType == queries.schema[vector_col].dataType else "array<double>"
    pick = lambda df: df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    steps = Steps(rows.sparkSession)
    asked = steps(pick(queries))
    picked = steps(pick(rows).select("vec_id", "v", F.size("v").alias("dim"), F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))).alias("largest")))
    # the logarithm of the length; the largest component apart, as squares may run over
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("largest")) * (x / F.col("largest")))
    own = picked.withColumn("length", F.log("largest") + F.log(squares) / 2)
    longest = {r["dim"]: r["hi"] for r in own.groupBy("dim").agg(F.max("length").alias("hi")).collect()}  # a row a length
    top = F.create_map(*(F.lit(c) for pair in longest.items() for c in pair))[F.col("dim")] if longest else F.lit(0.0)
    own = steps(own.select("vec_id", "v", "dim", F.floor((top - F.col("length")) / math.log(BAND)).cast("int").alias("band")))
    steps.forget(picked)
    sizes: dict[int, dict[int, int]] = {}
    for r in own.groupBy("dim", "band").agg(F.count("*").alias("n")).collect():  # a row a length and band
        sizes.setdefault(r["dim"], {})[r["band"]] = r["n"]
    known = (asked.where(F.size("v").isin(*sizes)) if sizes else asked.limit(0)).withColumn("band", F.lit(0))
    settings = hashing(sizes, true_neighbours(own, known, k))
    index, probes = hashed(own.drop("dim"), settings, False), hashed(known, settings, True)
    key = ["dim", "band", "tbl", "grp"]
    count = lambda df: {tuple(r[c] for c in key): r["n"] for r in df.groupBy(*key).agg(F.count("*").alias("n")).collect()}
    # a row for each table and group of buckets; vectors are hashed again where they are sent, which costs less than keeping them
    n_rows, n_asks = count(index.select(*key)), count(probes.select(*key))
    spark = rows.sparkSession
    deal = [(*g, -(-n_rows[g] // (2 * PART)), -(-n_asks[g] // QUERY_PART)) for g in n_rows if g in n_asks]
    both = spark.createDataFrame(deal, "dim int, band int, tbl int, grp int, parts int, qparts int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    dealt = F.broadcast(both)  # up to TABLES * MOST_GROUPS rows a length and band
    left = index.join(dealt, key).select(*key, place("parts").alias("part"), every("qparts").alias("qpart"), F.lit(False).alias("asks"), "bucket", "vec_id", "v")
    right = probes.join(dealt, key).select(*key, every("parts").alias("part"), place("qparts").alias("qpart"), F.lit(True).alias("asks"), "bucket", "vec_id", "v")
    result = "query_id long, vec_id long, score double"
    found = checkpoint(ranked(left.union(right).groupBy(*key, "part", "qpart").applyInArrow(meet(k), result), k))
    got = found.groupBy("query_id").agg(F.count("*").alias("n"))
    few = checkpoint(known.join(got, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "v"))
    if few.isEmpty():
        return found
    # they meet all rows in blocks
    blocks, qblocks = max(1, -(-sum(n for b in sizes.values() for n in b.values()) // PART)), max(1, -(-few.count() // QUERY_PART))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    bucket = F.array(F.lit(0).cast("long")).alias("bucket")
    left = own.select("dim", spot(blocks).alias("part"), all_of(qblocks).alias("qpart"), F.lit(False).alias("asks"), bucket, "vec_id", "v")
    right = few.select(F.size("v").alias("dim"), all_of(blocks).alias("part"), spot(qblocks).alias("qpart"), F.lit(True).alias("asks"), bucket, "vec_id", "v")
    rest = left.union(right).groupBy("dim", "part", "qpart").applyInArrow(meet(k), result)
    return ranked(found.select("query_id", "vec_id", "score").union(rest), k)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
