"""Mutual information of continuous features with a class by nearest neighbours, within ranges of the values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.sources.steps import materialized

#: Rows that a task sorts at a time, distinct values in a row of arrays, rows for each point that ranges are cut by, and rows of a range.
CHUNK, PIECE, STEP, RANGE = 1 << 22, 1 << 16, 256, 1 << 18


def digamma(n: np.ndarray) -> np.ndarray:
    """Digamma of whole numbers from 1: harmonic numbers, or from 32 on the asymptotic series, right to 1e-14."""
    n = np.asarray(n, np.float64)
    small = np.append(0.0, np.append(0.0, np.cumsum(1 / np.arange(1, 31))) - 0.5772156649015329)
    m = np.maximum(n, 32.0)
    large = np.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6)
    return np.where(n < 32, small[np.minimum(n, 31).astype(int)], large)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def rows_of(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of arrays."""
    values, at = column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    return [values[a:b] for a, b in zip(at, at[1:])]


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about `rows` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def counted_values(some: DataFrame) -> DataFrame:
    """(feature, y, x, n, points, rows): the distinct values of parts of the rows, sorted, with their counts; every STEP-th of their
    rows is a point. A row has PIECE values at most."""
    chunk, piece, step = CHUNK, PIECE, STEP

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, chunk):
            f, g = (table.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
            codes, classes, x = f.indices.to_numpy(), g.indices.to_numpy(), table.column(2).to_numpy()
            for i, feature in enumerate(f.dictionary.to_pylist()):
                here = codes == i
                own, of = x[here], classes[here]
                for j in np.unique(of):
                    values, n = np.unique(own[of == j], return_counts=True)
                    for a in range(0, len(values), piece):
                        v, m = values[a : a + piece], n[a : a + piece].astype(np.int64)
                        upto = np.cumsum(m)
                        points = v[np.searchsorted(upto, np.arange(min(step // 2, upto[-1] // 2), upto[-1], step), "right")]
                        whole = lambda c: lists(c, np.array([0, len(c)]))
                        yield pa.RecordBatch.from_arrays([pa.array([feature]), g.dictionary.take(pa.array([j])), whole(v), whole(m), whole(points), pa.array([int(upto[-1])])], ["feature", "y", "x", "n", "points", "rows"])

    return some.mapInArrow(counted, f"feature string, y {some.schema['y'].dataType.simpleString()}, x array<double>, n array<long>, points array<double>, rows long")


def range_edges(values: DataFrame, rows: int) -> dict[str, np.ndarray]:
    """Edges of ranges of about RANGE rows, for features of up to `rows` rows: a range holds what is above an edge, up to the next."""
    parts = -(-rows // RANGE)
    if parts < 2:
        return {}
    shares = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    points = values.select("feature", F.explode("points").alias("x")).groupBy("feature").agg(F.array_distinct(F.percentile_approx("x", shares, 4 * parts)).alias("e"))
    return {r["feature"]: np.array(r["e"]) for r in points.collect()}  # a number a range


def ranged_values(values: DataFrame, classes: dict[str, dict], edges: dict[str, np.ndarray], k: int) -> DataFrame:
    """(feature, range, x, y, n, rows, ends): all distinct values of a range, sorted, as one row, and the k lowest and highest of each
    class, copies and all."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feature, y, x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows_of(batch.column(2)), rows_of(batch.column(3))):
                if y in classes.get(feature, {}):
                    cuts = np.append(np.append(0, np.searchsorted(x, edges.get(feature, np.empty(0)), "right")), len(x))
                    at = np.flatnonzero(np.diff(cuts))
                    offsets = np.append(cuts[at], len(x))
                    yield pa.RecordBatch.from_arrays([pa.array([feature] * len(at)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), classes[feature][y], np.int32)), lists(x, offsets), lists(n, offsets)], ["feature", "range", "y", "x", "n"])

    def merged(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        x, n = (t[c].combine_chunks().flatten().to_numpy() for c in ("x", "n"))
        y = np.repeat(t["y"].to_numpy(), t["x"].combine_chunks().value_lengths().to_numpy())
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], n[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        x, y, n = x[first], y[first], np.add.reduceat(n, first)
        ends = []
        for c in np.unique(y).tolist():
            low, high = ((x[y == c][at], np.minimum(n[y == c][at], k)) for at in (slice(None, k), slice(None, -k - 1, -1)))
            ends.append({"y": c, "low": np.repeat(*low)[:k].tolist(), "high": np.repeat(*high)[:k].tolist()})
        kind = pa.list_(pa.struct([("y", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))
        whole = lambda c: lists(c, np.array([0, len(c)]))
        return pa.table({"feature": t["feature"][:1], "range": t["range"][:1], "x": whole(x), "y": whole(y), "n": whole(n), "rows": pa.array([int(n.sum())]), "ends": pa.array([ends], kind)})

    parts = values.select("feature", "y", "x", "n").mapInArrow(split, "feature string, range int, y int, x array<double>, n array<long>")
    return parts.groupBy("feature", "range").applyInArrow(merged, "feature string, range int, x array<double>, y array<int>, n array<long>, rows long, ends array<struct<y int, low array<double>, high array<double>>>")


def beside(cells: DataFrame, k: int) -> DataFrame:
    """(feature, range, halo): for each class of a range the k values next below and above it, nearest first. They lie in the k
    ranges next to it that hold the class at most."""
    order = Window.partitionBy("feature", "end.y").orderBy("range")  # a row a range and class
    none = F.array().cast("array<double>")
    next_ = lambda step, c: F.slice(F.concat(*(F.coalesce(step(c, j).over(order), none) for j in range(1, k + 1))), 1, k)
    ends = cells.select("feature", "range", F.explode("ends").alias("end")).select("feature", "range", "end", next_(F.lag, "end.high").alias("below"), next_(F.lead, "end.low").alias("above"))
    return ends.groupBy("feature", "range").agg(F.collect_list(F.struct("end.y", "below", "above")).alias("halo"))


def radii(x: np.ndarray, n: np.ndarray, below: np.ndarray, above: np.ndarray, k: int) -> np.ndarray:
    """Distances to the k-th nearest neighbour of sorted distinct values with n copies each, the least of a value's copies, and
    just under them, so that the neighbour at it stays out in spite of rounding. k + 1 copies of a value suffice."""
    copies = np.minimum(n, k + 1)
    start = np.append(0, np.cumsum(copies)[:-1])
    rows = np.concatenate([below[::-1], np.repeat(x, copies), above])
    at = np.arange(len(below), len(rows) - len(above))
    padded = np.concatenate([np.full(k, -np.inf), rows, np.full(k, np.inf)])
    # j neighbours below and the others above: the farther of the two ends
    far = np.min([np.maximum(rows[at] - padded[at + k - j], padded[at + 2 * k - j] - rows[at]) for j in range(k + 1)], axis=0)
    return np.minimum.reduceat(far, start) * (1 - 1e-9)


def knn_information(long: DataFrame, k: int = 3) -> DataFrame:
    """(feature, mi) of continuous features with a discrete class by nearest neighbours (Ross, PLoS ONE 9(2), 2014).

    The radius of a value is the distance to the k-th nearest neighbour of its class; then all points strictly within it are
    counted. Classes of one row are left out. Tasks count distinct values, which are then parted into ranges; a range also
    gets the k values of each class next to it on both sides, which is all that radii need. What lies within a radius is
    counted in the range; at most 2 * k values of a class and range have radii that reach over its ends, and only they ask
    the ranges where these end. The driver keeps an edge a range and a number a class."""
    some = long.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("feature", "y", F.col("x").cast("double").alias("x"))
    values = materialized(counted_values(some))
    sizes: dict[str, dict] = {}
    for r in values.groupBy("feature", "y").agg(F.sum("rows").alias("n")).where("n > 1").collect():
        sizes.setdefault(r["feature"], {})[r["y"]] = r["n"]
    classes = {f: {y: i for i, y in enumerate(own)} for f, own in sizes.items()}
    nearest = {f: [min(k, n - 1) for n in own.values()] for f, own in sizes.items()}
    edges = range_edges(values, max((sum(own.values()) for own in sizes.values()), default=0))
    cells = materialized(ranged_values(values, classes, edges, k))
    halos = materialized(beside(cells, k))  # a few numbers a range, as a table, so that Spark sees its size

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(rows_of(batch.column(i)) for i in (2, 3, 4)), batch.column(5).to_pylist())
            for feature, place, x, y, n, halo in zip(*columns):
                upto, ends = np.append(0, np.cumsum(n)), np.concatenate([[-np.inf], edges.get(feature, np.empty(0)), [np.inf]])
                total, asked = 0.0, []
                for h in halo:
                    own, w = x[y == h["y"]], n[y == h["y"]]
                    r = radii(own, w, np.array(h["below"], float), np.array(h["above"], float), nearest[feature][h["y"]])
                    low, high = own - r, own + r
                    inside = ((low > ends[place]) | (place == 0)) & ((high <= ends[place + 1]) | (place == len(ends) - 2))
                    m = upto[np.searchsorted(x, high[inside], "right")] - upto[np.searchsorted(x, low[inside], "left")]
                    total += float(np.sum(w[inside] * digamma(m)))
                    asked.append(np.stack([w[~inside], low[~inside], high[~inside]]))
                w, low, high = np.concatenate(asked, axis=1)
                q = (place << 32) + np.arange(len(w))
                t = np.append(low, high)
                at = np.searchsorted(ends[1:-1], t, "left")
                own = [pa.array([feature] * (len(t) + 1)), pa.array([total] + [None] * len(t)), pa.array([None, *q.tolist(), *q.tolist()], pa.int64()), pa.array([None, *w.tolist(), *w.tolist()], pa.float64()).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, pa.array([None, *t.tolist()], pa.float64()), pa.array([None] + [False] * len(w) + [True] * len(w), pa.bool_()), pa.array([None, *at.tolist()], pa.int32())], ["feature", "s", "q", "w", "t", "high", "range"])

    met = cells.select("feature", "range", "x", "y", "n").join(halos, ["feature", "range"])
    found = materialized(met.mapInArrow(within, "feature string, s double, q long, w long, t double, high boolean, range int"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cells.select("feature", "range", "rows").withColumn("before", before)  # a row a range
    asks = found.where("q IS NOT NULL").groupBy("feature", "range").agg(F.collect_list(F.struct("q", "w", "t", "high")).alias("asks"))
    # a range without values is asked too; what is up to its end lies before it
    every = totals.select("feature", F.col("range").alias("_range"), "rows", "before")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feature, x, n, start, asked in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), rows_of(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                upto, t, high = np.append(start, start + np.cumsum(n)), np.array([a["t"] for a in asked]), np.array([a["high"] for a in asked])
                c = np.where(high, upto[np.searchsorted(x, t, "right")], -upto[np.searchsorted(x, t, "left")])
                yield pa.RecordBatch.from_arrays([pa.array([feature] * len(t)), pa.array([a["q"] for a in asked], pa.int64()), pa.array([a["w"] for a in asked], pa.int64()), pa.array(c, pa.int64())], ["feature", "q", "w", "c"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() * digamma(batch.column(2).to_numpy()))], ["feature", "s"])

    asks = materialized(asks)
    held = cells.select("feature", "range", "x", "n").join(totals.select("feature", "range", "before"), ["feature", "range"]).join(asks, ["feature", "range"])
    # approximate edges are values of the feature, so no range but those of classes left out lacks rows: all before it are below
    lacking = asks.join(cells.select("feature", "range"), ["feature", "range"], "left_anti").select("feature", F.col("range").alias("_at"), F.explode("asks").alias("a"))
    below = lacking.join(every, "feature").groupBy("feature", "a.q", "a.w", "a.high").agg(F.sum(F.when(F.col("_range") < F.col("_at"), F.col("rows")).otherwise(0)).alias("c"))
    below = below.select("feature", "q", "w", F.when(F.col("high"), F.col("c")).otherwise(-F.col("c")).alias("c"))
    ends = held.select("feature", "x", "n", "before", "asks").mapInArrow(counts, "feature string, q long, w long, c long").unionByName(below)
    over = ends.groupBy("feature", "q").agg(F.max("w").alias("w"), F.sum("c").alias("m")).select("feature", "w", "m").mapInArrow(summed, "feature string, s double")
    sums = found.where("q IS NULL").select("feature", "s").unionByName(over).groupBy("feature").agg(F.sum("s").alias("s"))
    out = []
    for r in sums.collect():  # features
        n, own = sum(sizes[r["feature"]].values()), np.array(list(sizes[r["feature"]].values()))
        same = float(np.sum(own * (digamma(np.array(nearest[r["feature"]])) - digamma(own))))
        out.append((r["feature"], max(0.0, float(digamma(n)) + (same - r["s"]) / n)))
    return some.sparkSession.createDataFrame(out, "feature string, mi double")
