"""Random forests of two classes whose trees stay with the tasks, with MLlib's parameters.

MLlib gathers all nodes of its forests on the driver. Here the driver holds what is above nodes of OWN draws only: such large nodes
are parted by histograms that all tasks count; a smaller node's rows are dealt to one task, which grows all below it. Trees meet the
rows that they score in a shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antigen.operators.neighbours import chunks
from antigen.sources.steps import materialized

#: Draws of a node that one task grows, rows and nodes that a task scores at a time, groups of trees at least, nodes parted at a
#: time and bytes of histograms held by a task.
OWN, BLOCK, NODES, GROUPS, STEP, HELD = 1 << 18, 1 << 16, 1 << 19, 8, 256, 1 << 26
#: Rows that are sorted at a time, and points of each class among them that cuts are chosen from.
CHUNK, POINTS = 1 << 16, 512
#: What a gain must exceed, and 1 as scores are summed, whatever the order.
LEAST_GAIN, ONE = 1e-13, 1 << 40


@dataclass(frozen=True)
class Settings:
    """Of all trees. `weight` is that of a row of each class; a feature's bin b holds what is above cuts[b - 1], up to cuts[b]."""

    seed: int
    trees: int
    depth: int
    bins: int
    picked: int
    least: int
    gain: float
    weight: np.ndarray
    cuts: list[np.ndarray]
    upto: np.ndarray

    @property
    def bits(self) -> int:
        return (self.bins - 1).bit_length()

    def rng(self, *ids: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, *ids])


@dataclass
class Tree:
    """Nodes: the feature (-1: none), the bin up to which rows go left, the left child (the right one is next), draws of each class."""

    f: np.ndarray
    cut: np.ndarray
    lo: np.ndarray
    n: np.ndarray


def settings(train: DataFrame, features: list[str], y: str, of: RandomForestClassifier) -> tuple[Settings, int]:
    """And the number of rows."""
    n = {r[y]: r["_n"] for r in train.groupBy(y).agg(F.count("*").alias("_n")).limit(3).collect()}
    if not n or not set(n) <= {0, 1}:
        raise ValueError(f"a forest takes labels 0 and 1, not {sorted(map(str, n))}")
    bins = of.getMaxBins()
    if bins > 256:
        raise ValueError("a forest takes 256 bins at most")
    rows = sum(n.values())
    weight = np.array([rows / (2 * n[c]) if c in n else 1.0 for c in (0, 1)])
    cuts = quantiles(train, features, y, bins, weight)
    rate, upto, term = of.getSubsamplingRate(), [], math.exp(-of.getSubsamplingRate())
    for k in range(64):  # Poisson draws: up to which share of a hash's values they are at most k
        upto.append(min(int((upto[-1] if upto else 0) + term * 2**64), 2**64 - 1))
        term *= rate / (k + 1)
    picked = math.ceil(math.sqrt(len(features))) if of.getNumTrees() > 1 else len(features)
    return Settings(of.getSeed() & (2**63 - 1), of.getNumTrees(), of.getMaxDepth(), bins, picked, of.getMinInstancesPerNode(), of.getMinInfoGain(), weight, cuts, np.array(upto, np.uint64)), rows


def quantiles(train: DataFrame, features: list[str], y: str, bins: int, weight: np.ndarray) -> list[np.ndarray]:
    """Each feature's cuts into bins of like weight, to 1 / POINTS of all rows; every value is one where there are few."""
    chunk, points = CHUNK, POINTS

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, chunk):
            own = table[0].to_numpy()
            for i in range(len(features)):
                v = table[1 + i].to_numpy()
                each = []
                for c in (0, 1):
                    x, n = np.unique(v[own == c], return_counts=True)
                    if len(x) > points:
                        upto = np.cumsum(n)
                        some = np.unique(np.searchsorted(upto, np.arange(1, points + 1) * upto[-1] // points))
                        x, n = x[some], np.diff(upto[some], prepend=0)
                    each.append((x, n * weight[c]))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([np.concatenate(a).tobytes()], pa.binary()) for a in zip(*each))], ["feature", "x", "w"])

    def cut(table: pa.Table) -> pa.Table:
        x, w = (np.frombuffer(b"".join(table[c].to_pylist())) for c in ("x", "w"))
        few = np.unique(x)
        order = np.argsort(x, kind="stable")
        upto = np.cumsum(w[order])
        cuts = few[:-1] if len(few) <= bins else np.unique(x[order][np.searchsorted(upto, np.arange(1, bins) / bins * upto[-1])])
        return pa.table({"feature": table["feature"][:1], "cuts": pa.array([cuts.tobytes()], pa.binary())})

    rows = train.select(F.col(y).cast("int"), *(F.col(f).cast("double") for f in features)).toDF("y", *(f"x{i}" for i in range(len(features))))
    found = rows.mapInArrow(thinned, "feature int, x binary, w binary").groupBy("feature").applyInArrow(cut, "feature int, cuts binary").collect()  # a row a feature
    return [np.frombuffer(r["cuts"]) for r in sorted(found, key=lambda r: r["feature"])]


def packed(x: np.ndarray, bits: int) -> np.ndarray:
    """Eight values in `bits` bytes."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8), 8), np.uint64)
    wide.reshape(len(x), -1)[:, : x.shape[1]] = x
    word = np.bitwise_or.reduce(wide << (bits * np.arange(8)).astype(np.uint64), axis=2)
    return word.astype("<u8")[:, :, None].view(np.uint8)[:, :, :bits].reshape(len(x), -1)


def unpacked(data: bytes, rows: int, features: int, bits: int) -> np.ndarray:
    word = np.zeros((rows, -(-features // 8), 8), np.uint8)
    word[:, :, :bits] = np.frombuffer(data, np.uint8).reshape(*word.shape[:2], bits)
    word, out = word.view("<u8")[:, :, 0], np.empty(word.shape, np.uint8)
    for i in range(8):
        out[:, :, i] = (word >> np.uint64(bits * i)) & np.uint64((1 << bits) - 1)
    return np.ascontiguousarray(out.reshape(rows, -1)[:, :features])


def binned(df: DataFrame, features: list[str], s: Settings, **kept: tuple[Column, str]) -> DataFrame:
    """The columns `kept`, with their types, and `x`: the bins of all features, packed."""
    names = list(kept)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.empty((b.num_rows, len(features)), np.uint8)
            for i, c in enumerate(s.cuts):
                v = b.column(len(names) + i).to_numpy(zero_copy_only=False)
                if np.isnan(v).any():
                    raise ValueError(f"{features[i]} has values that are missing or no numbers")
                x[:, i] = np.searchsorted(c, v)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([r.tobytes() for r in packed(x, s.bits)], pa.binary())], [*names, "x"])

    columns = [*(c.cast(kind).alias(name) for name, (c, kind) in kept.items()), *(F.col(f).cast("double") for f in features)]
    return df.select(*columns).mapInArrow(put, ", ".join(f"{name} {kind}" for name, (_, kind) in kept.items()) + ", x binary")


def draws(key: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson numbers by a hash of the row."""
    z = key.view(np.uint64) ^ np.random.SeedSequence([s.seed, tree]).generate_state(1, np.uint64)[0]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(s.upto, z ^ (z >> np.uint64(31)), side="right")


def walked(x: np.ndarray, t: Tree) -> np.ndarray:
    """The last node of each row."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        here = at[rows]
        inner = t.f[here] >= 0
        rows, here = rows[inner], here[inner]
        at[rows] = t.lo[here] + (x[rows, t.f[here]] > t.cut[here])
    return at


def picks(rng: np.random.Generator, nodes: int, s: Settings) -> np.ndarray:
    """The features that each node chooses among."""
    return np.sort(np.argpartition(rng.random((nodes, len(s.cuts))), s.picked - 1, axis=1)[:, : s.picked], axis=1)


def counted(x: np.ndarray, y: np.ndarray, n: np.ndarray, rows: np.ndarray, node: np.ndarray, features: np.ndarray, s: Settings) -> np.ndarray:
    """Draws of these rows by node, place in `features`, bin and class."""
    nodes, k = features.shape
    at = x.ravel().take((rows * x.shape[1])[:, None] + features[node]).astype(np.int64)
    at *= 2
    at += (node * (k * s.bins * 2) + y[rows])[:, None]
    at += np.arange(k) * (s.bins * 2)
    return np.bincount(at.ravel(), weights=np.repeat(n[rows], k), minlength=nodes * k * s.bins * 2).reshape(nodes, k, s.bins, 2)


def purity(n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights times sums of squared shares, the higher the purer."""
    a, b = n[..., 0] * s.weight[0], n[..., 1] * s.weight[1]
    return (a * a + b * b) / np.maximum(a + b, np.finfo(float).tiny)


def parted(h: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node, by Gini's gain: the place of its best feature, the bin that ends the left side, the draws there, and whether it
    parts at all."""
    nodes = np.arange(len(h))
    left, total = h.cumsum(axis=2)[:, :, :-1], h[:, 0].sum(axis=1)
    right = total[:, None, None] - left
    fits = (left[..., 0] + left[..., 1] >= s.least) & (right[..., 0] + right[..., 1] >= s.least)
    value = np.where(fits, purity(left, s) + purity(right, s), -1.0)
    best = value.reshape(len(h), -1).argmax(axis=1)
    j, cut = best // (s.bins - 1), best % (s.bins - 1)
    gain = (value[nodes, j, cut] - purity(total, s)) / (total * s.weight).sum(axis=-1)
    return j, cut, left[nodes, j, cut], (gain > LEAST_GAIN) & (gain >= s.gain)


def grown(x: np.ndarray, y: np.ndarray, n: np.ndarray, depth: int, rng: np.random.Generator, s: Settings) -> Tree:
    """A tree by levels, from a node of this depth on, merged and without what that leaves apart."""
    rows, node, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.bincount(y, weights=n, minlength=2)[None]
    levels, starts = [], [0]
    while len(total):
        f, cut, lo = np.full(len(total), -1), np.zeros(len(total), np.int64), np.full(len(total), -1)
        levels.append((f, cut, lo, total))
        starts.append(starts[-1] + len(total))
        inner = (total.min(axis=1) > 0) & (depth < s.depth)
        ids = np.flatnonzero(inner)
        kept = inner[node]
        rows, node = rows[kept], (np.cumsum(inner) - 1)[node[kept]]
        order = np.argsort(node.astype(np.min_scalar_type(len(ids))), kind="stable")
        rows, node = rows[order], node[order]
        features, ends = picks(rng, len(ids), s), np.searchsorted(node, np.arange(len(ids) + 1))
        j, c, left, parts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros((len(ids), 2)), np.zeros(len(ids), bool)
        for a in range(0, len(ids), STEP):
            b = min(a + STEP, len(ids))
            own = rows[ends[a] : ends[b]]
            j[a:b], c[a:b], left[a:b], parts[a:b] = parted(counted(x, y, n, own, node[ends[a] : ends[b]] - a, features[a:b], s), s)
        f[ids[parts]], cut[ids[parts]] = features[parts, j[parts]], c[parts]
        lo[ids[parts]] = starts[-1] + 2 * np.arange(parts.sum())
        kept = parts[node]
        rows, node = rows[kept], node[kept]
        node = 2 * (np.cumsum(parts) - 1)[node] + (x[rows, features[node, j[node]]] > c[node])
        total, depth = np.stack([left[parts], total[ids[parts]] - left[parts]], axis=1).reshape(-1, 2), depth + 1
    t = Tree(*(np.concatenate(c) for c in zip(*levels)))
    merge(t, starts, s)
    kept = np.zeros(len(t.f), bool)
    kept[0] = True
    for a, b in zip(starts, starts[1:]):
        inner = np.arange(a, b)[kept[a:b] & (t.f[a:b] >= 0)]
        kept[t.lo[inner]] = kept[t.lo[inner] + 1] = True
    return Tree(t.f[kept], t.cut[kept], (np.cumsum(kept) - 1)[t.lo[kept]], t.n[kept])


def merge(t: Tree, starts: list[int], s: Settings) -> None:
    """Leaves that predict the same class as their sibling go, as in MLlib; `starts`: where levels begin."""
    one = sided(t.n, s)
    for a, b in reversed(list(zip(starts, starts[1:]))):
        inner = np.arange(a, b)[t.f[a:b] >= 0]
        lo = t.lo[inner]
        t.f[inner[(t.f[lo] < 0) & (t.f[lo + 1] < 0) & (one[lo] == one[lo + 1])]] = -1


def sided(n: np.ndarray, s: Settings) -> np.ndarray:
    return n[:, 1] * s.weight[1] > n[:, 0] * s.weight[0]


def shares(n: np.ndarray, s: Settings) -> np.ndarray:
    """The weight of class 1 in each node, in parts of ONE."""
    w = n * s.weight
    return np.rint(w[:, 1] / np.maximum(w.sum(axis=1), np.finfo(float).tiny) * ONE).astype(np.int64)


def tops(rows: DataFrame, n: int, s: Settings) -> tuple[list[Tree], list[np.ndarray], list[np.ndarray]]:
    """Of each tree what is above nodes of OWN draws, the nodes' depths, and which of them a task is to grow."""
    trees = [Tree(np.array([-1]), np.array([0]), np.array([-1]), np.zeros((1, 2))) for _ in range(s.trees)]
    depths = [np.array([0]) for _ in trees]
    own = [np.array([n <= OWN]) for _ in trees]
    large = {t: np.array([0]) for t in range(s.trees) if n > OWN}
    while large:
        found: dict[int, list] = {}
        for r in histograms(rows, trees, large, s).collect():  # a row a large node, thousands of draws each
            found.setdefault(r["tree"], []).append(r)
        large, before = {}, large
        for t, nodes in before.items():
            tree, depth = trees[t], int(depths[t][nodes[0]])
            by = {r["node"]: r for r in found.get(t, [])}
            kids = []
            for at in nodes:
                r = by.get(int(at))
                if r is None:
                    continue
                tree.n[at] = r["n0"], r["n1"]
                if r["parts"]:
                    tree.f[at], tree.cut[at], tree.lo[at] = r["f"], r["cut"], len(tree.f) + len(kids)
                    kids += [(r["l0"], r["l1"]), (r["n0"] - r["l0"], r["n1"] - r["l1"])]
            if not kids:
                continue
            start, k = len(tree.f), np.array(kids, float)
            trees[t] = Tree(*(np.concatenate([a, b]) for a, b in ((tree.f, np.full(len(k), -1)), (tree.cut, np.zeros(len(k), int)), (tree.lo, np.full(len(k), -1)), (tree.n, k))))
            depths[t] = np.append(depths[t], np.full(len(k), depth + 1))
            inner = (k.min(axis=1) > 0) & (depth + 1 < s.depth)
            own[t] = np.append(own[t], inner & (k.sum(axis=1) <= OWN))
            more = start + np.flatnonzero(inner & (k.sum(axis=1) > OWN))
            if len(more):
                large[t] = more
    return trees, depths, own


def histograms(rows: DataFrame, trees: list[Tree], large: dict[int, np.ndarray], s: Settings) -> DataFrame:
    """(tree, node, parts, f, cut, l0, l1, n0, n1): how each large node parts, by all tasks' histograms."""
    limit = HELD
    features = {t: np.concatenate([picks(s.rng(t, int(at)), 1, s) for at in nodes]) for t, nodes in large.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for t, h in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(h), pa.int32()), pa.array(large[t], pa.int32()), pa.array([one.tobytes() for one in h], pa.binary())], ["tree", "node", "h"])
            held.clear()

        for b in batches:
            key, y, x = contents(b, s)
            for t, nodes in large.items():
                number = np.full(len(trees[t].f), -1)
                number[nodes] = np.arange(len(nodes))
                n = draws(key, t, s)
                drawn = np.flatnonzero(n)
                node = number[walked(x[drawn], trees[t])]
                drawn, node = drawn[node >= 0], node[node >= 0]
                h = counted(x, y, n, drawn, node, features[t], s)
                held[t] = held[t] + h if t in held else h
                if sum(h.nbytes for h in held.values()) > limit:
                    yield from told()
        yield from told()

    def choose(table: pa.Table) -> pa.Table:
        t, node = table["tree"][0].as_py(), table["node"][0].as_py()
        h = sum(np.frombuffer(v.as_py()) for v in table["h"]).reshape(1, s.picked, s.bins, 2)
        j, cut, left, parts = parted(h, s)
        f = picks(s.rng(t, node), 1, s)[0, j[0]]
        return pa.Table.from_pylist([{"tree": t, "node": node, "parts": bool(parts[0]), "f": int(f), "cut": int(cut[0]), **{f"{a}{c}": int(v[c]) for a, v in (("l", left[0]), ("n", h[0, 0].sum(axis=0))) for c in (0, 1)}}], CHOSEN)

    return rows.mapInArrow(count, "tree int, node int, h binary").groupBy("tree", "node").applyInArrow(choose, "tree int, node int, parts boolean, f int, cut int, l0 long, l1 long, n0 long, n1 long")


CHOSEN = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("parts", pa.bool_()), ("f", pa.int32()), ("cut", pa.int32()), *((c, pa.int64()) for c in ("l0", "l1", "n0", "n1"))])


def contents(b: pa.RecordBatch, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = unpacked(b"".join(b.column("x").to_pylist()), b.num_rows, len(s.cuts), s.bits)
    return b.column("key").to_numpy(), b.column("y").to_numpy().astype(np.int64), x


def dealt(rows: DataFrame, trees: list[Tree], own: list[np.ndarray], s: Settings) -> DataFrame:
    """(tree, node, x, drawn): rows drawn into nodes that a task grows, packed together; `drawn` is twice the draws, and the class."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, y, x = contents(b, s)
            raw = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(len(x), -1)
            for t, tree in enumerate(trees):
                n = draws(key, t, s)
                drawn = np.flatnonzero(n)
                at = walked(x[drawn], tree)
                drawn, at = drawn[own[t][at]], at[own[t][at]]
                order = np.argsort(at, kind="stable")
                drawn, at = drawn[order], at[order]
                nodes, starts = np.unique(at, return_index=True)
                each = np.split(drawn, starts[1:]) if len(nodes) else []
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array([raw[d].tobytes() for d in each], pa.binary()), pa.array([(2 * n[d] + y[d]).astype(np.uint8).tobytes() for d in each], pa.binary())], ["tree", "node", "x", "drawn"])

    return rows.mapInArrow(deal, "tree int, node int, x binary, drawn binary")


GROWN = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("nodes", pa.int64()), ("leaf", pa.bool_()), ("one", pa.bool_()), *((c, pa.binary()) for c in ("f", "cut", "lo", "p"))])


def growing(depths: list[np.ndarray], s: Settings) -> Callable[[pa.Table], pa.Table]:
    def grow(table: pa.Table) -> pa.Table:
        t, node = table["tree"][0].as_py(), table["node"][0].as_py()
        drawn = np.frombuffer(b"".join(table["drawn"].to_pylist()), np.uint8).astype(np.int64)
        x = unpacked(b"".join(table["x"].to_pylist()), len(drawn), len(s.cuts), s.bits)
        tree = grown(x, drawn % 2, drawn // 2, int(depths[t][node]), s.rng(t, node, 1), s)
        kept = {"f": tree.f.astype(np.int32), "cut": tree.cut.astype(np.uint8), "lo": tree.lo.astype(np.int32), "p": shares(tree.n, s)}
        return pa.Table.from_pylist([{"tree": t, "node": node, "nodes": len(tree.f), "leaf": bool(tree.f[0] < 0), "one": bool(sided(tree.n, s)[0]), **{c: v.tobytes() for c, v in kept.items()}}], GROWN)

    return grow


def scores(train: DataFrame, rows: DataFrame, features: list[str], of: RandomForestClassifier, y: str = "y") -> DataFrame:
    """`rows` with `score`, the probability of class 1: the mean of the trees' leaves. Both classes weigh alike. Rows are drawn by a
    hash of all columns of `train`, so an id among them tells copies apart, and reruns agree."""
    s, n = settings(train, features, y, of)
    known = materialized(binned(train, features, s, key=(F.xxhash64(*train.columns), "long"), y=(F.col(y), "int")))
    trees, depths, own = tops(known, n, s)
    below = materialized(dealt(known, trees, own, s).groupBy("tree", "node").applyInArrow(growing(depths, s), "tree int, node int, nodes long, leaf boolean, one boolean, f binary, cut binary, lo binary, p binary"))
    nodes, voters = 0, sum(not o[0] for o in own)  # a tree of small tables may have no draws
    ends = [dict[int, bool]() for _ in trees]
    for r in below.select("tree", "node", "nodes", "leaf", "one").toLocalIterator():  # a row a node that a task grew
        nodes, voters = nodes + r["nodes"], voters + (r["node"] == 0)
        if r["leaf"]:
            ends[r["tree"]][r["node"]] = r["one"]
    for t, tree in enumerate(trees):  # leaves merge above as well; a child comes after its parent
        one = sided(tree.n, s)
        leaf = (tree.f < 0) & ~own[t]
        for at, side in ends[t].items():
            leaf[at], one[at] = True, side
        for at in range(len(tree.f) - 1, -1, -1):
            lo = tree.lo[at]
            if tree.f[at] >= 0 and leaf[lo] and leaf[lo + 1] and one[lo] == one[lo + 1]:
                tree.f[at], leaf[at] = -1, True
    whole = materialized(rows.withColumn("_row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(whole.count() / BLOCK))
    groups = min(s.trees, max(GROUPS, math.ceil(nodes / NODES)))
    met = binned(whole, features, s, _row=(F.col("_row"), "long")).select(F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "_row", "x")
    sent = below.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (F.col("tree") % groups).alias("part"), "tree", "node", "f", "cut", "lo", "p")

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x = unpacked(b"".join(left["x"].to_pylist()), left.num_rows, len(s.cuts), s.bits)
        total = np.zeros(len(x), np.int64)
        held = {(t, at): i for i, (t, at) in enumerate(zip(right["tree"].to_pylist(), right["node"].to_pylist()))}
        column = lambda i, c, kind: np.frombuffer(right[c][i].as_py(), kind)
        for t in range(key[1].as_py(), s.trees, groups):
            at = walked(x, trees[t])
            p = shares(trees[t].n, s)
            for node in np.unique(at):
                here = np.flatnonzero(at == node)
                if own[t][node]:
                    i = held.get((t, int(node)))
                    if i is None:
                        continue
                    sub = Tree(column(i, "f", np.int32), column(i, "cut", np.uint8), column(i, "lo", np.int32), np.empty(0))
                    total[here] += column(i, "p", np.int64)[walked(x[here], sub)]
                else:
                    total[here] += p[node]
        return pa.table({"_row": left["_row"], "_sum": total})

    by = lambda df: df.groupBy("block", "part")
    sums = by(met).cogroup(by(sent)).applyInArrow(score, "_row long, _sum long").groupBy("_row").agg((F.sum("_sum") / F.lit(float(ONE * max(1, voters)))).alias("score"))
    return whole.join(sums, "_row").drop("_row")
