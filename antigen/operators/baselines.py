"""Reference classifiers by MLlib, and an isolation forest grown from bounded subsamples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antigen.functions.hashing import uniform_hash
from antigen.operators import forest

#: Each row's node ids stay with the executors (cacheNodeIds), else the driver sends all trees, as far as grown, for each
#: group of nodes.
MODELS = {
    "lr": lambda seed, **k: LogisticRegression(maxIter=1000, **k),
    "dt": lambda seed, **k: DecisionTreeClassifier(maxDepth=20, minInstancesPerNode=2, seed=seed, cacheNodeIds=True, **k),
    "rf": lambda seed, **k: RandomForestClassifier(numTrees=200, maxDepth=20, seed=seed, cacheNodeIds=True, **k),
}
#: Models that draw nothing, so that one fit serves all seeds; and those that are fitted one at a time, as each fills the cluster.
UNSEEDED, LARGE = {"lr"}, {"rf"}
#: Rows that a tree of the isolation forest is grown from.
TREE_ROWS = 256


def class_weighted(df: DataFrame, y: str = "y") -> DataFrame:
    """Adds `weight`: rows / (2 * rows of the class), so that both classes count alike."""
    n = df.groupBy(y).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    return df.join(F.broadcast(n.crossJoin(total)), y).withColumn("weight", F.col("_all") / (2 * F.col("_n"))).drop("_n", "_all")  # a row a class


def scores(train: DataFrame, rows: DataFrame, features: list[str], model: str, y: str = "y", seed: int = 42) -> DataFrame:
    """Adds `score`, the probability of class 1. Forests take their parameters from MLlib, but its trees would all be gathered on
    the driver, so they are grown in the tasks."""
    if model in LARGE:
        return forest.scores(train, rows, features, MODELS[model](seed), y)
    assemble = VectorAssembler(inputCols=features, outputCol="_v").transform
    fitted = MODELS[model](seed, featuresCol="_v", labelCol=y, weightCol="weight").fit(assemble(class_weighted(train, y)))
    return fitted.transform(assemble(rows)).withColumn("score", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")


def _path_length(n: np.ndarray | float):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(train: DataFrame, rows: DataFrame, features: list[str], key: str, trees: int = 200, seed: int = 42) -> DataFrame:
    """(key, score): Liu, Ting and Zhou's isolation score, higher for rows that few cuts isolate. Each tree is grown in a task of
    its own from at most TREE_ROWS rows; all trees are a few thousand nodes."""
    # each tree samples its rows by a hash of its own; rows that no tree can take are left out first
    n = train.count()
    share = min(1.0, 1.2 * TREE_ROWS / max(1, n))
    some = min(1.0, 2 * share * trees)
    under = lambda s, p, *ids: uniform_hash(s, key, *ids) < p * 2.0**32
    dealt = train.where(under(seed, some)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(under(seed + 1, share / some, "tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf["tree"].iloc[0])])
        x = rng.permutation(pdf.sort_values(key)[features].to_numpy(float))[:TREE_ROWS]
        limit, nodes, stack = int(np.ceil(np.log2(max(2, len(x))))), [], [(np.arange(len(x)), 0, -1, False)]
        while stack:
            own, depth, parent, right = stack.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][3 if right else 2] = at
            spread = np.ptp(x[own], axis=0) if len(own) > 1 else np.zeros(x.shape[1])
            if depth >= limit or not spread.any():
                nodes.append([-1, 0.0, -1, -1, depth + float(_path_length(len(own)))])
                continue
            f = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(x[own, f].min(), x[own, f].max()))
            nodes.append([f, cut, -1, -1, 0.0])
            left = x[own, f] <= cut
            stack += [(own[left], depth + 1, at, False), (own[~left], depth + 1, at, True)]
        return pd.DataFrame([[int(pdf["tree"].iloc[0]), i, *n] for i, n in enumerate(nodes)], columns=["tree", "node", "f", "cut", "lo", "hi", "depth"])

    grown = dealt.groupBy("tree").applyInPandas(grow, "tree int, node int, f int, cut double, lo int, hi int, depth double").toPandas()  # trees times 2 * TREE_ROWS nodes
    norm = float(_path_length(max(2, min(TREE_ROWS, n))))
    # all trees in one set of arrays; a leaf leads to itself, so that rows of all trees step down together
    grown = grown.sort_values(["tree", "node"]).reset_index(drop=True)
    first = grown.groupby("tree")["node"].transform("size").index - grown["node"].to_numpy()
    leaf = grown["f"].to_numpy() < 0
    here = np.arange(len(grown))
    f = np.where(leaf, 0, grown["f"]).astype(np.int32)
    cut = np.where(leaf, np.inf, grown["cut"])
    lo, hi = (np.where(leaf, here, grown[c].to_numpy() + first).astype(np.int32) for c in ("lo", "hi"))
    child = np.stack([hi, lo], axis=1).ravel()  # a node's right child, then its left one
    depth, roots = grown["depth"].to_numpy(), here[grown["node"].to_numpy() == 0].astype(np.int32)
    deepest = int(np.ceil(np.log2(TREE_ROWS)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
                row, flat, total = (np.arange(len(x), dtype=np.int32) * x.shape[1])[:, None], x.ravel(), np.zeros(len(x))
                for first_tree in range(0, len(roots), 16):  # so few trees stay in the cache
                    at = np.tile(roots[first_tree : first_tree + 16], (len(x), 1))
                    for _ in range(deepest):
                        at = child.take(2 * at + (flat.take(row + f.take(at)) <= cut.take(at)))
                    total += depth.take(at).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(2 ** (-total / max(1, len(roots)) / norm))], [key, "score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *features).mapInArrow(score, f"`{key}` {kind}, score double")
