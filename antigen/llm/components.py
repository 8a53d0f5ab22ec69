"""Connected components by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antigen.llm.common import Steps, join_counted


def _star(edges: DataFrame, small: bool, steps: Steps) -> DataFrame:
    """Points each larger (large-star) or smaller (small-star) neighbour of a node at the least id around the node. A node
    of very many neighbours is no single task's work: partial aggregates find its least id, which is then broadcast."""
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small-star: edges run from the larger end `a` to the smaller end `b`
    least = steps(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    moved = join_counted(both, least, "a")
    if small:
        moved = moved.select(F.col("b").alias("u"), "m").union(least.select(F.col("a").alias("u"), "m"))
    else:
        moved = moved.where("b > a").select(F.col("b").alias("u"), "m")
    return steps(moved.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for each id in `edges` (a, b) the smallest id that it reaches. Loops and repeats are ignored."""
    steps = Steps(edges.sparkSession)
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = steps(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(most_rounds):
        large = _star(now, False, steps)
        # stars already: nothing moves, and no node points at two
        if state(large) == state(now) and now.groupBy("a").count().where("count > 1").isEmpty():
            break
        now = _star(large, True, steps)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
