"""Operator 12, hard-negative mining by slot-decomposed selection.

Every anchor has a few positives, its nearest rows of the same label, and wants for each of them the nearest rows of other
labels whose score lies in a window: up to the positive's score, and down to a share of it. The windows of an anchor
overlap, so they are not searched one by one:

1. anchors meet the rows of their label in blocks; each block keeps its best few (a combiner), of which the best few of
   all are the positives;
2. the positives' scores, falling, are the upper limits of the windows. They cut all scores into disjoint slots: slot j
   lies under the j-th limit and above the next, and scores over the first limit are in none;
3. anchors meet all rows of other labels in blocks; a block puts each score into its slot and keeps the best few of each;
   the best few of each slot of all blocks are merged in a shuffle;
4. the window under the j-th limit holds slots j and below. These, merged from the highest on, are one falling list, of
   which each window takes its first few; the lower limit cuts them afterwards, as it only ends a falling list.

Scores are exact integers. A block of rows and a block of anchors meet in one task; a label of many rows, also one that holds
a third of them, is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.llm.ann import matrix, usable
from antigen.llm.common import Steps, join_counted, table
from antigen.llm.exact_topk import products

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative has this share of the positive's score at least, as parts and whole.
LEAST_PARTS, WHOLE = 80, 100
#: Rows and anchors that meet in one task, on the average, and anchors that are multiplied at a time.
ROWS, ANCHORS, AT_ONCE = 8192, 1024, 128

FOUND = "anchor_id long, slot int, vec_id long, score long"


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, with the components floor(scale * x)."""
    # doubles from 2^53 on are whole, and floor gives a long
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y).otherwise(F.raise_error(F.lit("a scaled component exceeds a double")).cast("double"))
    own = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[label_col].cast("long").alias("label"), rows[vector_col].cast("array<double>").alias("x"))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("x", zero=True)
    return own.select("vec_id", "label", F.when(takes_part, F.transform("x", lambda x: whole(x * scale))).alias("v")).where("v is not null")


def blocks(rows: DataFrame, anchors: DataFrame, keys: list[str], steps: Steps) -> DataFrame:
    """Rows and anchors (`asks`) side by side, each block of rows with each block of anchors of the same keys."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    both = count(rows, "n").join(count(anchors, "m"), keys)
    both = steps(both.withColumn("parts", F.ceil(F.col("n") / ROWS).cast("int")).withColumn("qparts", F.ceil(F.col("m") / ANCHORS).cast("int")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = join_counted(rows.withColumn("of", F.col("label")), both, keys).select(*keys, place("parts").alias("part"), every("qparts").alias("qpart"), F.lit(False).alias("asks"), "vec_id", "of", "v", F.lit(None).cast("array<long>").alias("limits"))
    right = join_counted(anchors.withColumn("of", F.col("label")), both, keys, "m").select(*keys, every("parts").alias("part"), place("qparts").alias("qpart"), F.lit(True).alias("asks"), "vec_id", "of", "v", "limits")
    return left.union(right)


def meeting(select: Callable) -> Callable[[pa.Table], pa.Table]:
    """A task's work: the exact scores of all its anchors and rows, of which `select` keeps some for each anchor."""

    def meet(t: pa.Table) -> pa.Table:
        asks, ids, labels = (t.column(c).to_numpy() for c in ("asks", "vec_id", "of"))
        out: list[tuple[int, int, int, int]] = []
        if asks.any() and not asks.all():
            x = matrix(t.column("v").combine_chunks())
            own = np.flatnonzero(~asks)
            row_ids, row_labels, row_x = ids[own], labels[own], x[own]
            every = np.flatnonzero(asks)
            limits = t.column("limits").take(pa.array(every)).to_pylist()
            for start in range(0, len(every), AT_ONCE):
                some = every[start : start + AT_ONCE]
                score = scores(row_x, x[some])
                for j, i in enumerate(some):
                    slots, best = select(int(ids[i]), int(labels[i]), limits[start + j], row_ids, row_labels, score[j])
                    out += [(int(ids[i]), s, int(row_ids[b]), int(score[j][b])) for s, b in zip(slots, best)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(FOUND.split(", "), columns, kinds)})

    return meet


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The exact inner products of each row of q with all rows of x."""
    reach = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if reach < 2**53:
        return (q @ x.T).astype(np.int64)
    return np.array([products(x, one) for one in q])


def first_of(ids: np.ndarray, score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Of the places `among`, those of the k highest scores, ties to smaller ids."""
    if len(among) > 8 * k:  # those under the k-th score can't be among the first
        among = among[score[among] >= np.partition(score[among], -k)[-k]]
    return among[np.lexsort((ids[among], ~score[among]))[:k]]  # the complement orders as the negative does, and no long overflows


def positives_of(k: int) -> Callable:
    def select(own: int, label: int, limits: None, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> tuple[list[int], list[int]]:
        best = first_of(ids, score, np.flatnonzero((ids != own) & (labels == label)), k)
        return [0] * len(best), best.tolist()

    return select


def by_slot(k: int) -> Callable:
    def select(own: int, label: int, limits: list[int], ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> tuple[list[int], list[int]]:
        """limits: the distinct upper limits, falling, behind the least score that any window takes."""
        least, *upper = limits
        slots: list[int] = []
        best: list[int] = []
        near = np.flatnonzero((labels != label) & (score <= upper[0]) & (score >= least) & (ids != own))
        slot = np.searchsorted(-np.array(upper), -score[near], side="right") - 1  # the last limit that is not below the score
        for s in range(len(upper)):
            few = first_of(ids, score, near[slot == s], k)
            slots += [s] * len(few)
            best += few.tolist()
        return slots, best

    return select


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The k first of each anchor and slot, with their place; Spark keeps k of each in a task before the shuffle."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_parts: int = LEAST_PARTS, scale: int = SCALE,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives,
    the first rows of other labels whose score is at most the positive's and at least `least_parts` hundredths of it.

    Scores are inner products of the vectors of floor(scale * x); higher come first, ties by the smaller id. Rows with a null
    id or label, or with a vector that is null, empty or holds a null, NaN or infinite component, take no part; zero vectors
    do. Rows of another length than an anchor's are none of its partners. Rows that repeat an id are one row, the one of
    the least label and vector; so are anchors. A positive score under 0 leaves no window, one of 0 takes negatives of 0
    alone; an anchor without positives or negatives gives no rows. A score beyond a long is an error. Empty tables give no
    rows; other columns are not read, so their names cannot clash."""
    steps = Steps(rows.sparkSession)

    def once(df: DataFrame) -> DataFrame:
        own = whole_vectors(df, id_col, label_col, vector_col, scale)
        if not own.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            own = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("of")).select("vec_id", "of.label", "of.v")
        return own.withColumn("dim", F.size("v"))

    own, asked = steps(once(rows)), steps(once(anchors))
    none = F.lit(None).cast("array<long>").alias("limits")
    met = blocks(own, asked.select("*", none), ["dim", "label"], steps).groupBy("dim", "label", "part", "qpart").applyInArrow(meeting(positives_of(positives)), FOUND)
    chosen = steps(firsts(met, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # limits: the least score that a window can take, then the distinct scores of the positives, falling; under 0 there's no window
    upper = F.sort_array(F.collect_set("positive_score"), asc=False)  # `positives` scores
    least = F.floor((F.element_at("upper", -1).cast("decimal(20)") * least_parts) / WHOLE).cast("long")
    limits = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(upper.alias("upper")).select("anchor_id", F.concat(F.array(least), "upper").alias("limits"))
    limits = steps(limits)
    wanted = asked.join(limits, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "dim", "limits")
    met = blocks(own, wanted, ["dim"], steps).groupBy("dim", "part", "qpart").applyInArrow(meeting(by_slot(negatives)), FOUND)
    # slots from the highest on: one list that falls by score, and rises by id among ties, as slots are disjoint
    falling = F.array_sort(F.collect_list(F.struct("slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))))  # `positives` times `negatives` items
    merged = firsts(met, negatives).groupBy("anchor_id").agg(falling.alias("falling"))
    both = chosen.where("positive_score >= 0").join(limits, "anchor_id").join(merged, "anchor_id")
    slot = F.array_position(F.slice("limits", 2, positives), F.col("positive_score")) - 1
    window = F.slice(F.filter("falling", lambda n: n["slot"] >= slot), 1, negatives)
    out = both.select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "n"))
    enough = (F.col("n.negative_score").cast("decimal(20)") * WHOLE) >= (F.col("positive_score").cast("decimal(20)") * least_parts)
    return out.where(enough).select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "n.negative_id", "positive_score", "n.negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", turned)
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
