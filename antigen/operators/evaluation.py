"""Threshold calibration, ROC and precision-recall areas, category analysis: tie groups first, so that the ordered work is
on distinct scores rather than on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def score_groups(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by, score, neg, pos): rows of each class at each distinct score."""
    return df.groupBy(*by, score).agg(F.sum(1 - F.col(y)).cast("long").alias("neg"), F.sum(y).cast("long").alias("pos"))


def in_ranges(groups: DataFrame, by: list[str], x: str, parts: int = 64) -> DataFrame:
    """Adds `_range`: values fall into ranges between approximate quantiles of their group; equal ones into the same."""
    cuts = F.percentile_approx(x, F.array(*(F.lit(i / parts) for i in range(1, parts))), 1000).alias("_cuts")
    edges = groups.groupBy(*by).agg(cuts)
    return (groups.join(edges, by) if by else groups.crossJoin(edges)).withColumn("_range", F.size(F.filter("_cuts", lambda e: e < F.col(x)))).drop("_cuts")


def cumulated(groups: DataFrame, by: list[str], x: str, sums: list[str], rising: bool = True, parts: int = 64) -> DataFrame:
    """Adds `upto_<c>` for each c of `sums`: its sum over the rows of the group with no larger x (no smaller, if falling).
    The totals of ranges give where each begins, so that no task orders a whole group; x is distinct in a group."""
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    way = lambda c: F.col(c).asc() if rising else F.col(c).desc()
    ranged = in_ranges(groups, by, x, parts)
    totals = ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = own.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    within = Window.partitionBy(*by, "_range").orderBy(way(x)).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(totals, [*by, "_range"])
    return joined.select(*groups.columns, *((F.col(f"_{c}") + F.sum(c).over(within)).alias(f"upto_{c}") for c in sums))


def least_step(groups: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, least_step): the smallest difference of adjacent values of x, which is distinct in a group; null for one value.
    Steps are taken within ranges, and from the last value of the range before to a range's first."""
    ranged = in_ranges(groups.select(*by, x), by, x)
    within = F.col(x) - F.lag(x).over(Window.partitionBy(*by, "_range").orderBy(x))
    inner = ranged.select(*by, "_range", x, within.alias("_step")).groupBy(*by, "_range").agg(F.min("_step").alias("_step"), F.min(x).alias("_first"), F.max(x).alias("_last"))
    carried = F.col("_first") - F.lag("_last").over(Window.partitionBy(*by).orderBy("_range"))  # a row a range
    return inner.select(*by, F.least("_step", carried).alias("_step")).groupBy(*by).agg(F.min("_step").alias("least_step"))


def calibrate(df: DataFrame, by: list[str], targets: list[float], distance: bool, score: str = "score", y: str = "y") -> DataFrame:
    """For each group and target the most permissive score at which the benign rows flagged (inclusive, ties whole) are at
    most floor(target * benign + 1e-12); `strict` marks that no score will do and the threshold lies just beyond the extreme.
    A group without finite benign scores is degenerate and has threshold 0 (distance) or 1 (similarity); infinite scores
    that such a threshold flags count."""
    groups = score_groups(df.where(F.col(y) == 0), by, score, y)
    finite = groups.where(F.abs(score) < float("inf"))
    always = F.sum(F.when(F.col(score) == float("-inf" if distance else "inf"), F.col("neg")).otherwise(0))
    all_benign = groups.groupBy(*by).agg(F.sum("neg").alias("benign"), always.alias("always"))
    run = all_benign.join(cumulated(finite, by, score, ["neg"], distance), by, "left").withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    allowed = F.floor(F.col("target") * F.col("benign") + 1e-12)
    fits = F.col("upto_neg") <= allowed
    best = (F.max if distance else F.min)(F.when(fits, F.col(score))).alias("best")
    extreme = (F.min(score) if distance else F.max(score)).alias("extreme")
    out = run.groupBy(*by, "target").agg(best, extreme, F.max("benign").alias("benign"), F.max("always").alias("always"), F.coalesce(F.max(F.when(fits, F.col("upto_neg"))), F.lit(0)).alias("flagged"), F.count(score).alias("n"))
    none = F.col("n") == 0
    flagged = F.when(none, F.col("always")).otherwise(F.col("flagged")).cast("long")
    return out.select(
        *by, "target", F.coalesce("best", "extreme", F.lit(0.0 if distance else 1.0)).alias("threshold"), (F.col("best").isNull() & ~none).alias("strict"),
        F.col("benign").cast("long"), flagged.alias("flagged"), (flagged / F.col("benign")).alias("achieved"), (F.col("n") <= 1).alias("degenerate"),
    )


def attack_oriented(score: str, distance: bool) -> F.Column:
    """The score with its sign so that larger means attack."""
    return -F.col(score) if distance else F.col(score)


def predict(score: str, threshold: str, distance: bool) -> F.Column:
    hit = F.col(score) <= F.col(threshold) if distance else F.col(score) >= F.col(threshold)
    return F.coalesce(hit, F.lit(False)).cast("int")


def roc_auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Tie-aware area under the ROC curve; null if a class is missing. Infinite scores stand one beyond the finite ones."""
    run = cumulated(score_groups(df.where(F.col(score).isNotNull()), by, score, y), by, score, ["neg"])
    below = F.col("upto_neg") - F.col("neg") / 2
    total = run.groupBy(*by).agg(F.sum(F.col("pos") * below).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """The sum over distinct scores, falling, of precision times the step in recall."""
    run = cumulated(score_groups(df.where(F.col(score).isNotNull()), by, score, y), by, score, ["pos", "neg"], rising=False)
    tp, fp = F.col("upto_pos"), F.col("upto_neg")
    out = run.groupBy(*by).agg(F.sum(F.col("pos") * tp / (tp + fp)).alias("s"), F.sum("pos").alias("p"))
    return out.select(*by, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"))


def category_analysis(df: DataFrame, by: list[str], category: str = "category") -> DataFrame:
    """Totals and detections of each category; for rows of class 0 the predicted ones are false alarms."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    y, p = F.col("y"), F.col("pred")
    out = df.groupBy(*by, category).agg(F.count("*").cast("long").alias("total"), n(p == 1).alias("predicted"), n((y == 1) & (p == 1)).alias("detected"), n((y == 1) & (p == 0)).alias("missed"), n(y == 1).alias("attacks"), n((y == 0) & (p == 1)).alias("false_alarms"))
    return out.withColumn("recall", F.when(F.col("attacks") > 0, F.col("detected") / F.col("attacks")))


def score_diagnostics(df: DataFrame, by: list[str], threshold: float, score: str = "score", y: str = "y") -> DataFrame:
    """Distinct finite scores, others, the largest tie, the smallest step between scores, and the rows and benign rows whose
    score is the threshold."""
    groups = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 0).alias("benign"))
    finite = F.col(score).isNotNull() & (F.abs(score) < float("inf"))
    at = lambda c: F.sum(F.when(F.col(score) == threshold, F.col(c)).otherwise(0)).cast("long")
    out = groups.groupBy(*by).agg(
        F.count_if(finite).cast("long").alias("distinct_scores"), F.sum(F.when(finite, 0).otherwise(F.col("n"))).cast("long").alias("not_finite"), F.max("n").cast("long").alias("largest_tie"),
        at("n").alias("at_threshold"), at("benign").alias("benign_at_threshold"),
    )
    return out.join(least_step(groups.where(finite), by, score), by, "left")
