"""Binary metrics from confusion counts; every undefined ratio is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds the rates of tn, fp, fn and tp."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.select(
        "*",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"),
        specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"),
        F.when(root == 0, 0.0).otherwise((tp * tn - fp * fn) / root).alias("mcc"),
    )


def confusion(y: str = "y", pred: str = "pred") -> list[Column]:
    hit = lambda a, b: F.sum(F.when((F.col(y) == a) & (F.col(pred) == b), 1).otherwise(0)).cast("long")
    return [hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp")]
