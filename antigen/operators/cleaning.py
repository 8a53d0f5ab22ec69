"""Cleaning of flow records, with counters of what was wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antigen.functions.labels import normalize_simple


def coerced(raw: str) -> Column:
    """A text as a finite double, or null."""
    x = F.expr(f"try_cast(trim(`{raw}`) AS DOUBLE)")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def was_not_number(raw: str) -> Column:
    return F.col(raw).isNotNull() & (F.trim(raw) != "") & F.expr(f"try_cast(trim(`{raw}`) AS DOUBLE)").isNull()


def was_infinite(raw: str) -> Column:
    return F.coalesce(F.abs(F.expr(f"try_cast(trim(`{raw}`) AS DOUBLE)")) == float("inf"), F.lit(False))


def no_label(label: str) -> Column:
    return F.col(label).isNull() | (F.trim(label) == "")


def clean(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with a label and any feature, features as finite doubles or null, the label normalised."""
    rows = df.where(~no_label(label)).withColumns({f: coerced(f) for f in features})
    return rows.where(F.coalesce(*features).isNotNull()).withColumn(label, normalize_simple(label))


def quality_report(df: DataFrame, features: list[str], label: str, source: str, order: list[str] | None = None) -> DataFrame:
    """Counters for each source and, under ALL_SOURCES, for all: one pass with a rollup. With an `order` also how many of the
    kept rows repeat all features and the label of an earlier one, and how many remain."""
    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    bad, inf = F.lit(0), F.lit(0)
    for f in features:
        bad = bad + F.when(was_not_number(f), 1).otherwise(0)
        inf = inf + F.when(was_infinite(f), 1).otherwise(0)
    empty = F.coalesce(*(coerced(f) for f in features)).isNull()
    labelled = ~no_label(label)
    out = df.rollup(F.col(source).cast("string").alias(source)).agg(
        F.count("*").cast("long").alias("rows_read"), n(no_label(label)).alias("no_label"),
        F.sum(F.when(labelled, bad).otherwise(0)).cast("long").alias("not_numbers"), F.sum(F.when(labelled, inf).otherwise(0)).cast("long").alias("not_finite"),
        n(labelled & empty).alias("no_feature"), n(labelled & ~empty).alias("kept"),
    ).withColumn(source, F.coalesce(source, F.lit("ALL_SOURCES")))
    if order is None:
        return out
    # a copy counts for the source of its own row; the first rows are those that remain
    firsts = clean(df, features, label).groupBy(*features, label).agg(F.min(F.struct(*order)).alias("f"))
    remain = firsts.rollup(F.col(f"f.{source}").cast("string").alias("of")).agg(F.count("*").cast("long").alias("remaining"))
    out = out.join(remain.withColumn("of", F.coalesce("of", F.lit("ALL_SOURCES"))), F.col(source) == F.col("of"), "left").drop("of")
    return out.withColumn("remaining", F.coalesce("remaining", F.lit(0).cast("long"))).withColumn("copies", F.col("kept") - F.col("remaining"))


def first_of_copies(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`: an aggregate, which keeps one row a key and task before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = F.min(F.struct(*order, F.struct(*rest).alias("rest")) if rest else F.struct(*order)).alias("first")
    out = df.groupBy(*key).agg(first)
    place = lambda c: F.col(c) if c in key and c not in order else F.col(f"first.{c}") if c in order else F.col(f"first.rest.{c}")
    return out.select(*(place(c).alias(c) for c in df.columns))


def predictors(df: DataFrame, keep: list[str] = (), helpers: list[str] = ("label", "difficulty"), leaky: list[str] = ()) -> DataFrame:
    """Drops label and helper columns, all that begin with two underscores, and named predictors that would leak; `keep`
    stays."""
    gone = {*helpers, *leaky, *(c for c in df.columns if c.startswith("__"))} - set(keep)
    return df.select(*(c for c in df.columns if c not in gone))


def table_diff(a: DataFrame, b: DataFrame, position: list[str], fields: list[str]) -> DataFrame:
    """(field, a, b, n): pairs of values that differ between rows of one position in two tables, and how often. Positions are
    unique; a row that one table lacks differs in every field."""
    left, right = (x.select(*position, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(n)) for x, n in ((a, "_a"), (b, "_b")))
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").alias("a"), F.col(f"_b.{f}").alias("b")) for f in fields))
    both = left.join(right, position, "full").select(F.explode(values).alias("v")).select("v.*")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("field", "a", "b").agg(F.count("*").alias("n"))
