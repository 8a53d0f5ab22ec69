"""Statistics over run rows: intervals, paired tests, multiple-test correction, selection of configurations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.functions.special import clopper_pearson, t_quantile, wilcoxon_p


#: Distinct counts of runs, of successes in runs or of pairs that a table of quantiles may have: a row each.
MOST_COUNTS = 100_000


def looked_up(df: DataFrame, keys: list[str], columns: list[str], value: Callable) -> DataFrame:
    """Adds `columns`, what `value` gives for the keys, which are counts: the distinct ones are computed once on the driver
    and joined. More than MOST_COUNTS are an error."""
    known = df.select(*keys).distinct().limit(MOST_COUNTS + 1).collect()
    if len(known) > MOST_COUNTS:
        raise ValueError(f"more than {MOST_COUNTS} distinct counts")
    rows = [(*r, *value(*r)) for r in known if None not in tuple(r)]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys) + "".join(f", {c} double" for c in columns)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), keys, "left").select(*df.columns, *columns)  # MOST_COUNTS rows


def interval(df: DataFrame, by: list[str], metric: str, confidence: float = 0.95) -> DataFrame:
    """n, mean, std (sample) and Student interval of each group; one value has std 0 and its own interval, none has nulls."""
    x = F.when(F.col(metric).isNotNull() & (F.abs(metric) < float("inf")), F.col(metric))
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.when(F.count(x) == 1, 0.0)).alias("std"))
    g = looked_up(g, ["n"], ["t"], lambda n: (t_quantile((1 + confidence) / 2, n - 1) if n > 1 else 0.0,))
    half = F.col("t") * F.col("std") / F.sqrt("n")
    return g.select(*by, "n", "mean", "std", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def repeated_runs(df: DataFrame, by: list[str], metrics: list[str], seed: str = "seed", confidence: float = 0.95) -> DataFrame:
    """(by, metric, runs, seeds, n, mean, std, low, high) of each group and metric; seeds are joined as a text, the least first. Null keys
    are groups of their own."""
    long = df.unpivot([*by, seed], metrics, "metric", "value")
    keys = [*by, "metric"]
    # nulls of the keys have to meet
    named = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    stat = interval(long.withColumn("_k", named), ["_k"], "value", confidence)
    runs = long.withColumn("_k", named).groupBy("_k", *keys).agg(F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set(seed)).cast("array<string>"), "|").alias("seeds"))
    return runs.join(stat, "_k").drop("_k")


def performance_summary(approaches: dict[str, tuple[DataFrame, str]], by: list[str], metrics: list[str], seed: str = "seed", confidence: float = 0.95) -> DataFrame:
    """(approach, procedure, by, metric, runs, seeds, n, mean, std, low, high): run tables of several approaches summarised
    over their seeds, one below the other. An approach is a table and the column that names its procedures; a metric that a
    table lacks has no rows there, and an empty table gives none. Keys that are null form groups of their own."""
    parts = []
    for approach, (df, procedure) in approaches.items():
        own = df.withColumn("procedure", F.col(procedure)).select(F.lit(approach).alias("approach"), "procedure", *by, seed, *(m for m in metrics if m in df.columns))
        parts.append(repeated_runs(own, ["approach", "procedure", *by], [m for m in metrics if m in df.columns], seed, confidence))
    return reduce(DataFrame.unionByName, parts)


def summary(df: DataFrame, by: list[str], metrics: list[str], population: bool = False) -> DataFrame:
    """Runs, seeds and the mean and deviation of each metric."""
    std = F.stddev_pop if population else F.stddev_samp
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (std, "std"))]
    return df.groupBy(*by).agg(F.count("*").alias("runs"), F.count_distinct("seed").alias("seeds"), *aggs)


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_at = 1").drop("_at")


def within_limit_or_all(df: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """Rows that keep the limit, or the whole group if none does; `rule` tells which."""
    any_ok = F.max(F.when(ok, 1).otherwise(0)).over(Window.partitionBy(*by))
    return df.withColumn("_any", any_ok).where(ok | (F.col("_any") == 0)).withColumn("rule", F.when(F.col("_any") == 1, "within limit").otherwise("fallback")).drop("_any")


def paired(df: DataFrame, keys: list[str], of: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """One row for each key that both a and b have, with both values of each metric. A repeated key is an error."""
    own = df.where(F.col(of).isin(a, b)).groupBy(*keys, of).agg(*(F.max(m).alias(m) for m in metrics), F.count("*").alias("_n"))
    own = own.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a run key is repeated"))).otherwise(F.col("_n")))
    side = lambda v: own.where((F.col(of) == v) & (F.col("_n") == 1)).select(*keys, *(F.col(m).alias(f"{m}_{v}") for m in metrics))
    return side(a).join(side(b), keys)


def paired_differences(df: DataFrame, by: list[str], directions: dict[str, int], a: str, b: str, tie: float = 1e-12) -> DataFrame:
    """For each group and metric of `paired` rows: pairs, both means, mean and median difference, and wins, ties and losses of
    a; a direction of -1 means that less is better."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(s).alias("s"), F.col(f"{m}_{a}").alias("x"), F.col(f"{m}_{b}").alias("y")) for m, s in directions.items()))
    long = df.select(*by, F.explode(each).alias("v")).select(*by, "v.*").withColumn("d", F.col("x") - F.col("y"))
    gain = F.col("d") * F.col("s")
    return long.groupBy(*by, "metric").agg(
        F.when(F.max("s") < 0, "lower").otherwise("higher").alias("better"), F.count("d").alias("pairs"), F.avg("x").alias(f"mean_{a}"), F.avg("y").alias(f"mean_{b}"), F.avg("d").alias("mean_diff"), F.median("d").alias("median_diff"),
        F.count_if(gain > tie).alias("wins"), F.count_if(F.abs(gain) <= tie).alias("ties"), F.count_if(gain < -tie).alias("losses"),
    )


def first_runs(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n run specs by a full order, with their `place` from 1."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def check(df: DataFrame, name: str, value: Column, ok: Callable[[Column], Column]) -> DataFrame:
    """(check, passed, evidence): one aggregate of a table and whether it is as it should be."""
    return df.agg(value.alias("v")).select(F.lit(name).alias("check"), ok(F.col("v")).alias("passed"), F.col("v").cast("string").alias("evidence"))


def none_of(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """A check that no row is bad."""
    return check(df, name, F.count_if(bad), lambda n: n == 0)


def signed_ranks(df: DataFrame, by: list[str], d: str = "diff", zero: float = 1e-8) -> DataFrame:
    """n, W+, W-, rank-biserial effect, z (tie-corrected) and the ties' sum of t^3 - t over each tie: differences of about zero
    are dropped; without any, the statistic is 0 and z is missing."""
    x = df.where(F.abs(d) > zero).select(*by, d, F.round(F.abs(d), 12).alias("_a"))
    w = Window.partitionBy(*by)
    n_tie = F.count("*").over(Window.partitionBy(*by, "_a"))
    x = x.withColumn("_r", F.rank().over(w.orderBy("_a")) + (n_tie - 1) / 2).withColumn("_t", n_tie)
    g = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(d) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("_t").cast("double") * F.col("_t") - 1).alias("ties"),
    )
    out = df.select(*by).distinct().join(g, by, "left").na.fill(0)
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(F.col("n") > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / sd)
    total = F.col("w_plus") + F.col("w_minus")
    return out.select(*by, "n", "w_plus", "w_minus", F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(0.0).alias("effect"), z.alias("z"), F.col("ties").cast("double").alias("ties"))


#: Up to so many differences without ties the p of the signed ranks is exact.
EXACT_PAIRS = 50


def with_signed_p(df: DataFrame) -> DataFrame:
    """Adds `p` to the rows of `signed_ranks`: exact for up to EXACT_PAIRS differences without ties, else the two-sided normal
    one of z; 1 where no difference is left."""
    least = F.least("w_plus", "w_minus")
    exact = (F.col("n") > 0) & (F.col("n") <= EXACT_PAIRS) & (F.col("ties") == 0)
    keyed = df.withColumn("_w", F.when(exact, least)).withColumn("_n", F.when(exact, F.col("n")))
    keyed = looked_up(keyed, ["_w", "_n"], ["_exact"], lambda w, n: (wilcoxon_p(w, n),))
    normal = looked_up(keyed.withColumn("_z", F.when(~exact, F.col("z"))), ["_z"], ["_normal"], lambda z: (min(1.0, math.erfc(abs(z) / math.sqrt(2))),))
    return normal.withColumn("p", F.coalesce("_exact", "_normal", F.lit(1.0))).drop("_w", "_n", "_z", "_exact", "_normal")


def holm(df: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Adds Holm's step-down p, at most 1; missing ones don't count."""
    some = F.col(p).isNotNull()
    w = Window.partitionBy(*family, some)
    order = w.orderBy(p)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(w) - F.row_number().over(order) + 1))
    return df.withColumn("_s", step).withColumn("p_holm", F.when(some, F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def holm_with_subfamily(df: DataFrame, member: Column, p: str = "p") -> DataFrame:
    """Adds `p_holm` over all tests, and `p_holm_sub` over those of the sub-family alone, null elsewhere."""
    sub = holm(df.withColumn("_sub", F.when(member, F.col(p))), [], "_sub").withColumnRenamed("p_holm", "p_holm_sub").drop("_sub")
    return holm(sub, [], p)


_WORD = np.uint64(0xFFFFFFFF)


def counter_draws(seed: int, n: int, replicates: int) -> np.ndarray:
    """For each replicate n places under n: 32-bit hashes of a counter, which any engine can repeat (two rounds of shift,
    exclusive-or and multiplication)."""
    x = (np.uint64(seed) * np.uint64(2654435761) + np.arange(replicates * n, dtype=np.uint64)) & _WORD
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & _WORD
    return (((x >> np.uint64(16)) ^ x) % np.uint64(n)).astype(np.int64).reshape(replicates, n)


def bootstrap(df: DataFrame, by: list[str], d: str, replicates: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean of each group's differences; all alike give the point, none gives
    nulls. A group's seed is `seed` plus its place, from 0, in the order of `by`, so groups draw from streams of their own.
    Differences are run rows, few for each group; each task draws for its groups, as vectors."""
    groups = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.abs(d) < float("inf"), F.col(d)))).alias("v"))
    groups = groups.withColumn("_at", F.row_number().over(Window.orderBy(*by)) - 1)  # a row a group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values, at in zip(batch.column("v").to_pylist(), batch.column("_at").to_pylist()):
                v = np.array(values, float)
                if not len(v) or np.allclose(v, v[0]):
                    out.append([float(v.mean())] * 3 if len(v) else [None] * 3)
                    continue
                means = v[counter_draws(seed + at, len(v), replicates)].mean(axis=1)
                out.append([float(v.mean()), *map(float, np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2]))])
            keys = [batch.column(c) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.float64()) for c in zip(*out))], [*by, "mean", "low", "high"])

    kinds = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in by)
    return groups.select(*by, "v", "_at").mapInArrow(run, f"{kinds}, mean double, low double, high double")


def binomial_interval(df: DataFrame, x: str = "met", n: str = "runs", confidence: float = 0.95) -> DataFrame:
    """Adds the exact (Clopper-Pearson) interval of x successes in n. Each distinct pair is computed once."""
    return looked_up(df, [x, n], ["low", "high"], lambda a, b: clopper_pearson(a, b, confidence))


def reliability(df: DataFrame, target: str, validation: str, test: str) -> DataFrame:
    """Adds the absolute errors of both rates to the target, their drift, and whether the test rate keeps it."""
    error = lambda c: F.abs(F.col(c) - F.col(target))
    return df.select(
        "*", error(validation).alias("validation_error"), error(test).alias("test_error"), (F.col(test) - F.col(validation)).alias("drift"),
        (F.col(test) <= F.col(target) + 1e-12).alias("met"),
    )


def locked(df: DataFrame, by: list[str], order: list[Column], limit: Column) -> DataFrame:
    """The first configuration of each group among those that keep the limit; a group where none does is an error."""
    out = first_by(within_limit_or_all(df, by, limit), by, order)
    checked = F.when(F.col("rule") == "fallback", F.raise_error(F.lit("no configuration keeps the limit"))).otherwise(F.lit(True))
    return out.where(checked).drop("rule")


def compatible(df: DataFrame, reference: DataFrame, keys: list[str], hashes: list[str]) -> DataFrame:
    """Rows whose partition and feature hashes are those of the reference's rows of the same keys."""
    return df.join(reference.select(*keys, *hashes).distinct(), [*keys, *hashes], "left_semi")
