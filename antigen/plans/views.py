"""Views over the driver tables that stand for flow records, scored rows and run rows, in Spark and (for the
checks) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.functions.metrics import confusion, with_metrics

FEATURES = ["quantity", "price", "discount", "tax", "linenumber", "unit_price", "net_price", "qty_discount", "ship_month", "suppkey", "partkey", "qty_tax"]
DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records: an id, the source, labels and twelve numeric features."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        (c("l_suppkey") % 8).alias("src"), "l_orderkey",
        (c("l_quantity") * c("l_discount") >= 2.0).cast("int").alias("y"),
        F.when(c("l_quantity") * c("l_discount") < 2.0, "normal").otherwise(F.concat("l_returnflag", F.lit("-"), "l_linestatus")).alias("label"),
        c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"), c("l_tax").alias("tax"),
        c("l_linenumber").cast("double").alias("linenumber"), (c("l_extendedprice") / c("l_quantity")).alias("unit_price"),
        (c("l_extendedprice") * (1 - c("l_discount"))).alias("net_price"), (c("l_quantity") * c("l_discount")).alias("qty_discount"),
        F.month("l_shipdate").cast("double").alias("ship_month"), c("l_suppkey").cast("double").alias("suppkey"), c("l_partkey").cast("double").alias("partkey"),
        (c("l_quantity") * c("l_tax")).alias("qty_tax"),
    )


FLOWS = """flows AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_suppkey % 8 AS src, l_orderkey,
  CAST(l_quantity * l_discount >= 2.0 AS INT) AS y, CASE WHEN l_quantity * l_discount < 2.0 THEN 'normal' ELSE l_returnflag || '-' || l_linestatus END AS label,
  l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CAST(l_linenumber AS DOUBLE) AS linenumber,
  l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) AS net_price, l_quantity * l_discount AS qty_discount,
  CAST(month(l_shipdate) AS DOUBLE) AS ship_month, CAST(l_suppkey AS DOUBLE) AS suppkey, CAST(l_partkey AS DOUBLE) AS partkey, l_quantity * l_tax AS qty_tax FROM lineitem)"""


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records as text with planted faults: missing values and labels, words, infinities, whole rows twice."""
    k = F.col("l_orderkey")
    f = flows(spark, sf_dir)
    text = f.select(
        "id", "src", "l_orderkey", F.lit(0).alias("copy"),
        F.when(k % 97 == 0, None).when(k % 89 == 0, "bad").when(k % 83 == 0, "Infinity").otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(k % 97 == 0, None).when(k % 79 == 0, "-Infinity").otherwise(F.col("tax").cast("string")).alias("tax"),
        F.when(k % 71 == 0, None).when(k % 73 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("label"), F.lit(". "))).alias("label"),
    )
    return text.union(text.where(k % 61 == 0).withColumn("copy", F.lit(1)))


DIRTY = """dirty0 AS (SELECT id, src, l_orderkey, 0 AS copy,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN 'bad' WHEN l_orderkey % 83 = 0 THEN 'Infinity' ELSE CAST(quantity AS VARCHAR) END AS quantity,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 79 = 0 THEN '-Infinity' ELSE CAST(tax AS VARCHAR) END AS tax,
  CASE WHEN l_orderkey % 71 = 0 THEN NULL WHEN l_orderkey % 73 = 0 THEN '  ' ELSE ' ' || upper(label) || '. ' END AS label FROM flows),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT id, src, l_orderkey, 1, quantity, tax, label FROM dirty0 WHERE l_orderkey % 61 = 0)"""


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors: id, class and all components."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") != 0).cast("int").alias("y"), F.col("label").alias("category"),
        *(F.element_at("embedding", i + 1).cast("double").alias(f"e{i:02d}") for i in range(DIMS)),
    )


EMB = "emb AS (SELECT vec_id, CAST(label <> 0 AS INT) AS y, label AS category, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i:02d}" for i in range(DIMS)) + " FROM embeddings)"


def scored(spark: SparkSession, sf_dir: str, rule: str = "l_discount >= 0.08") -> DataFrame:
    """Scored rows: a score of few values, the truth, a prediction by a rule, and the run that they belong to."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_returnflag").alias("dataset"), F.when(c("l_linestatus") == "F", "hamming").otherwise("weighted").alias("method"),
        F.when(c("l_linenumber") % 2 == 0, 10).otherwise(20).alias("k"), F.when(c("l_suppkey") % 2 == 0, 0.01).otherwise(0.05).alias("target"),
        (c("l_orderkey") % 20).alias("seed"), c("l_discount").alias("score"), (c("l_quantity") * c("l_discount") >= 2.0).cast("int").alias("y"),
        F.expr(rule).cast("int").alias("pred"), F.concat(F.lit("C"), (c("l_partkey") % 7).cast("string")).alias("category"), F.round(c("l_tax") * 100).cast("long").alias("cost"),
    )


SCORED = """scored AS (SELECT l_orderkey, l_linenumber, l_returnflag AS dataset, CASE WHEN l_linestatus = 'F' THEN 'hamming' ELSE 'weighted' END AS method,
  CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 20 END AS k, CAST(CASE WHEN l_suppkey % 2 = 0 THEN 0.01 ELSE 0.05 END AS DOUBLE) AS target, l_orderkey % 20 AS seed,
  l_discount AS score, CAST(l_quantity * l_discount >= 2.0 AS INT) AS y, CAST(l_discount >= 0.08 AS INT) AS pred, 'C' || (l_partkey % 7) AS category, CAST(round(l_tax * 100) AS BIGINT) AS cost FROM lineitem)"""

RUN_KEYS = ["dataset", "method", "k", "target", "seed"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows: counts and metrics of each dataset, method, size, target and seed, with a cost."""
    by = scored(spark, sf_dir).groupBy(*RUN_KEYS).agg(*confusion(), F.avg("cost").alias("cost"))
    return with_metrics(by)


METRICS = """CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / CAST(fp + tn AS DOUBLE) END AS fpr,
  CASE WHEN fn + tp = 0 THEN 0.0 ELSE fn / CAST(fn + tp AS DOUBLE) END AS fnr, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / CAST(tn + fp AS DOUBLE) END AS specificity"""
COUNTS = """CAST(count(*) FILTER (y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (y = 0 AND pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (y = 1 AND pred = 1) AS BIGINT) AS tp"""
#: A rule of another column, the plainest classifier to hold detectors against.
RULE = "l_quantity >= 30"


def rule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows of the rule: as `runs`, but no method tells them apart."""
    keys = [k for k in RUN_KEYS if k != "method"]
    return with_metrics(scored(spark, sf_dir, RULE).groupBy(*keys).agg(*confusion())).withColumn("method", F.lit("rule"))


RUNS = f"""{SCORED}, runs0 AS (SELECT dataset, method, k, target, seed, {COUNTS}, avg(cost) AS cost FROM scored GROUP BY ALL),
runs AS (SELECT *, {METRICS} FROM runs0)"""
RULE_RUNS = f"""ruled{SCORED.removeprefix('scored').replace('l_discount >= 0.08', RULE)},
rruns0 AS (SELECT dataset, 'rule' AS method, k, target, seed, {COUNTS} FROM ruled GROUP BY ALL), rruns AS (SELECT *, {METRICS} FROM rruns0)"""


def sql_wide_hash(seed: str, *ids: str) -> str:
    """The SQL twin of wide_hash."""
    return f"substr(md5(concat_ws('|', {seed}, {', '.join(ids)})), 1, 16)"


def sql_hash(seed: str, *ids: str) -> str:
    """The SQL twin of uniform_hash; the seed is an SQL expression of a text."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(ids)})), 1, 8) AS BIGINT)"
