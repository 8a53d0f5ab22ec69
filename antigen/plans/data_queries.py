"""Queries of reading, cleaning, sampling, splitting and feature work, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.functions import labels as L
from antigen.functions.hashing import mixed, uniform_hash, wide_hash
from antigen.operators import cleaning, sampling
from antigen.operators import features as X
from antigen.plans import views as V
from antigen.sources import files
from antigen.sources.steps import materialized, scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- reading -------------------------------------------------------------------------------------------------------


@query("scan_ragged", """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS flag, o_orderpriority AS label, CAST(NULL AS VARCHAR) AS difficulty FROM orders""")
def scan_ragged(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").write.csv(path, sep="\t")
    return files.read_positional(spark, path, ["id", "flag", "label", "difficulty"], "difficulty")


@query("scan_files", f"""WITH {V.FLOWS} SELECT 's=' || src AS folder, CAST(count(*) AS BIGINT) AS n, round(sum(quantity), 6) AS quantity, round(sum(CASE WHEN src % 3 = 1 THEN tax END), 6) AS tax, CAST(count(*) FILTER (y = 1) AS BIGINT) AS attacks, CAST(count(*) - 1 AS BIGINT) AS last_row, CAST(count(*) AS BIGINT) AS places FROM flows GROUP BY 1""")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of three headers: one plain, one with its columns swapped and one more, one with a mark and blanks in it."""
    path = scratch(spark)
    f = V.flows(spark, d).withColumn("s", F.col("src"))
    quantity = F.col("quantity").alias(" Flow  Quantity ")
    kinds = [["id", quantity, "y"], ["y", F.col("tax").alias("Tax"), quantity, "id"], [F.col("id").alias("\ufeffid"), F.col("quantity").alias("Flow Quantity"), F.col("y").alias(" y ")]]
    # a source is one file, written as its rows come: a table parted by source would be sorted in the task of each first
    for r in sorted(f.where("s IS NOT NULL").select("s").distinct().collect()):  # sources
        f.where(F.col("s") == r["s"]).select(*kinds[r["s"] % 3]).repartition(1).write.csv(f"{path}/s={r['s']}", header=True)
    df = files.read_flow_files(spark, path).withColumn("folder", F.regexp_extract("source_file", r"(s=\d+)/[^/]+$", 1))
    total = lambda c: F.round(F.sum(F.col(c).cast("double")), 6)
    return df.groupBy("folder").agg(
        F.count("*").alias("n"), total("Flow Quantity").alias("quantity"), total("Tax").alias("tax"), F.count_if(F.col("y") == "1").alias("attacks"), F.max("source_row").alias("last_row"), F.count_distinct("source_row").alias("places"),
    )


@query("bounded_scan", f"WITH {V.FLOWS} SELECT src, id, y, n <= 800 AS scan_complete FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY id) AS pos, count(*) OVER (PARTITION BY src) AS n FROM flows) WHERE pos <= 800")
def bounded_scan(spark: SparkSession, d: str) -> DataFrame:
    return files.bounded(V.flows(spark, d), "src", ["id"], 800).select("src", "id", "y", "scan_complete")


@query("journal_read", "SELECT event_id, user_id, event_type FROM events")
def journal_read(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    rows = V.table(spark, d, "events").select("event_id", "user_id", "event_type")
    files.append_journal(rows.where("event_id % 2 = 0"), path)
    files.append_journal(rows.where("event_id % 2 <> 0"), path)
    return files.read_journal(spark, path, "event_id long, user_id long, event_type string")


@query("union_results", f"WITH {V.RUNS} SELECT dataset, method, k, seed, f1, CAST(NULL AS DOUBLE) AS cost FROM runs WHERE dataset = 'A' UNION ALL SELECT dataset, method, k, seed, NULL, cost FROM runs WHERE dataset = 'N'")
def union_results(spark: SparkSession, d: str) -> DataFrame:
    r = V.runs(spark, d)
    return files.union_tables(r.where("dataset = 'A'").select("dataset", "method", "k", "seed", "f1"), r.where("dataset = 'N'").select("dataset", "method", "k", "seed", "cost"))


@query("result_table", f"WITH {V.RUNS} SELECT dataset, method, k, target, seed, f1, tn FROM runs")
def result_table(spark: SparkSession, d: str) -> DataFrame:
    """Written as text and read again: doubles come back digit for digit."""
    path = scratch(spark)
    rows = V.runs(spark, d).select(*V.RUN_KEYS, "f1", "tn")
    for name in ("A", "N", "R"):
        files.write_table(rows.where(F.col("dataset") == name), f"{path}/{name}")
    return files.read_tables(spark, [f"{path}/{n}" for n in ("A", "N", "R")], "dataset string, method string, k int, target double, seed long, f1 double, tn long")


@query("prepared_reuse", f"WITH {V.FLOWS} SELECT label, CAST(count(*) AS BIGINT) AS n, round(sum(price), 2) AS price, false AS first_known, true AS again_known FROM flows GROUP BY 1")
def prepared_reuse(spark: SparkSession, d: str) -> DataFrame:
    path, source = scratch(spark), V.flows(spark, d).select("id", "label", "price")
    build = lambda df: df.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))
    _, before = files.prepared(path, {"features": ["price"]}, source, build)
    again, known = files.prepared(path, {"features": ["price"]}, source.repartition("id"), build)
    return again.select("*", F.lit(before).alias("first_known"), F.lit(known).alias("again_known"))


SCHEMAS = {
    "events": "event_id user_id ts event_type props value", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority o_totalprice o_orderdate",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
LABELS = {"l_returnflag": "label", "event_type": "label"}
PROVENANCE = " UNION ALL ".join(
    f"SELECT '{t}' AS source, {i} AS position, '  {c} ' AS raw_name, '{c}' AS name, {c not in LABELS} AS retained, '{LABELS.get(c, 'predictor')}' AS reason, CAST(count(*) AS BIGINT) AS rows, CAST(count(nullif({c}, {c})) + count({c}) AS BIGINT) AS present FROM {t}"
    for t, names in SCHEMAS.items() for i, c in enumerate(names.split())
)


@query("schema_provenance", PROVENANCE)
def schema_provenance(spark: SparkSession, d: str) -> DataFrame:
    sources = {t: V.table(spark, d, t).select(*(F.col(c).alias(f"  {c} ") for c in names.split())) for t, names in SCHEMAS.items()}
    return files.schema_provenance(sources, LABELS)


# --- labels and cleaning ---------------------------------------------------------------------------------------------


@query("label_normalize", """SELECT doc_id, rtrim(lower(trim(lang || '. ')), '.') AS simple, trim(regexp_replace(source || '  ' || lang, '\\s+', ' ', 'g')) AS spaced FROM documents""")
def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", L.normalize_simple(F.concat("lang", F.lit(". "))).alias("simple"), L.normalize_spaced(F.concat("source", F.lit("  "), "lang")).alias("spaced"))


@query("binary_label", f"WITH {V.FLOWS} SELECT id, CASE WHEN label = 'normal' THEN 0 ELSE 1 END AS attack FROM flows")
def binary_label(spark: SparkSession, d: str) -> DataFrame:
    return V.flows(spark, d).select("id", L.binary_label("label", "normal").alias("attack"))


#: All attack names, in a fixed order, and one that no family has; rows of events take them in turn.
NAMES = [n for names in L.FAMILIES.values() for n in names] + ["something else"]
NAME_SQL = f"list_value({', '.join(repr(n) for n in NAMES)})[CAST(event_id % {len(NAMES)} AS INT) + 1]"
FAMILY_SQL = "CASE name " + " ".join(f"WHEN '{n}' THEN '{f}'" for f, names in L.FAMILIES.items() for n in names) + " ELSE 'Unknown' END"


@query("category_map", f"SELECT event_id, name, {FAMILY_SQL} AS category FROM (SELECT event_id, {NAME_SQL} AS name FROM events)")
def category_map(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES)).cast("int"))
    known = spark.createDataFrame([(n, f) for f, names in L.FAMILIES.items() for n in names], "name string, category string")  # a fixed dictionary
    events = V.table(spark, d, "events").select("event_id", L.normalize_simple(F.concat(F.lit(" "), F.upper(name), F.lit(". "))).alias("name"))
    return events.join(F.broadcast(known), "name", "left").select("event_id", "name", F.coalesce("category", F.lit("Unknown")).alias("category"))


#: Labels as they are written, and the family of each.
WRITTEN = {
    "BENIGN": "Normal", " Benign ": "Normal", "DDoS": "DoS/DDoS", "DoS Hulk": "DoS/DDoS", "DoS GoldenEye": "DoS/DDoS", "DoS slowloris": "DoS/DDoS", "DoS Slowhttptest": "DoS/DDoS", "DoS": "Unknown",
    "FTP-Patator": "Brute Force", "SSH-Patator": "Brute Force", "Web Attack \ufffd  Brute Force": "Brute Force", "Web Attack \u0096 XSS": "Web Attack", "XSS": "Web Attack", "Sql Injection": "Web Attack",
    "Web Attack": "Web Attack", "PortScan": "PortScan", "Port Scan": "Unknown", "Bot": "Bot", "Infiltration": "Infiltration", "Infilteration": "Infiltration", "Heartbleed": "Heartbleed", "odd": "Unknown",
}


@query("category_pattern", f"SELECT event_id, list_value({', '.join(repr(f) for f in WRITTEN.values())})[CAST(event_id % {len(WRITTEN)} AS INT) + 1] AS category FROM events")
def category_pattern(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, WRITTEN)), (F.col("event_id") % len(WRITTEN)).cast("int"))
    return V.table(spark, d, "events").select("event_id", L.family_by_pattern(name).alias("category"))


DIRTY = f"{V.FLOWS}, {V.DIRTY}"
NUM = "CASE WHEN isfinite(try_cast(trim({0}) AS DOUBLE)) THEN try_cast(trim({0}) AS DOUBLE) END"
CLEAN = f"""{DIRTY}, clean AS (SELECT id, copy, src, {NUM.format('quantity')} AS quantity, {NUM.format('tax')} AS tax, rtrim(lower(trim(label)), '.') AS label
  FROM dirty WHERE label IS NOT NULL AND trim(label) <> '' AND coalesce({NUM.format('quantity')}, {NUM.format('tax')}) IS NOT NULL)"""


@query("clean_flows", f"WITH {CLEAN} SELECT * FROM clean")
def clean_flows(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean(V.dirty_flows(spark, d), ["quantity", "tax"], "label").select("id", "copy", "src", "quantity", "tax", "label")


@query("quality_report", f"""WITH {CLEAN}, q AS (SELECT coalesce(CAST(src AS VARCHAR), 'ALL_SOURCES') AS src, CAST(count(*) AS BIGINT) AS rows_read, CAST(count(*) FILTER (nl) AS BIGINT) AS no_label,
  CAST(sum(CASE WHEN nl THEN 0 ELSE b END) AS BIGINT) AS not_numbers, CAST(sum(CASE WHEN nl THEN 0 ELSE i END) AS BIGINT) AS not_finite,
  CAST(count(*) FILTER (NOT nl AND v IS NULL) AS BIGINT) AS no_feature, CAST(count(*) FILTER (NOT nl AND v IS NOT NULL) AS BIGINT) AS kept
  FROM (SELECT src, (label IS NULL OR trim(label) = '') AS nl, CASE WHEN quantity = 'bad' THEN 1 ELSE 0 END AS b,
  (CASE WHEN quantity = 'Infinity' THEN 1 ELSE 0 END) + (CASE WHEN tax = '-Infinity' THEN 1 ELSE 0 END) AS i, coalesce({NUM.format('quantity')}, {NUM.format('tax')}) AS v FROM dirty) GROUP BY ROLLUP (src)),
  f AS (SELECT coalesce(CAST(src AS VARCHAR), 'ALL_SOURCES') AS src, CAST(count(*) AS BIGINT) AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY quantity, tax, label ORDER BY src, id, copy) AS pos FROM clean) WHERE pos = 1 GROUP BY ROLLUP (src))
  SELECT q.*, coalesce(remaining, 0) AS remaining, kept - coalesce(remaining, 0) AS copies FROM q LEFT JOIN f USING (src)""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.quality_report(V.dirty_flows(spark, d), ["quantity", "tax"], "label", "src", ["src", "id", "copy"])


@query("dedup_first", f"WITH {CLEAN} SELECT id, copy, quantity, tax, label FROM (SELECT *, row_number() OVER (PARTITION BY quantity, tax, label ORDER BY src, id, copy) AS pos FROM clean) WHERE pos = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.clean(V.dirty_flows(spark, d), ["quantity", "tax"], "label")
    return cleaning.first_of_copies(rows, ["quantity", "tax", "label"], ["src", "id", "copy"]).select("id", "copy", "quantity", "tax", "label")


@query("row_hash", f"WITH {V.FLOWS} SELECT CAST(row_number() OVER (PARTITION BY src ORDER BY id) - 1 AS BIGINT) AS position, src AS source, label, CASE WHEN y = 0 THEN 'Normal' ELSE 'Attack' END AS category, " + V.sql_wide_hash("'row'", "id", "label") + " AS hash FROM flows")
def row_hash(spark: SparkSession, d: str) -> DataFrame:
    """The signature table: each row's place in its source, its hash, label, category and source."""
    f = V.flows(spark, d).select("id", "src", "label", "y")
    rows = files.numbered(f, "src", ["id"], "position")
    return rows.select("position", F.col("src").alias("source"), "label", F.when(F.col("y") == 0, "Normal").otherwise("Attack").alias("category"), wide_hash("row", "id", "label").alias("hash"))


MIX = 42 * 0x9E3779B1 % (1 << 64)


@query("priority_sample", f"WITH {V.FLOWS} SELECT id, format('{{:016x}}', xor(CAST('0x' || {V.sql_wide_hash(chr(39) + 'row' + chr(39), 'id')} AS UBIGINT), CAST({MIX} AS UBIGINT))) AS priority FROM flows ORDER BY 2, 1 LIMIT 500")
def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.flows(spark, d).select("id", mixed(wide_hash("row", "id"), 42).alias("priority")).orderBy("priority", "id").limit(500)


@query("drop_feature_variant", f"WITH {V.FLOWS} SELECT id, y, round(quantity + price + tax, 6) AS total FROM flows")
def drop_feature_variant(spark: SparkSession, d: str) -> DataFrame:
    f = V.flows(spark, d).select("id", "y", "quantity", "price", "discount", "tax", "label", F.col("src").alias("__source"))
    own = cleaning.predictors(f, leaky=["discount"])
    return own.select("id", "y", F.round(sum((F.col(c) for c in own.columns[3:]), F.col(own.columns[2])), 6).alias("total"))


# --- samples and splits -----------------------------------------------------------------------------------------------

P42 = V.sql_hash("'42'", "id")


@query("sample_per_label", f"WITH {V.FLOWS} SELECT id, label, priority FROM (SELECT id, label, {P42} AS priority, row_number() OVER (PARTITION BY label ORDER BY {P42}, id) AS pos FROM flows) WHERE pos <= 50")
def sample_per_label(spark: SparkSession, d: str) -> DataFrame:
    return sampling.lowest_of_each(V.flows(spark, d).select("id", "label"), ["label"], 50, 42)


@query("sample_global", f"WITH {V.FLOWS} SELECT id, {P42} AS priority FROM flows ORDER BY 2, 1 LIMIT 600")
def sample_global(spark: SparkSession, d: str) -> DataFrame:
    return sampling.lowest(V.flows(spark, d).select("id"), 600, 42)


@query("nested_cohort", f"WITH {V.FLOWS}, r AS (SELECT id, row_number() OVER (ORDER BY {P42}, id) AS pos FROM flows) SELECT CAST(count(*) AS BIGINT) AS small, CAST((SELECT count(*) FROM r WHERE pos <= 600) AS BIGINT) AS large, CAST(0 AS BIGINT) AS outside FROM r WHERE pos <= 300")
def nested_cohort(spark: SparkSession, d: str) -> DataFrame:
    f = V.flows(spark, d).select("id")
    small, large = sampling.lowest(f, 300, 42), sampling.lowest(f, 600, 42)
    outside = small.join(large, "id", "left_anti").agg(F.count("*").alias("outside"))
    return small.agg(F.count("*").alias("small")).crossJoin(large.agg(F.count("*").alias("large"))).crossJoin(outside)  # single rows


@query("self_sample", f"WITH {V.FLOWS} SELECT id, {V.sql_hash(chr(39) + '7' + chr(39), 'id')} AS priority FROM flows WHERE y = 0 ORDER BY 2, 1 LIMIT 400")
def self_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.lowest(V.flows(spark, d).where("y = 0").select("id"), 400, 7)


RARE = "CASE WHEN id = (SELECT min(id) FROM flows WHERE y = 1) THEN 'lone-1' WHEN id = (SELECT max(id) FROM flows WHERE y = 1) THEN 'lone-2' ELSE label END"


@query("safe_strata", f"""WITH {V.FLOWS}, f AS (SELECT id, y, {RARE} AS label FROM flows), n AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM f),
  p AS (SELECT id, y, n < 2 AS rare, CASE WHEN n >= 2 THEN label WHEN y = 0 THEN '__RARE_NORMAL__' ELSE '__RARE_ATTACK__' END AS stratum FROM n)
  SELECT stratum, 'original_label_with_rare_pooling' AS strategy, CAST(count(*) AS BIGINT) AS n, CAST(2 AS BIGINT) AS pooled FROM p GROUP BY 1""")
def safe_strata(spark: SparkSession, d: str) -> DataFrame:
    f = V.flows(spark, d).select("id", "y", "label")
    ends = f.where("y = 1").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    f = f.crossJoin(F.broadcast(ends)).withColumn("label", F.when(F.col("id") == F.col("lo"), "lone-1").when(F.col("id") == F.col("hi"), "lone-2").otherwise(F.col("label")))  # one row
    return sampling.safe_strata(f.select("id", "y", "label")).groupBy("stratum", "strategy", "pooled").agg(F.count("*").alias("n")).select("stratum", "strategy", "n", F.col("pooled").cast("long"))


SPLIT = f"""{V.FLOWS}, s0 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {P42}, id) AS pos, count(*) OVER (PARTITION BY label) AS n FROM flows),
s1 AS (SELECT *, floor(n * 0.3 + 0.5) AS nt FROM s0),
split AS (SELECT *, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + floor((n - nt) * 0.2 + 0.5) THEN 'validation' ELSE 'train' END AS split FROM s1)"""


def split_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows with their split."""
    return sampling.stratified_split(V.flows(spark, d), "label", 0.3, 0.2, 42)


@query("stratified_split", f"WITH {SPLIT} SELECT id, label, split FROM split")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split_flows(spark, d).select("id", "label", "split")


@query("class_cap_sample", f"""WITH {V.FLOWS}, c AS (SELECT y, greatest(1, floor(1000.0 * count(*) / sum(count(*)) OVER () + 0.5)) AS quota FROM flows GROUP BY y),
  r AS (SELECT id, y, {P42} AS priority, row_number() OVER (PARTITION BY y ORDER BY {P42}, id) AS pos FROM flows) SELECT id, r.y, priority FROM r JOIN c ON r.y = c.y WHERE pos <= quota ORDER BY priority, id LIMIT 1000""")
def class_cap_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.class_cap(V.flows(spark, d).select("id", "y"), 1000, 42).select("id", "y", "priority")


SEEDS = list(range(1, 6))
RESAMPLE = f"""{V.EMB}, seeds AS (SELECT unnest([1, 2, 3, 4, 5]) AS seed), rs0 AS (SELECT seed, emb.*, row_number() OVER (PARTITION BY seed, y ORDER BY {V.sql_hash('seed', 'vec_id')}, vec_id) AS pos,
  count(*) OVER (PARTITION BY seed, y) AS n FROM emb CROSS JOIN seeds), rs AS (SELECT * FROM rs0 WHERE pos <= floor(n * 0.8 + 0.5))"""


@query("stratified_resamples", f"WITH {RESAMPLE} SELECT CAST(seed AS INT) AS seed, y, CAST(count(*) AS BIGINT) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM rs GROUP BY 1, 2")
def stratified_resamples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.resamples(V.emb(spark, d), SEEDS, 0.8, key="vec_id").groupBy("seed", "y").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("split_counts", f"WITH {SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS attacks, CAST(count(DISTINCT label) AS BIGINT) AS labels FROM split GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return split_flows(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("attacks"), F.count_distinct("label").alias("labels"))


@query("label_distribution", f"WITH {SPLIT} SELECT label, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (split = 'validation') AS BIGINT) AS validation, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS test FROM split GROUP BY 1")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return split_flows(spark, d).groupBy("label").pivot("split", ["train", "validation", "test"]).count().na.fill(0)


@query("composition", f"WITH {SPLIT} SELECT CASE WHEN grouping(split) = 0 THEN 'split_label' WHEN grouping(src) = 0 THEN 'source_label' ELSE 'label' END AS grouping, split, label, src, CAST(count(*) AS BIGINT) AS n FROM split GROUP BY GROUPING SETS ((label), (split, label), (src, label))")
def composition(spark: SparkSession, d: str) -> DataFrame:
    s = split_flows(spark, d)
    c = F.col
    tag = F.when(F.grouping("split") == 0, "split_label").when(F.grouping("src") == 0, "source_label").otherwise("label")
    return s.groupingSets([[c("label")], [c("split"), c("label")], [c("src"), c("label")]], c("split"), c("label"), c("src")).agg(F.count("*").alias("n"), tag.alias("grouping"))


# --- features ----------------------------------------------------------------------------------------------------------

E = [f"e{i:02d}" for i in range(V.DIMS)]
UNPIVOT = ", ".join(V.FEATURES)


@query("one_hot", "WITH v AS (SELECT DISTINCT lang FROM documents WHERE doc_id % 5 <> 0 AND lang <> 'es') SELECT doc_id, CAST(lang = 'de' AS INT) AS lang_de, CAST(lang = 'en' AS INT) AS lang_en, CAST(lang = 'fr' AS INT) AS lang_fr FROM documents")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    return X.one_hot(docs, "lang", X.vocabulary(docs.where("doc_id % 5 <> 0 AND lang <> 'es'"), "lang")).drop("lang")


GAPS = f"{SPLIT}, t AS (SELECT id, split, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE price END AS price, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE tax END AS tax, CASE WHEN split <> 'train' THEN quantity END AS late FROM split)"


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Missing values, and a feature that has none but missing ones in training."""
    s = split_flows(spark, d)
    k = F.col("l_orderkey")
    return materialized(s.select("id", "split", F.when(k % 7 != 0, F.col("price")).alias("price"), F.when(k % 11 != 0, F.col("tax")).alias("tax"), F.when(F.col("split") != "train", F.col("quantity")).alias("late")))


@query("impute_median", f"WITH {GAPS} SELECT id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t WHERE split = 'train')) AS price, coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM t WHERE split = 'train')) AS tax FROM t")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    s, features = with_gaps(spark, d), ["price", "tax", "late"]
    p = X.fitted(X.statistics(s.where("split = 'train'"), features))
    return s.select("id", *(X.imputed(f, p[f]) for f in X.with_values(p, features)))  # `late` goes


@query("imputed_cells", f"WITH {GAPS} SELECT split, 'price' AS feature, CAST(count(*) - count(price) AS BIGINT) AS cells FROM t GROUP BY 1 UNION ALL SELECT split, 'tax', CAST(count(*) - count(tax) AS BIGINT) FROM t GROUP BY 1")
def imputed_cells(spark: SparkSession, d: str) -> DataFrame:
    return X.imputed_cells(with_gaps(spark, d), "split", ["price", "tax"])


@query("reindex_features", f"WITH {V.FLOWS} SELECT id, tax, 0.0::DOUBLE AS absent, price, 0.0::DOUBLE AS other FROM flows")
def reindex_features(spark: SparkSession, d: str) -> DataFrame:
    return X.reindexed(V.flows(spark, d), ["tax", "absent", "price", "other"], ["id"])


@query("minmax_scale", f"WITH {SPLIT}, t AS (SELECT min(price) AS a, max(price) AS b, min(tax) AS c, max(tax) AS e FROM split WHERE split = 'train') SELECT id, round((price - a) / (b - a), 9) AS price, round((tax - c) / (e - c), 9) AS tax FROM split, t")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    s = materialized(split_flows(spark, d).select("id", "price", "tax", "split"))
    p = X.fitted(X.ends(s.where("split = 'train'"), ["price", "tax"]))
    return s.select("id", *(F.round(X.scaled(f, p[f]), 9).alias(f) for f in ("price", "tax")))


@query("discrete_mask", f"WITH {V.FLOWS} SELECT 'discount' AS feature, bool_and(abs(discount) <= 1e-8 OR abs(discount - 1) <= 1.001e-5) AS is_discrete FROM flows UNION ALL SELECT 'flag', bool_and(abs(y) <= 1e-8 OR abs(y - 1) <= 1.001e-5) FROM flows")
def discrete_mask(spark: SparkSession, d: str) -> DataFrame:
    return X.discrete_mask(V.flows(spark, d).withColumn("flag", F.col("y").cast("double")), ["discount", "flag"])


LONG = ", ".join(f"('{f}', {f})" for f in V.FEATURES)
EDGES = f"""{SPLIT}, long AS (SELECT id, split, y, u.feature, u.x FROM split, LATERAL (SELECT * FROM (VALUES {LONG}) v(feature, x)) u),
edges AS (SELECT feature, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM long WHERE split = 'train' GROUP BY 1),
bins AS (SELECT id, split, y, feature, CAST(len(list_filter(e, lambda v: v <= x)) AS INT) AS x FROM long JOIN edges USING (feature))"""


def train_edges(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[float]]]:
    """Training rows, as a table, and the edges of their bins."""
    s = materialized(split_flows(spark, d).where("split = 'train'").select("y", *V.FEATURES))
    return s, X.bin_edges(s, V.FEATURES)


@query("quantile_bins", f"WITH {EDGES} SELECT feature, x, CAST(count(*) AS BIGINT) AS n FROM bins GROUP BY 1, 2")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    s = materialized(split_flows(spark, d).select("split", *V.FEATURES))
    counts = X.pair_counts(s, [(f, f) for f in V.FEATURES], X.bin_edges(s.where("split = 'train'"), V.FEATURES))
    return counts.select(F.col("a").alias("feature"), "x", "n")


MI = f"""{EDGES}, n AS (SELECT feature, x, y, count(*) AS n FROM bins WHERE split = 'train' GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS a FROM n),
mi AS (SELECT feature, round(sum(n / a * ln(n * a / (nx * ny))), 9) AS mi FROM t GROUP BY 1),
ranked AS (SELECT feature, mi, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INT) AS rank, round(CASE WHEN sum(greatest(mi, 0)) OVER () > 0 THEN greatest(mi, 0) / sum(greatest(mi, 0)) OVER () ELSE 1.0 / count(*) OVER () END, 9) AS weight FROM mi)"""


def information(train: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    mi = X.counted_information(X.pair_counts(train, [(f, "y") for f in V.FEATURES], edges), ["a"])
    return materialized(mi.select(F.col("a").alias("feature"), F.round("mi", 9).alias("mi")))  # a row a feature, which several steps read


def ranking(spark: SparkSession, d: str) -> DataFrame:
    return X.ranked(information(*train_edges(spark, d))).withColumn("weight", F.round("weight", 9))


@query("mi_discrete", f"WITH {MI} SELECT feature, mi FROM mi")
def mi_discrete(spark: SparkSession, d: str) -> DataFrame:
    return information(*train_edges(spark, d))


@query("feature_rank", f"WITH {MI} SELECT feature, mi, rank FROM ranked")
def feature_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d).drop("weight")


@query("feature_weights", f"WITH {MI} SELECT feature, weight FROM ranked")
def feature_weights(spark: SparkSession, d: str) -> DataFrame:
    return ranking(spark, d).select("feature", "weight")


@query("top_features", f"WITH {MI} SELECT feature, mi FROM ranked WHERE rank <= 5")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    return X.top(ranking(spark, d), 5).select("feature", "mi")


@query("nested_feature_sets", f"WITH {MI} SELECT k, feature, rank, mi, weight FROM ranked CROSS JOIN (SELECT unnest([3, 5, 10]) AS k) WHERE rank <= k")
def nested_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """The selected features of each set, with rank, score and weight."""
    sizes = F.explode(F.array(F.lit(3), F.lit(5), F.lit(10)))
    return ranking(spark, d).withColumn("k", sizes).where("rank <= k").select("k", "feature", "rank", "mi", "weight")


@query("feature_text", f"WITH {MI} SELECT string_agg(feature, '|' ORDER BY rank) AS features, CAST(count(*) AS INT) AS n, min(feature) FILTER (rank = 1) AS first FROM ranked WHERE rank <= 5")
def feature_text(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"])  # five rows
    text = X.top(ranking(spark, d), 5).agg(X.joined_names(names).alias("features"))
    back = X.parted_names("features")
    return text.select("features", F.size(back).alias("n"), F.get(back, F.lit(0)).alias("first"))


@query("feature_signature", f"WITH {MI} SELECT sha256(string_agg(feature || ':' || CAST(round(mi * 1e6) AS BIGINT) || ':' || CAST(round(weight * 1e6) AS BIGINT), '|' ORDER BY rank)) AS signature FROM ranked")
def feature_signature(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    items = F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", "feature", part("mi"), part("weight")).alias("t"))))  # a row for each feature
    return ranking(spark, d).agg(F.sha2(F.array_join(F.transform(items, lambda s: s["t"]), "|"), 256).alias("signature"))


@query("pairwise_mi", f"""WITH {EDGES}, six AS (SELECT id, feature, x FROM bins WHERE split = 'train'),
  n AS (SELECT p.feature AS a, q.feature AS b, p.x AS x, q.x AS y, count(*) AS n FROM six p JOIN six q ON p.id = q.id AND p.feature < q.feature GROUP BY 1, 2, 3, 4),
  t AS (SELECT *, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny, sum(n) OVER (PARTITION BY a, b) AS s FROM n)
  SELECT a, b, round(sum(n / s * ln(n * s / (nx * ny))), 9) AS mi FROM t GROUP BY 1, 2""")
def pairwise_mi(spark: SparkSession, d: str) -> DataFrame:
    train, edges = train_edges(spark, d)
    return X.pair_information(train, V.FEATURES, edges).withColumn("mi", F.round("mi", 9))


#: The greedy order, one feature a step, over lists of what is chosen.
MRMR = f"""{MI}, pn AS (SELECT p.feature AS a, q.feature AS b, p.x AS x, q.x AS y, count(*) AS n FROM bins p JOIN bins q ON p.id = q.id AND p.feature <> q.feature WHERE p.split = 'train' AND q.split = 'train' GROUP BY 1, 2, 3, 4),
pt AS (SELECT *, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny, sum(n) OVER (PARTITION BY a, b) AS s FROM pn), red AS (SELECT a, b, sum(n / s * ln(n * s / (nx * ny))) AS r FROM pt GROUP BY 1, 2),
every AS (SELECT list({{'f': feature, 'm': mi, 'r': (SELECT list({{'b': b, 'r': r}}) FROM red WHERE a = feature)}} ORDER BY feature) AS l FROM mi),
steps AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS chosen UNION ALL SELECT step + 1, list_append(chosen, list_sort(list_transform(list_filter(l, lambda e: NOT list_contains(chosen, e.f)),
  lambda e: {{'g': -round(e.m - coalesce(list_avg(list_transform(list_filter(e.r, lambda x: list_contains(chosen, x.b)), lambda x: x.r)), 0), 12), 'f': e.f}}))[1].f) FROM steps, every WHERE step < len(l))
SELECT CAST(u.i AS INT) AS rank, chosen[u.i] AS feature, mi FROM steps, range(1, len(chosen) + 1) u(i) JOIN mi ON mi.feature = chosen[u.i] WHERE step = (SELECT count(*) FROM mi)"""


@query("mrmr", f"WITH RECURSIVE {MRMR}")
def mrmr(spark: SparkSession, d: str) -> DataFrame:
    train, edges = train_edges(spark, d)
    relevance = {r["feature"]: r["mi"] for r in information(train, edges).collect()}  # features
    redundancy = {(r["a"], r["b"]): r["mi"] for r in X.pair_information(train, V.FEATURES, edges).collect()}  # features squared
    order = X.mrmr(relevance, redundancy)
    return spark.createDataFrame([(i + 1, f, relevance[f]) for i, f in enumerate(order)], "rank int, feature string, mi double")


#: Neighbours by windows over whole classes, and points within the radius by a frame of its width; H has the harmonic numbers.
KNN = f"""{V.FLOWS}, l AS (SELECT u.feature, y, u.x FROM flows, LATERAL (SELECT * FROM (VALUES {LONG}) v(feature, x)) u), s AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny, count(*) OVER (PARTITION BY feature) AS n_all,
{', '.join(f'lag(x, {i}) OVER c AS b{i}, lead(x, {i}) OVER c AS a{i}' for i in (1, 2, 3))} FROM l WINDOW c AS (PARTITION BY feature, y ORDER BY x)),
r AS (SELECT *, least(a3 - x, CASE WHEN b1 IS NOT NULL AND a2 IS NOT NULL THEN greatest(x - b1, a2 - x) END, CASE WHEN b2 IS NOT NULL AND a1 IS NOT NULL THEN greatest(x - b2, a1 - x) END, x - b3) * (1 - 1e-9) AS r0 FROM s),
rr AS (SELECT *, min(r0) OVER (PARTITION BY feature, y, x) AS r FROM r), c AS (SELECT feature, ny, n_all, count(*) OVER (PARTITION BY feature ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m FROM rr),
h0 AS (SELECT range AS n FROM range(1, (SELECT count(*) + 2 FROM flows))), h AS (SELECT n, coalesce(sum(1.0::DOUBLE / n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329 AS psi FROM h0)
SELECT feature, round(greatest(0, max(ha.psi) + avg(1.5 - 0.5772156649015329 - hy.psi - hm.psi)), 9) AS mi FROM c JOIN h hm ON hm.n = m JOIN h hy ON hy.n = ny JOIN h ha ON ha.n = n_all GROUP BY 1"""


@query("mi_knn", f"WITH {KNN}")
def mi_knn(spark: SparkSession, d: str) -> DataFrame:
    return X.knn_information(X.melted(V.flows(spark, d), ["y"], V.FEATURES)).withColumn("mi", F.round("mi", 9))


@query("spearman", f"""WITH {V.EMB}, l AS (SELECT vec_id, u.feature, u.x FROM emb, LATERAL (SELECT * FROM (VALUES {', '.join(f"('{f}', {f})" for f in E)}) v(feature, x)) u), r AS (SELECT vec_id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM l)
  SELECT p.feature AS a, q.feature AS b, round(corr(p.r, q.r), 9) AS rho FROM r p JOIN r q ON p.vec_id = q.vec_id AND p.feature < q.feature GROUP BY 1, 2""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of all components."""
    return X.rank_correlation(V.emb(spark, d), "vec_id", E).withColumn("rho", F.round("rho", 9))


ELONG = ", ".join(f"('{f}', {f})" for f in E)
STABLE = f"""{RESAMPLE}, med AS (SELECT seed, {', '.join(f'median({f}) AS m_{f}' for f in E)} FROM rs GROUP BY 1),
el AS (SELECT rs.seed, rs.y, u.feature, u.x FROM rs JOIN med USING (seed), LATERAL (SELECT * FROM (VALUES {', '.join(f"('{f}', CAST({f} > m_{f} AS INT))" for f in E)}) v(feature, x)) u),
sn AS (SELECT seed, feature, x, y, count(*) AS n FROM el GROUP BY ALL), st AS (SELECT *, sum(n) OVER (PARTITION BY seed, feature, x) AS nx, sum(n) OVER (PARTITION BY seed, feature, y) AS ny, sum(n) OVER (PARTITION BY seed, feature) AS a FROM sn),
smi AS (SELECT seed, feature, round(sum(n / a * ln(n * a / (nx * ny))), 9) AS mi FROM st GROUP BY 1, 2),
srank AS (SELECT seed, feature, mi, row_number() OVER (PARTITION BY seed ORDER BY mi DESC, feature) AS rank FROM smi)"""


def stable_ranks(spark: SparkSession, d: str) -> DataFrame:
    long = X.melted(sampling.resamples(V.emb(spark, d), SEEDS, 0.8, key="vec_id"), ["seed", "y"], E)
    long = materialized(long.withColumn("of", F.concat_ws("|", "seed", "feature")))
    median = X.quantiles(long, [0.5], "of").select("of", F.col("value").alias("m"))
    bits = long.join(F.broadcast(median), "of").select("seed", "feature", "y", (F.col("x") > F.col("m")).cast("int").alias("x"))  # a row a seed and feature
    return X.ranked(X.mutual_information(bits, ["seed", "feature"]).withColumn("mi", F.round("mi", 9)), ["seed"])


@query("feature_stability", f"WITH {STABLE} SELECT feature, CAST(count(*) FILTER (rank <= 5) AS BIGINT) AS selected, round(avg(mi), 9) AS mean_mi, round(min(mi), 9) AS least_mi, round(max(mi), 9) AS most_mi, round(stddev_samp(mi), 9) AS std_mi FROM srank GROUP BY 1")
def feature_stability(spark: SparkSession, d: str) -> DataFrame:
    return stable_ranks(spark, d).groupBy("feature").agg(F.count_if(F.col("rank") <= 5).alias("selected"), *(F.round(f("mi"), 9).alias(n) for f, n in ((F.avg, "mean_mi"), (F.min, "least_mi"), (F.max, "most_mi"), (F.stddev_samp, "std_mi"))))


PAIRS = f"""{STABLE}, sp AS (SELECT p.seed AS s1, q.seed AS s2, count(*) FILTER (p.rank <= 5 AND q.rank <= 5) AS shared, corr(p.rank, q.rank) AS rho FROM srank p JOIN srank q ON p.feature = q.feature AND p.seed < q.seed GROUP BY 1, 2)"""


def stable_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = stable_ranks(spark, d).select("seed", "feature", "rank")
    a, b = r.toDF("s1", "feature", "r1"), r.toDF("s2", "feature", "r2")
    pairs = a.join(b, "feature").where("s1 < s2").groupBy("s1", "s2").agg(F.count_if((F.col("r1") <= 5) & (F.col("r2") <= 5)).alias("shared"), F.round(F.corr("r1", "r2"), 9).alias("rho"))
    return pairs.select("s1", "s2", F.round(F.col("shared") / (10 - F.col("shared")), 9).alias("jaccard"), "rho")


@query("stability_pairs", f"WITH {PAIRS} SELECT CAST(s1 AS INT) AS s1, CAST(s2 AS INT) AS s2, round(shared / CAST(10 - shared AS DOUBLE), 9) AS jaccard, round(rho, 9) AS rho FROM sp")
def stability_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stable_pairs(spark, d)


@query("stability_summary", f"WITH {PAIRS}, j AS (SELECT round(shared / CAST(10 - shared AS DOUBLE), 9) AS jaccard, round(rho, 9) AS rho FROM sp) SELECT round(avg(jaccard), 8) AS mean_jaccard, round(stddev_samp(jaccard), 8) AS std_jaccard, min(jaccard) AS least, max(jaccard) AS most, round(avg(rho), 8) AS mean_rho FROM j")
def stability_summary(spark: SparkSession, d: str) -> DataFrame:
    return stable_pairs(spark, d).agg(F.round(F.avg("jaccard"), 8).alias("mean_jaccard"), F.round(F.stddev_samp("jaccard"), 8).alias("std_jaccard"), F.min("jaccard").alias("least"), F.max("jaccard").alias("most"), F.round(F.avg("rho"), 8).alias("mean_rho"))


@query("partition_overlap", f"""WITH {SPLIT}, f AS (SELECT split, CASE WHEN split = 'test' THEN -quantity ELSE quantity END AS quantity, discount, tax FROM split), k AS (SELECT DISTINCT * FROM f), p AS (SELECT a.split AS s1, b.split AS s2, count(*) AS n FROM k a JOIN k b ON a.quantity = b.quantity AND a.discount = b.discount AND a.tax = b.tax AND a.split < b.split GROUP BY 1, 2)
  SELECT x.split AS s1, y.split AS s2, CAST(coalesce(n, 0) AS BIGINT) AS shared FROM (SELECT DISTINCT split FROM split) x JOIN (SELECT DISTINCT split FROM split) y ON x.split < y.split LEFT JOIN p ON s1 = x.split AND s2 = y.split""")
def partition_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Keys that pairs of partitions share; pairs that share none have 0."""
    f = materialized(split_flows(spark, d).select("split", "quantity", "discount", "tax")).withColumn("quantity", F.when(F.col("split") == "test", -F.col("quantity")).otherwise(F.col("quantity")))
    sets = f.groupBy("quantity", "discount", "tax").agg(F.array_sort(F.collect_set("split")).alias("s"))  # three splits at most
    pairs = sets.select(F.explode("s").alias("s1"), "s").select("s1", F.explode("s").alias("s2")).where("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("shared"))
    names = f.select(F.col("split").alias("s1")).distinct()
    every = names.join(names.withColumnRenamed("s1", "s2"), F.col("s1") < F.col("s2"))  # pairs of three splits
    return every.join(pairs, ["s1", "s2"], "left").na.fill(0)


SIGN = [f"CAST('0x' || substr({V.sql_wide_hash(chr(39) + 'sig' + chr(39), 'id', 'y')}, {i}, 8) AS BIGINT)" for i in (1, 9)]


@query("partition_signature", f"WITH {SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum({SIGN[0]}) AS BIGINT) AS total_high, CAST(sum({SIGN[1]}) AS BIGINT) AS total_low, CAST(bit_xor({SIGN[0]}) AS BIGINT) AS mixed_high, CAST(bit_xor({SIGN[1]}) AS BIGINT) AS mixed_low FROM split GROUP BY 1")
def partition_signature(spark: SparkSession, d: str) -> DataFrame:
    """Counts, sums and exclusive-ors of both halves of 64-bit hashes."""
    h = wide_hash("sig", "id", "y")
    high, low = (F.conv(F.substring(h, i, 8), 16, 10).cast("bigint") for i in (1, 9))
    return split_flows(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum(high).alias("total_high"), F.sum(low).alias("total_low"), F.bit_xor(high).alias("mixed_high"), F.bit_xor(low).alias("mixed_low"))


@query("cohort_overlap", f"WITH {SPLIT}, o AS (SELECT id FROM flows ORDER BY {P42}, id LIMIT 600) SELECT split, CAST(count(*) AS BIGINT) AS shared, round(count(*) / 600.0, 9) AS share FROM split JOIN o USING (id) GROUP BY 1")
def cohort_overlap(spark: SparkSession, d: str) -> DataFrame:
    old = sampling.lowest(V.flows(spark, d).select("id"), 600, 42).select("id")
    return split_flows(spark, d).join(old, "id").groupBy("split").agg(F.count("*").alias("shared"), F.round(F.count("*") / 600, 9).alias("share"))


@query("align_diff", f"WITH {V.FLOWS}, a AS (SELECT id, label, CAST(y AS VARCHAR) AS y, src, row_number() OVER (ORDER BY id) AS pos FROM flows) SELECT 'label' AS field, label AS a, CASE WHEN pos % 50 = 0 THEN 'X' ELSE label END AS b, CAST(count(*) AS BIGINT) AS n FROM a WHERE pos % 50 = 0 GROUP BY 2, 3")
def align_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two tables row by row, by position."""
    f = V.flows(spark, d).select("id", "label", "y", F.lit(0).alias("all"))
    left = files.numbered(f, "all", ["id"], "position").select("position", "label", "y")
    right = left.withColumn("label", F.when((F.col("position") + 1) % 50 == 0, "X").otherwise(F.col("label")))
    return cleaning.table_diff(left, right, ["position"], ["label", "y"])
