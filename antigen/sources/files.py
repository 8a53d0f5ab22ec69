"""Readers of delimited files, flow folders and run journals, and the sinks that match them."""

from __future__ import annotations

import csv
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from antigen.sources.steps import materialized


def clean_header(names: list[str]) -> list[str]:
    """Names without marks and outer blanks, inner blanks single; repeats get __2, __3 and so on."""
    seen: Counter = Counter()
    out = []
    for name in names:
        name = re.sub(r"\s+", " ", name.replace("﻿", "")).strip()
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    return out


def read_positional(spark: SparkSession, path: str, names: list[str], optional: str) -> DataFrame:
    """A headerless file of `names` columns, tab or comma separated, all text; the column `optional` may be missing from
    the end of every line and is then null. Any other width is an error."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    line = first[0][0]
    guess = "\t" if line.count("\t") >= line.count(",") and "\t" in line else ","
    for sep in (guess, "," if guess == "\t" else "\t"):
        width = len(line.split(sep))
        if width in (len(names), len(names) - 1):
            break
    else:
        raise ValueError(f"{path} has {width} columns; {len(names)} or {len(names) - 1} are known")
    kept = names if width == len(names) else [n for n in names if n != optional]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in kept])
    df = spark.read.csv(path, schema=schema, sep=sep)
    return df.select(*(F.col(n) if n in kept else F.lit(None).cast("string").alias(n) for n in names))


def headers_of(spark: SparkSession, folder: str) -> dict[tuple[str, ...], list[str]]:
    """The files under a folder by their header lines, split but not cleaned; files without a line are left out."""
    lines = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.csv").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "id").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(first.collect(), key=lambda r: r["file"]):  # a row a file
        found.setdefault(tuple(next(csv.reader([r["line"].removeprefix("\ufeff")]), [])), []).append(unquote(r["file"]))
    return found


def read_flow_files(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files under a folder, text columns with clean names, the file's path as `source_file` and the row's place in it,
    from 0 and without the header, as `source_row`.

    Each file is read by its own header: files of one header are scanned together, and the scans are joined by name, in the
    order of the first files that have a column; what a file lacks is null. A folder without lines is an error.
    A long file is read in blocks: rows are numbered within each, and the blocks' counts give where each begins."""
    scans = []
    for header, paths in headers_of(spark, folder).items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        raw = spark.read.csv([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths], schema=schema, header=True, recursiveFileLookup=True)
        named = [F.col(c).alias(name) for c, name in zip(raw.columns, clean_header(list(header)))]
        scans.append(raw.select(*named, F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")))
    if not scans:
        raise ValueError(f"{folder} has no CSV file with a header")
    rows = union_tables(*scans)
    named = [c for c in rows.columns if c not in ("source_file", "_block", "_id")]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("source_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).withColumn("_before", before).drop("_n")
    # a block's rows stand in one task, side by side, so their ids are consecutive and nothing is sorted
    at = F.col("_before") + F.col("_id") - F.col("_first")
    return rows.join(F.broadcast(materialized(blocks)), ["source_file", "_block"]).withColumn("source_row", at.cast("long")).select(*named, "source_file", "source_row")  # a row a block of a file


def numbered(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Adds a row's place in its source, from 0. Rows are sorted once, in as many ranges of source and order as the shuffle has
    parts, so that no task orders a whole source; the ranges' counts give where each begins."""
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_id", F.monotonically_increasing_id())
    rows = materialized(ranged.withColumn("_range", F.shiftright("_id", 33)))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).withColumn("_before", before)
    counts = materialized(counts.drop("_n"))  # a row a source and range
    at = F.col("_before") + F.col("_id") - F.col("_first")
    return rows.join(counts, (F.col("_range") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, at.cast("long")).select(*df.columns, name)


def bounded(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each source, and `scan_complete`: whether that is all of it."""
    first = df.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_at") <= n + 1)
    more = F.max("_at").over(Window.partitionBy(by)) > n
    return first.withColumn("scan_complete", ~more).where(F.col("_at") <= n).drop("_at")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A journal of JSON lines. Blank lines are skipped, and a torn line that is the last of its file is dropped; any other
    line that is no object is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")).where(F.trim("value") != "")
    fits = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.try_parse_json("value").isNotNull()
    of_file = lines.withColumn("fits", fits).groupBy("file").agg(F.count_if(~F.col("fits")).alias("n"), F.max(F.when(~F.col("fits"), F.col("at"))).alias("worst"), F.max("at").alias("last"))
    bad = of_file.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("worst") != F.col("last")))).first()
    if bad:
        raise ValueError(f"{bad['file']}: {bad['n']} lines are damaged, not the last one alone")
    return lines.where(fits).select(F.from_json("value", schema).alias("r")).select("r.*")


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """Replaces a result table; Spark's commit protocol shows it whole or not at all."""
    df.write.mode("overwrite").options(header=True).format(form).save(path)


def read_table(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    """A result table as it was written, by its schema."""
    return spark.read.schema(schema).options(header=True).format(form).load(path)


def read_tables(spark: SparkSession, paths: list[str], schema: str, form: str = "csv") -> DataFrame:
    """The rows of several result tables; one that is missing is an error, whichever it is."""
    if not paths:
        raise ValueError("no tables are named")
    return union_tables(*(read_table(spark, p, schema, form) for p in paths))


def fingerprint(df: DataFrame) -> str:
    """Tells contents apart, in any order of rows: count, sum and exclusive-or of 64-bit hashes, and the schema."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(json.dumps([df.schema.simpleString(), r["n"], str(r["s"]), r["x"]]).encode()).hexdigest()


def prepared(folder: str, config: dict, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """What `build` makes of the source, kept under the configuration and the source's fingerprint and read again where both
    are as before, and whether it was. A table that was not written whole is written anew."""
    spark = source.sparkSession
    key = hashlib.sha256(json.dumps([config, fingerprint(source)], sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    known = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not known:
        build(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), known


def union_tables(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column that a table lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def schema_provenance(sources: dict[str, DataFrame], dropped: dict[str, str]) -> DataFrame:
    """(source, position, raw_name, name, retained, reason, rows, present) for each column of each source; `present` counts its
    values. One aggregate a source."""
    frames = []
    for source, df in sorted(sources.items()):
        columns = list(zip(df.columns, clean_header(df.columns)))
        each = F.array(*(
            F.struct(
                F.lit(i).alias("position"), F.lit(raw).alias("raw_name"), F.lit(new).alias("name"), F.lit(new not in dropped).alias("retained"), F.lit(dropped.get(new, "predictor")).alias("reason"),
                F.count("*").alias("rows"), F.count(F.col(f"`{raw}`")).alias("present"),
            )
            for i, (raw, new) in enumerate(columns)
        ))
        frames.append(df.agg(each.alias("c")).select(F.explode("c").alias("c")).select(F.lit(source).alias("source"), "c.*"))
    return union_tables(*frames)
