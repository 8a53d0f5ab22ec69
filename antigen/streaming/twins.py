"""Streaming forms of dedup, bottom-k samples, quality counters and scoring; each equals its batch form."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.operators.sampling import lowest_of_each


def stream_of(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The Parquet files of a folder or file as a stream, `files` of them a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)  # a stream reads folders; of this one, the file alone


def resumed(df: DataFrame, path: str, stop: int | None = None) -> DataFrame:
    """Runs a stream from where its checkpoint under `path` left it, over all that is there, and reads the table of all runs.

    Each batch is a part of its own, written under the batch's number: one that was written but not committed when a run
    ended is replayed with the same number and rows, and replaces its part, so no row is lost or there twice. `stop` ends
    the run, for tests of this, as batch `stop` is written and before it is committed."""

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={i}")
        if i == stop:
            raise InterruptedError(f"stopped at batch {i}")

    q = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if stop is None:
            raise
    return df.sparkSession.read.schema(f"{ddl(df)}, batch long").parquet(f"{path}/rows")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def drained(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a Parquet table, and reads it."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def dedup(stream: DataFrame, keys: list[str], time: str, lateness: str = "30 days") -> DataFrame:
    """The first row of each key; state is dropped once the watermark passes it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def complete(df: DataFrame, path: str) -> DataFrame:
    """An aggregate in complete mode, its last state of each batch replaced in a table."""
    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    q = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def bottom_k(stream: DataFrame, by: str, n: int, seed: int, key: str, path: str) -> DataFrame:
    """The n rows of the lowest priority of each group: each batch is merged with what was kept, so a state holds n rows a
    group at most. Kept rows alternate between two tables, so that none is read while it is replaced."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, i: int) -> None:
        old = spark.read.schema(batch.schema).parquet(f"{path}/kept-{i - 1}") if i else batch.limit(0)
        lowest_of_each(batch.union(old), [by], n, seed, key).drop("priority").write.mode("overwrite").parquet(f"{path}/kept-{i}")
        spark.createDataFrame([(i,)], "i long").write.mode("overwrite").parquet(f"{path}/last")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{path}/last").first()[0]
    return lowest_of_each(spark.read.schema(stream.schema).parquet(f"{path}/kept-{last}"), [by], n, seed, key)


def quality(stream: DataFrame, by: str, value: str) -> DataFrame:
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(value) < 0).alias("negative"), F.round(F.sum(value), 6).alias("total"))
