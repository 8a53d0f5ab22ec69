"""Small helpers that the text operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word definition `[^\x20\x09-\x0D]+` (fixed values).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Keys with more than one in HOT_KEYS of all rows are hot, so there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as fold 0, which is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def by_bytes(batch: pa.RecordBatch, *columns: str, limit: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of at most `rows` rows whose texts in `columns` hold about `limit` bytes; a row of more
    gets a slice of its own."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        fit = int(np.searchsorted(ends, ends[start] - sizes[start] + limit, side="right"))
        stop = max(start + 1, min(fit, start + rows))
        yield batch.slice(start, stop - start)
        start = stop


_HELD: dict[str, Any] = {}


def held(content: bytes, build: Callable[[], Any]) -> Any:
    """What `build` makes of `content`, kept in the worker process until something else is held: one at a time."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, a local session gets one of its own;
    on a cluster that is an error, as executors could not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Steps:
    """Cuts the lineage between the steps of a job: writes a frame as Parquet into the shared folder and reads it back, so
    that a lost executor costs no earlier step. `forget` deletes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def forget(self, *frames: DataFrame) -> None:
        for frame, path in self.paths:
            if any(frame is f for f in frames):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """One step by itself."""
    return Steps(df.sparkSession)(df)


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """rows joined by `key` with `counted`, which has one row a key and in column `n` how many of `rows` have it.

    A hot key would be one task's work. As each has over one in HOT_KEYS of the counted rows, there are fewer than HOT_KEYS
    of them, and these few are broadcast; all others meet in a shuffle. `counted` is a table, which is read more than once."""
    hot = F.col(n) > (counted.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    few = counted.where(hot)
    if few.isEmpty():
        return rows.join(counted, key)
    return rows.join(counted.where(~hot), key).unionByName(rows.join(F.broadcast(few), key))
