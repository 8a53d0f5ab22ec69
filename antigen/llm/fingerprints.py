"""Operator 11, document fingerprints: a threshold-scaled sketch.

A text's shingles are its runs of `WIDTH` code points, hashed to 48 bits. A sketch keeps every hash up to a limit, which is
a fixed fraction of all hashes, so that sketches of texts of any size hold comparable samples: the hashes that two
sketches keep below the lower of their limits estimate likeness and containment, and the union of two sketches below it
is the sketch of both texts. A text with fewer than `LEAST` hashes under the fraction has a higher limit, just over its
LEAST smallest ones, as short texts would have no sketch otherwise; texts of up to LEAST shingles are kept whole.

As a string, a fingerprint is its limit and then its hashes, rising, each of twelve lowercase hex digits.

To meet its neighbour in the order of ids, every document is dealt to a range of the order, and the first document of each
range is sent to the range before as well. So each range, sorted, streams through a task that holds two texts at a time.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antigen.llm.common import Steps, by_bytes, join_counted, table
from antigen.llm.shingles import mix

#: Code points of a shingle.
WIDTH = 8
#: One hash in so many is kept, and the least number that a text of so many shingles keeps.
SCALE, LEAST = 128, 64
DIGITS = 12
_TOP = (1 << 48) - 1
#: Code points that are hashed at a time.
CHUNK = 1 << 20
#: Ranges of the order of ids, at most, and rows of a range on the average; cuts come from a sample of so many keys a range.
MOST_RANGES, RANGE_ROWS, KEYS = 16384, 64, 4
_A = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """The 48-bit hash of each run of WIDTH code points; a text of fewer is one shingle, an empty one has none."""
    c = points.astype(np.uint64)
    if not len(c):
        return c
    if len(c) < WIDTH:
        powers = np.array([_power(i) for i in range(len(c), -1, -1)])
        return mix(np.array([(powers * np.append(np.uint64(len(c)), c)).sum()])) >> np.uint64(16)
    two = c[:-1] * _power(1) + c[1:]
    four = two[:-2] * _power(2) + two[2:]
    return mix(four[:-4] * _power(4) + four[4:]) >> np.uint64(16)


def sketch(text: str) -> tuple[int, np.ndarray]:
    """The limit and the kept hashes, rising, of a whole text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    fixed = _TOP // SCALE
    under, least = [], []
    for start in range(0, max(1, len(points) - WIDTH + 1), CHUNK):
        h = shingle_hashes(points[start : start + CHUNK + WIDTH - 1])
        under.append(h[h <= fixed])
        if sum(map(len, under)) < 4 * LEAST:  # repeats may still leave too few
            h = np.unique(h)
            least.append(h[: LEAST + 1])
    kept = np.unique(np.concatenate(under))
    if len(kept) >= LEAST:
        return fixed, kept
    if len(least) < len(under):  # many hashes but few distinct ones: look at all chunks again
        least = [np.unique(shingle_hashes(points[s : s + CHUNK + WIDTH - 1]))[: LEAST + 1] for s in range(0, len(points) - WIDTH + 1, CHUNK)]
    few = np.unique(np.concatenate(least))
    if len(few) <= LEAST:
        return _TOP, few
    return int(few[LEAST]) - 1, few[:LEAST]


def text_of(found: tuple[int, np.ndarray]) -> str:
    """A sketch as a string."""
    limit, kept = found
    digits = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return f"{limit:012x}" + digits.tobytes().hex()


def sketch_of(fingerprint: str) -> tuple[int, np.ndarray]:
    """The sketch that a string states."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    every = np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)
    return int(every[0]), every[1:]


def common(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, int, int]:
    """How many hashes up to the lower limit both hold, and each."""
    limit = np.uint64(min(a[0], b[0]))
    x, y = (s[1][: np.searchsorted(s[1], limit, side="right")] for s in (a, b))
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The estimated Jaccard similarity of the shingle sets; two empty texts are alike, an empty one is unlike all others."""
    both, x, y = common(a, b)
    return both / (x + y - both) if x + y else 1.0


def containment(a: str, b: str) -> Column:
    """The estimated share of a's shingles that b holds, of two fingerprint columns. An empty text is contained in all; null
    where either is null, or where a has no hash under the lower limit."""

    def of(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        one = sketch_of(x)
        if not len(one[1]):
            return 1.0
        both, n, _ = common(one, sketch_of(y))
        return both / n if n else None

    def run(batch: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([of(x, y) for x, y in zip(batch.to_pylist(), other.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(F.col(a), F.col(b))


def merged(prints: DataFrame, by: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """(by, limit, hash): the sketch of each group's texts together, a row for each hash, without one task for a group. A
    group of texts without shingles has one row whose hash is null."""
    limit = F.conv(F.substring(fingerprint, 1, DIGITS), 16, 10).cast("long")
    digits = F.col(fingerprint).substr(F.lit(DIGITS + 1), F.length(fingerprint))
    each = F.filter(F.split(digits, f"(?<=\\G.{{{DIGITS}}})"), lambda h: h != "")
    some = prints.where(F.col(fingerprint).isNotNull())
    lowest = some.groupBy(*by).agg(F.min(limit).alias("limit"), F.count("*").alias("n"))
    hashes = some.select(*by, F.explode(each).alias("h")).select(*by, F.conv("h", 16, 10).cast("long").alias("hash")).distinct()
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    met = lowest.join(hashes, same(lowest, hashes) or F.lit(True), "left").where("hash is null or hash <= `limit`")
    return met.select(*(lowest[c] for c in by), "limit", "hash")


def cut_points(keys: DataFrame) -> list[tuple]:
    """Keys that part the falling order into ranges of about RANGE_ROWS rows: a bounded sample, which sets balance alone."""
    n = keys.count()
    ranges = min(MOST_RANGES, n // RANGE_ROWS)
    if ranges < 2:
        return []
    sample = keys.sample(min(1.0, ranges * KEYS / n), seed=11).collect()  # KEYS rows a range
    order = sorted({placed(r["doc_id"], r["text_hash"]) for r in sample})
    return order[KEYS // 2 :: KEYS]


def placed(doc_id: int | None, text_hash: int) -> tuple:
    """The sort key of a document: falling ids, nulls last, then the text's hash."""
    return (doc_id is None, -(doc_id or 0), text_hash)


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text, range, after) of distinct documents: `after` marks a copy that only follows its range."""
    cuts = cut_points(docs.select("doc_id", "text_hash"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist())
            at = [bisect.bisect_right(cuts, placed(*k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["doc_id", "text_hash", "text", "range"])

    ranged = docs.mapInArrow(numbered, "doc_id long, text_hash long, text string, range int")
    keyed = docs.select("doc_id", "text_hash", F.lit(None).cast("string").alias("text")).mapInArrow(numbered, "doc_id long, text_hash long, text string, range int")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("falling"), "text_hash")).alias("head")
    heads = sorted(keyed.groupBy("range").agg(head).collect(), key=lambda r: r["range"])  # MOST_RANGES rows
    before = {r["range"]: heads[i - 1]["range"] for i, r in enumerate(heads)}  # the first of all follows the last
    rows = [(r["range"], before[r["range"]], None if r["head"]["none"] else ~r["head"]["falling"], r["head"]["text_hash"]) for r in heads]
    sent = docs.sparkSession.createDataFrame(rows, "of int, to int, first_id long, first_hash long")
    met = ranged.join(F.broadcast(sent), F.col("range") == F.col("of"))  # MOST_RANGES rows
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    seat = lambda r, after: F.struct(r.alias("range"), F.lit(after).alias("after"))
    seats = F.when(first, F.array(seat(F.col("range"), False), seat(F.col("to"), True))).otherwise(F.array(seat(F.col("range"), False)))
    return met.select("doc_id", "text_hash", "text", F.explode(seats).alias("s")).select("doc_id", "text_hash", "text", "s.range", "s.after")


OUT = ["doc_id", "text_hash", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of OUT for the sorted rows of `neighbours`."""
    last: tuple | None = None
    out: list[tuple] = []
    size = 0
    for batch in (part for whole in batches for part in by_bytes(whole, "text")):
        for doc_id, text_hash, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "after"))):
            own = sketch(text)
            if last is not None:
                i, h, before, found = last
                k = len(before) // 3
                changed = before[: len(before) - k] + text[:k]
                other = sketch(changed)
                out.append((i, h, len(before), hashlib.sha256(changed.encode()).hexdigest(), text_of(found), text_of(other), likeness(found, other), likeness(found, own)))
                size += len(out[-1][4]) + len(out[-1][5])
            last = None if after else (doc_id, text_hash, text, own)
            if size > 1 << 20:
                yield rows_of(out)
                out, size = [], 0
    if out:
        yield rows_of(out)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], OUT)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    A document's edited text has its last third of code points, rounded down, replaced by the first as many (or all) of the
    next document, by falling id; after the last comes the first, and a document alone is followed by itself. A null text
    is empty; an empty text has a fingerprint without hashes, alike to that of an empty text (1) and to no other (0). Null ids
    come last. Texts that share an id follow each other by their hash; rows that repeat both id and text are one document
    and get the same result. Equal texts have equal fingerprints. An empty table gives no rows; other columns are
    not read, so their names cannot clash."""
    steps = Steps(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), text.alias("text"))
    several = lambda *by: not own.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    repeated = several("doc_id")
    if repeated:  # else ids tell the texts apart
        own = own.withColumn("text_hash", F.xxhash64("text"))
        repeated = several("doc_id", "text_hash")
    once = own.dropDuplicates(["doc_id", "text_hash"]) if repeated else own
    if repeated:
        once = steps(once)
    met = neighbours(once)
    # ranges are many and small beside the partitions
    dealt = met.repartition("range").sortWithinPartitions("range", "after", F.col("doc_id").desc_nulls_last(), "text_hash")
    schema = "doc_id long, text_hash long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = dealt.select("doc_id", "text_hash", "text", "after").mapInArrow(edited_prints, schema)
    if repeated:
        names = [c for c in OUT if c not in ("doc_id", "text_hash")]
        counts = own.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
        key = F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).alias("key")  # null ids are equal as parts of a struct
        full = steps(found.join(counts.withColumnsRenamed({"doc_id": "of", "text_hash": "hash"}), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash"))).select(key, "n", *names))
        found = join_counted(own.select(key), full, "key").select(F.col("key.i").alias("doc_id"), *names)
    return found.select(F.col("doc_id").alias(id_col), *OUT[2:])


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
