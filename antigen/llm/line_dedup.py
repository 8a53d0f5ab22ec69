"""Operator 5, line dedup by winnowing over line hashes: DataFrame functions only.

Blank lines apart, a window is the lines from a place on that first hold `window_words` words together, or those up to a
place that last do. The least line hash of a window is its fingerprint, so every repeated run of so many words holds one
that stands at two places at least. Positions of such fingerprints are joined, and each is extended both ways, to all
windows around it: a window's lines are one key, its first place stays and the later ones go. Windows overlap, so
together they delete every line of a later repeated run, however long it is and whichever earlier place it repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.llm.common import WORD_PATTERN, Steps, join_counted, table

WINDOW_WORDS = 10


def line_arrays(docs: DataFrame, window_words: int) -> DataFrame:
    """(doc_id, text_hash, pos, words, code, code2) of a text's lines that hold a word, as arrays: the line number, the
    words (up to the window's) and two hashes of each."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            i.alias("pos"), F.least(F.regexp_count(x, F.lit(WORD_PATTERN)), F.lit(window_words)).alias("words"),
            F.xxhash64(x).alias("code"), F.xxhash64(F.lit("second"), x).alias("code2"),
        ),
    )
    kept = docs.select("doc_id", "text_hash", F.filter(lines, lambda x: x["words"] > 0).alias("l")).where(F.size("l") > 0)
    return kept.select("doc_id", "text_hash", "l.pos", "l.words", "l.code", "l.code2")


def lines_needed(words: Column, window_words: int) -> Column:
    """How many of the first counts in an array add up to the window's words; null if all do not."""
    step = lambda a, w: F.when(a["words"] >= window_words, a).otherwise(F.struct((a["words"] + w).alias("words"), (a["n"] + 1).alias("n")))
    found = F.aggregate(words, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), step)
    return F.when(found["words"] >= window_words, found["n"])


def windows(lines: DataFrame, window_words: int) -> DataFrame:
    """(doc_id, text_hash, start, stop, from, to, print, place, key1, key2) for each window: its lines among those that hold
    a word, their line numbers, its fingerprint and a hash of where that stands, and two hashes of all its lines."""
    size = window_words + 1  # a window has so many lines less one at most
    alone = lambda w: w >= window_words
    ahead = F.transform("words", lambda w, i: F.when(alone(w), i * size + 1).otherwise(i * size + lines_needed(F.slice("words", i + 1, window_words), window_words)))

    def behind(w: Column, i: Column) -> Column:
        first = F.greatest(i - (window_words - 1), F.lit(0))
        n = lines_needed(F.reverse(F.slice("words", first + 1, i - first + 1)), window_words)
        return F.when(alone(w), i * size + 1).otherwise((i - n + 1) * size + n)

    spans = F.array_compact(F.array_distinct(F.concat(ahead, F.transform("words", behind))))
    each = lines.select("*", F.explode(spans).alias("span"))
    start, n = F.floor(F.col("span") / size).cast("int"), F.pmod("span", F.lit(size)).cast("int")
    each = each.withColumn("start", start).withColumn("n", n)
    part = lambda c: F.slice(c, F.col("start") + 1, F.col("n"))
    each = each.select(
        "doc_id", "text_hash", "start", (F.col("start") + F.col("n")).alias("stop"), F.get("pos", F.col("start")).alias("from"), F.get("pos", F.col("start") + F.col("n") - 1).alias("to"),
        F.array_min(part("code")).alias("print"), F.array_position(part("code"), F.array_min(part("code"))).alias("at"),
        F.xxhash64(part("code")).alias("key1"), F.xxhash64(part("code2")).alias("key2"),
    )
    return each.withColumn("place", F.xxhash64("doc_id", "text_hash", F.col("start") + F.col("at"))).drop("at")


def repeated_lines(docs: DataFrame, steps: Steps, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, text_hash, gone): the first and last lines of the stretches that go, for documents that lose any."""
    every = steps(windows(steps(line_arrays(docs, window_words)), window_words))
    prints = every.groupBy("print").agg(F.count("*").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    prints = steps(prints.where("lo <> hi").select("print", "n"))
    found = steps(join_counted(every.drop("place"), prints, "print").drop("print", "n"))
    place = F.struct("doc_id", "text_hash", "start")
    first = steps(found.groupBy("key1", "key2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_counted(found, first, ["key1", "key2"]).where(~place.eqNullSafe(F.col("first")))
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    reached = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    later = later.select("doc_id", "text_hash", "start", "stop", "from", "to", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int").alias("new"))
    later = later.withColumn("stretch", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = later.groupBy("doc_id", "text_hash", "stretch").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return steps(whole.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """All columns of `docs`, the text without later repeated runs of lines, and n_lines and n_removed.

    A line goes if it stands in a run of lines, of `window_words` words or more, that also begins at an earlier place: a
    smaller (id, text hash, line); a null id comes before all. Blank lines neither match nor part a run, and go where
    the lines on both sides go. Rows that repeat both id and text are one document and get the same result. A null text
    stays null (no lines); an empty text has one blank line. A text whose lines all go becomes empty; its row stays. An
    empty table gives no rows. Input columns named n_lines or n_removed are replaced; no other name can clash."""
    steps = Steps(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.struct(*names).alias("row"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"))
    own = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text")).where("text is not null")
    gone = repeated_lines(own, steps, window_words).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "gone")
    both = keyed.join(gone, keyed["doc_id"].eqNullSafe(F.col("of")) & (keyed["text_hash"] == F.col("hash")), "left")
    text = F.col("row")[text_col]

    def without(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["to"] + 1))
        stops = F.concat(F.transform("gone", lambda g: g["from"]), F.array(F.size(lines)))
        rest = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["a"] < g["b"])
        return F.array_join(F.flatten(F.transform(rest, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"]))), "\n")

    # the text is split once, as the one item of a list
    kept = F.get(F.transform(F.array(F.split(text, "\n")), without), F.lit(0))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    removed = F.aggregate("gone", F.lit(0), lambda n, g: n + g["to"] - g["from"] + 1)
    return both.select(
        *(F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names),
        n_lines.alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)
