"""Operator 6, mixing sources to target weights: DataFrame functions only.

Each source's words, in a fixed pseudorandom order of its documents, form a stream that is cut into blocks of `block_words`.
The output is shards of `shard_blocks` slots, a block each. For every shard the counts of its sources are drawn, as a
multinomial draw of its slots by the targets' shares; the last shards give and take slots until each source has as many as
its target needs. A source's slots, numbered over all shards, go through its blocks in passes, each pass by an affine
permutation of its own, and slots meet blocks by index. The last slot's block is cut, so that targets are met to half a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.llm.common import WORD_PATTERN, Steps, table

#: Weights of the sources in code point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: A source gives each word so many times at most.
MOST = 3
BLOCK_WORDS = 1024
SHARD_BLOCKS = 1024
#: Cells of the shares from 0 to 1, by which slots meet the sources whose share they fall into.
CELLS = 4096
#: Primes over any count of blocks of one source (fixed values); powers of them are the multipliers of the block orders.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)
#: Powers are up to this.
POWERS = 64


def words_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size). The sizes' sum is shared by weight; a target stops at `most`
    times its source's size and the excess is shared anew. Sources by what they can give for their weight: those that
    stop come first, so one running sum finds them. One row a source, so the unpartitioned windows stay small."""
    every = Window.partitionBy()
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every)
    s = s.select(
        "*", total.alias("total"), F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    stops = F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= (F.col("total") - F.col("cap_before")) * F.col("weight")
    s = s.withColumn("stops", stops)
    rest = F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(every)
    share = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(rest.cast("double") * F.col("weight") / open_weight)
    return s.select("source", "source_size", "weight", share.alias("target"))


def place(docs: DataFrame, rows: int) -> DataFrame:
    """Adds each row's `start` within its source's stream. Rows of a source are dealt to about sqrt(rows) parts; sums
    of the parts and running sums within them give the offsets, so no task holds a whole source."""
    parts = max(1, round(rows**0.5))
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)))
    sums = dealt.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "part").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (
        dealt.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
        .withColumn("start", F.col("offset") + F.col("inner")).drop("of", "at", "offset", "inner", "part")
    )


def needs(quotas: DataFrame, block_words: int) -> DataFrame:
    """(source, source_size, quota, blocks, last, n): how many blocks each source gives, with repeats. A pass opens with
    the source's short last block, so that only the last draw is cut."""
    q = quotas.where("source_size > 0").select(
        "source", "source_size", F.round("target").cast("long").alias("quota"),
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
    )
    last = F.col("source_size") - (F.col("blocks") - 1) * block_words
    q = q.withColumn("last", last).withColumn("passes", F.floor(F.col("quota") / F.col("source_size")))
    left = F.col("quota") - F.col("passes") * F.col("source_size")
    extra = F.when(left == 0, 0).when(left <= F.col("last"), 1).otherwise(1 + F.ceil((left - F.col("last")) / block_words))
    return q.withColumn("n", F.col("passes") * F.col("blocks") + extra).where("n > 0").drop("passes")


def shard_counts(needed: DataFrame, shard_blocks: int, steps: Steps) -> DataFrame:
    """(source, shard, count, before): the slots of each source in each shard, and in the shards before.

    A slot's hash falls into the share of a source, which makes the counts of a shard multinomial; slots meet shares in
    cells, so that neither has to be in one task. A source keeps its first n slots in the order of the shards. What is
    over, in the last ones, goes to the sources that have too few, in their order."""
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    upto = F.sum("n").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    shares = steps(needed.select("source", "n", ((upto - F.col("n")) / total).alias("lo"), F.when(upto == total, 1.0).otherwise(upto / total).alias("hi"), total.alias("total")))  # a row a source
    slots = shares.agg(F.first("total").alias("total"), F.ceil(F.first("total") / shard_blocks).alias("shards")).where("total > 0")
    slots = slots.select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).repartition("shard")
    slots = slots.select("shard", F.explode(F.sequence(F.col("shard") * shard_blocks, F.least((F.col("shard") + 1) * shard_blocks, "total") - 1)).alias("slot"))
    drawn = F.pmod(F.xxhash64(F.lit("slot"), "slot"), F.lit(1 << 52)) / float(1 << 52)
    slots = slots.withColumn("u", drawn).withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))))).select("source", "lo", "hi", "cell")
    met = slots.join(cells.hint("merge"), "cell").where("u >= lo and u < hi")
    counts = steps(met.groupBy("source", "shard").agg(F.count("*").alias("count")))

    same = lambda a, b: a.eqNullSafe(b)
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    n_of = shares.select(F.col("source").alias("of"), "n")
    known = counts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).join(n_of, same(F.col("source"), F.col("of"))).drop("of")
    kept = F.greatest(F.least("count", F.col("n") - F.col("before")), F.lit(0))
    known = steps(known.select("source", "shard", kept.alias("kept"), (F.col("count") - kept).alias("over")))
    # the slots that are over: few, and in the last shards
    over = known.where("over > 0").groupBy("shard").agg(F.sum("over").alias("over"))
    ends = F.sum("over").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    over = over.select("shard", (ends - F.col("over")).alias("a"), ends.alias("b"))
    has = known.groupBy("source").agg(F.sum("kept").alias("has")).select(F.col("source").alias("of"), "has")
    lacks = shares.join(has, same(F.col("source"), F.col("of")), "left").select("source", (F.col("n") - F.coalesce("has", F.lit(0))).alias("lack")).where("lack > 0")
    ends = F.sum("lack").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    lacks = lacks.select("source", (ends - F.col("lack")).alias("c"), ends.alias("d"))
    moved = over.join(lacks, (F.col("a") < F.col("d")) & (F.col("c") < F.col("b"))).select("source", "shard", (F.least("b", "d") - F.greatest("a", "c")).alias("count"))
    final = known.select("source", "shard", F.col("kept").alias("count")).union(moved).groupBy("source", "shard").agg(F.sum("count").alias("count")).where("count > 0")
    return steps(final.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))))


def draws(quotas: DataFrame, steps: Steps, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source, shard, draw, pass, block, take): every slot that a source fills, with the words that it takes of its block."""
    needed = steps(needs(quotas, block_words))
    counts = shard_counts(needed, shard_blocks, steps)
    own = needed.select(F.col("source").alias("of"), "source_size", "quota", "blocks", "last")
    d = counts.join(own, F.col("source").eqNullSafe(F.col("of"))).repartition("source", "shard")  # at most shard_blocks slots a row
    d = d.withColumn("draw", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)))
    d = d.withColumn("pass", F.floor(F.col("draw") / F.col("blocks"))).withColumn("k", F.col("draw") % F.col("blocks"))
    seed = lambda *x: F.xxhash64(F.lit("mix"), F.col("source"), *x)
    pick = lambda name, n: F.pmod(seed(F.col("pass"), F.lit(name)), F.lit(n))
    others = F.greatest(F.col("blocks") - 1, F.lit(1))
    # a power of a prime over the count of blocks, which has no divisor in common with it
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (pick("prime", len(PRIMES)) + 1).cast("int")) % others
    powers = F.sequence(F.lit(1), pick("power", POWERS).cast("int") + 1)
    d = d.withColumn("others", others).withColumn("step", F.aggregate(powers, F.lit(1).cast("long"), lambda x, _: x * prime % others))
    offset = F.pmod(seed(F.col("pass"), F.lit("offset")), F.col("others"))
    block = F.when(F.col("k") == 0, F.col("blocks") - 1).otherwise((F.col("k") * F.col("step") + offset) % F.col("others"))
    begun = F.col("pass") * F.col("source_size") + F.when(F.col("k") == 0, 0).otherwise(F.col("last") + (F.col("k") - 1) * block_words)
    length = F.when(F.col("k") == 0, F.col("last")).otherwise(block_words)
    return d.select("source", "shard", "draw", "pass", block.alias("block"), F.least(length, F.col("quota") - begun).alias("take"))


def taken_pieces(placed: DataFrame, drawn: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, start, shard, draw, pass, word, words): what each draw takes of each document, from its word `word` on."""
    pieces = placed.where("size > 0").select(
        "source", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("index"),
    )
    base = F.col("index") * block_words
    pieces = pieces.select(
        F.col("source").alias("of"), "start", "index",
        F.greatest(F.col("start") - base, F.lit(0)).alias("lo"), F.least(F.col("start") + F.col("size") - base, F.lit(block_words)).alias("hi"),
        F.greatest(base - F.col("start"), F.lit(0)).alias("word"),
    )
    # the planner takes the unfolded draws for as small as the sources that they come from
    met = pieces.join(drawn.hint("merge"), F.col("of").eqNullSafe(F.col("source")) & (F.col("index") == F.col("block")))
    words = F.least("hi", "take") - F.least("lo", "take")
    return met.select("source", "start", "shard", "draw", "pass", "word", words.alias("words")).where("words > 0")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, text_hash, size). A text's hash tells rows of one id apart."""
    return docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.xxhash64(docs[text_col]).alias("text_hash"), words_of(docs[text_col]).alias("size")
    )


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed rows, targets and draws."""
    rows = steps(sized(docs, id_col, text_col, source_col))
    quotas = steps(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    return steps(place(rows, rows.count())), quotas, draws(quotas, steps)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row: how many of its words the mix takes, with repeats.

    The size is the count of `[^\\x20\\x09-\\x0D]+`; null and blank texts have size 0 and give nothing. A null source is a
    source of its own, the last in order. Rows with equal ids and texts are taken apart like any others; a null id is
    kept. An empty table gives no rows. Other columns are not read. Reruns agree: order, passes and shards come from
    hashes of ids, texts and sources alone."""
    placed, quotas, drawn = plan(docs, id_col, text_col, source_col, Steps(docs.sparkSession))
    taken = taken_pieces(placed, drawn).groupBy("source", "start").agg(F.sum("words").alias("taken"))
    taken = taken.select(F.col("source").alias("s"), F.col("start").alias("b"), "taken")
    q = quotas.select(F.col("source").alias("q"), "source_size", "target")
    out = placed.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.when(F.col("size") > 0, F.col("start")) == F.col("b")), "left")
    out = out.join(q, F.col("source").eqNullSafe(F.col("q")))
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row with all of the document's columns for each pass that takes words of it, its text reduced
    to the words taken, joined by blanks (or left as it is, where all are taken). A document that gives no word goes.

    Null, empty and blank texts give no words. A null source is a source of its own, the last in order; null ids are kept.
    Rows with equal ids, texts and sources have places of their own in the stream, in the order of a hash of all columns.
    An empty table gives no rows. No column name can clash."""
    steps = Steps(docs.sparkSession)
    placed, _, drawn = plan(docs, id_col, text_col, source_col, steps)
    parts = taken_pieces(placed, drawn).groupBy("source", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("word", "words"))).alias("parts"), F.sum("words").alias("n"))
    parts = parts.select(F.col("source").alias("s"), F.col("start").alias("b"), "pass", "parts", "n")
    found = placed.where("size > 0").join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("b")))
    alike = Window.partitionBy("doc_id", "text_hash", "source")
    found = found.withColumn("copy", F.dense_rank().over(alike.orderBy("start")))
    found = steps(found.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.col("source").alias("s"), "copy", "parts", "n", "size"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[source_col].alias("source"))
    match = keyed["doc_id"].eqNullSafe(F.col("i")) & (keyed["text_hash"] == F.col("h")) & keyed["source"].eqNullSafe(F.col("s"))
    if not placed.where("size > 0").groupBy("doc_id", "text_hash", "source").count().where("count > 1").isEmpty():
        keyed = keyed.withColumn("number", F.row_number().over(alike.orderBy(F.xxhash64("row"))))
        match = match & (F.col("number") == F.col("copy"))
    text = F.col("row")[text_col]
    cut = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))), lambda words: F.flatten(F.transform("parts", lambda p: F.slice(words, (p["word"] + 1).cast("int"), p["words"].cast("int")))))
    whole = F.when(F.col("n") == F.col("size"), text).otherwise(F.array_join(F.get(cut, F.lit(0)), " "))
    return keyed.join(found, match).select(*(whole.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
