"""Operator 10, MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

The plan, each step a Spark job over all rows:

1. every text becomes its set of 5-word shingles, kept as size, two 64-bit digests and the 64 smallest hashes (the
   bottom-k sketch of one hash function); texts of equal sets form a class with its smallest id as representative;
2. the sketches' values are inverted. Lists of up to `LIST_SIZE` representatives give the overlap counts of their pairs;
3. values in longer lists are hot (large groups of near copies, passages that many texts share). A pair that the short
   lists can miss has most of its union in hot values, so both its texts have over `HOT_SHARE` of their sketches there.
   Such a text is first paired with the most central text of each of a few of its hot values, a star: of a group of near
   copies this leaves one component, with one comparison a text and value;
4. the estimate from the union's sketch discards hopeless pairs of 2 and 3, and the exact similarity of the full sets
   confirms the rest;
5. hot texts that share a hot value and are still in different components are compared in blocks, exactly: those outside a
   group's largest component with all others, never the large component with itself;
6. components of all confirmed links give the result.

A linked pair shares each value of its union's sketch with a chance of 0.75 at least. The bounds below are set so that one
pair in 10^9 or fewer is missed by any of them, which leaves other links to join its texts as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from antigen.llm.common import Steps, by_bytes, join_counted, table
from antigen.llm.components import connected_components
from antigen.llm.shingles import mix, shingle_sets

SKETCH = 64
LIST_SIZE = 40
#: Of 64 values, 24 or fewer are shared once in 4 * 10^9 linked pairs; two of them may lie in short lists.
HOT_SHARE, LEAST_ESTIMATE = 0.34, 24 / 64
#: Hot values by which texts meet: linked ones share each with a chance over 0.54, so all differ once in 6 * 10^10 links.
CHAIN = 32
#: Hot values whose central texts a text is compared with.
STARS = 6
#: Texts, and shingles on the average, of one block.
BLOCK, BLOCK_SHINGLES = 256, 200_000


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, d1, d2, sketch): set size, two digests of the set, its smallest hashes ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                sets = shingle_sets([None if t is None else t.encode() for t in batch.column("text").to_pylist()])
                d1 = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in (x.view(np.uint64) for x in sets)]
                d2 = [int(np.bitwise_xor.reduce(mix(x.view(np.uint64))).view(np.int64)) if len(x) else 0 for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(x) for x in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([x[:SKETCH] for x in sets], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch array<long>")


def estimated(a: str, b: str) -> F.Column:
    """The share of the union's sketch that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def comparable(a: str, b: str) -> F.Column:
    """Whether sets of such sizes can be linked at all."""
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def cold_pairs(postings: DataFrame) -> DataFrame:
    """(a, b) with a < b that share enough values of short lists."""
    short = postings.where(F.col("n") <= LIST_SIZE).select("value", "rep", "n_shingles")
    left, right = short.alias("l"), short.alias("r")
    return (
        left.join(right, (F.col("l.value") == F.col("r.value")) & (F.col("l.rep") < F.col("r.rep")))
        .where(comparable("l.n_shingles", "r.n_shingles"))
        .groupBy(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
        .agg(F.count("*").alias("overlap"), F.min(F.least("l.n_shingles", "r.n_shingles")).alias("smaller"))
        # of 64 values, a linked pair shares three of short lists or is hot; smaller sets are in the sketch whole
        .where((F.col("overlap") >= 3) | (F.col("smaller") < SKETCH)).select("a", "b")
    )


def star_pairs(pool: DataFrame, steps: Steps) -> DataFrame:
    """(a, b) of each hot text with the central text of its first hot values: the one with the largest share of hot ones."""
    own = pool.select("rep", "n_shingles", "share", F.explode(F.slice("few", 1, STARS)).alias("value"))
    heads = own.groupBy("value").agg(F.max_by(F.struct("rep", "n_shingles"), F.struct("share", -F.col("rep"))).alias("head"), F.count("*").alias("n"))
    heads = steps(heads.select("value", F.col("head.rep").alias("head"), F.col("head.n_shingles").alias("size"), "n"))
    pairs = join_counted(own, heads, "value")
    pairs = pairs.where((F.col("rep") != F.col("head")) & comparable("n_shingles", "size"))
    return pairs.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()


def promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    ra = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    rb = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(rb, "b").join(ra, "a").where(estimated("sa", "sb") >= LEAST_ESTIMATE).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= 75 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "ta", "tb"):
                sets = [shingle_sets([t.encode() for t in batch.column(c).to_pylist()]) for c in ("ta", "tb")]
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)])
                total = np.array([len(x) + len(y) for x, y in zip(*sets)])
                yield batch.select(["a", "b"]).filter(pa.array(100 * both >= 75 * (total - both)))

    tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def forest(ids: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ids that connect what a symmetric matrix of links connects, one less than texts at most."""
    unseen = np.ones(len(ids), bool)
    out = []
    for root in range(len(ids)):
        if not unseen[root]:
            continue
        unseen[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(links[at] & unseen)
            unseen[new] = False
            stack.extend(new.tolist())
            out.extend((int(ids[at]), int(ids[x])) for x in new)
    return out


def block_links(groups: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The groups that exact links between their texts join, as a forest over the texts."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    alone = new & np.concatenate([new[1:], [True]])  # what one text alone holds adds to no intersection
    owner, column = owner[~alone], np.cumsum(new[~alone]) - 1
    both = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 4096, 4096))
    for i, (start, stop) in enumerate(zip(edges, edges[1:])):  # counts below 2^24 are exact in single precision
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[start:stop], column[start:stop] - 4096 * i] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets], np.float64)
    links = 100.0 * both >= 75.0 * (size[:, None] + size[None, :] - both)
    links &= groups[:, None] != groups[None, :]
    return forest(groups, links)


def unresolved(pool: DataFrame, components: DataFrame, steps: Steps) -> DataFrame | None:
    """(rep, n_shingles, component, grp, outside) for the hot texts whose hot values reach more than one component.
    Components that values connect form a group; texts outside its largest component are marked."""
    own = pool.join(components, F.col("rep") == F.col("id"), "left").select("rep", "n_shingles", "few", F.coalesce("component", "rep").alias("component"))
    own = steps(own)
    values = steps(own.select("component", F.explode("few").alias("value")).distinct())
    heads = steps(values.groupBy("value").agg(F.min("component").alias("head"), F.count("*").alias("n")).where("n > 1"))
    chains = steps(join_counted(values, heads, "value").where("component <> head").select(F.col("head").alias("a"), F.col("component").alias("b")).distinct())
    if chains.isEmpty():
        return None
    groups = connected_components(chains).select(F.col("id").alias("component"), F.col("component").alias("grp"))
    sizes = own.groupBy("component").agg(F.count("*").alias("n")).join(groups, "component")
    largest = sizes.groupBy("grp").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"))
    known = steps(sizes.join(largest, "grp").select("component", "grp", (F.col("component") != F.col("largest")).alias("outside"), "n"))
    return steps(join_counted(own.select("rep", "n_shingles", "component"), known, "component").drop("n"))


def block_edges(left: DataFrame, texts: DataFrame, steps: Steps) -> DataFrame:
    """(a, b): components of `left` that links between their texts join, as forests of blocks.

    A band holds sizes within 4/3, so only equal and neighbouring bands meet. Texts outside a group's largest component
    meet all texts of the group there; those inside meet these only. Blocks of large sets hold fewer texts."""
    size = F.col("n_shingles").cast("double")
    # a code is the band twice, plus whether a text is within the largest component
    own = left.withColumn("code", 2 * F.floor(F.log(size) / F.log(F.lit(4 / 3))) + F.when(F.col("outside"), 0).otherwise(1))
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_SHINGLES)) / F.avg("n_shingles")))
    counts = own.groupBy("grp", "code").agg(F.count("*").alias("k"), F.ceil(F.count("*") / room).alias("blocks"))
    entries = F.map_from_entries(F.collect_list(F.struct("code", "blocks"))).alias("blocks")  # two a band
    counts = steps(counts.groupBy("grp").agg(entries, F.sum("k").alias("n")))
    dealt = join_counted(own, counts, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")[F.col("code")]))
    inside, first = F.col("code") % 2, F.col("code") - F.col("code") % 2 - 2
    partners = F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: first + i), lambda c: F.col("blocks")[c].isNotNull() & ~((inside == 1) & (c % 2 == 1)))
    met = dealt.withColumn("partners", partners).withColumn("with_code", F.explode("partners"))
    met = met.withColumn("with_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks")[F.col("with_code")] - 1)))
    seat = lambda c, b: F.col(c) * F.lit(1 << 40) + F.col(b)
    one, other = seat("code", "block"), seat("with_code", "with_block")
    seated = met.select("grp", "rep", "component", F.least(one, other).alias("i"), F.greatest(one, other).alias("j"))

    def link(t: pa.Table) -> pa.Table:
        sets = shingle_sets([x.encode() for x in t.column("text").to_pylist()])
        edges = block_links(t.column("component").to_numpy(), sets)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return seated.join(texts.select("rep", "text"), "rep").groupBy("grp", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer than five gives its whole sequence as one
    shingle. Texts are linked where 100 * |intersection| >= 75 * |union|; component_id is the smallest id that links
    reach, and `kept` marks it. Null, empty and wordless texts have an empty set and link with nothing, so they are
    kept. Rows with a null id have a null component and are kept; they link nothing. Rows that share an id are one
    document: what links to one of them links to all. Ties don't matter, as the result doesn't depend on which text
    represents a class. An empty table gives no rows; other columns are not read, so their names cannot clash."""
    steps = Steps(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = steps(sketches(own.withColumn("text_hash", F.xxhash64("text"))))
    classes = (
        found.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sketch", "text_hash"), "doc_id").alias("of"))
        .select("n_shingles", "d1", "d2", "rep", "of.sketch", "of.text_hash")
    )
    classes = steps(classes)
    values = classes.select("rep", "n_shingles", F.explode("sketch").alias("value"))
    lists = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    postings = steps(join_counted(values, steps(lists), "value"))

    # linked texts share over half of their hot values, so each one's smallest few suffice to meet
    few = F.slice(F.sort_array(F.collect_list("value")), 1, CHAIN).alias("few")
    shares = postings.where(F.col("n") > LIST_SIZE).groupBy("rep", "n_shingles").agg(F.count("*").alias("n_hot"), few)  # a sketch's rows
    share = F.col("n_hot") / F.least("n_shingles", F.lit(SKETCH))
    pool = steps(shares.withColumn("share", share).where(F.col("share") >= HOT_SHARE).select("rep", "n_shingles", "share", "few"))
    pairs = steps(promising(cold_pairs(postings).union(star_pairs(pool, steps)).distinct(), classes))
    steps.forget(postings)

    needed = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(pool.select("rep")).distinct()
    needed = needed.join(classes, "rep").select("rep", "text_hash")
    texts = own.join(needed, (own["doc_id"] == needed["rep"]) & (F.xxhash64("text") == needed["text_hash"]))
    texts = steps(texts.groupBy("rep", "text_hash").agg(F.first("text").alias("text")))
    links = steps(confirmed(pairs, texts))
    components = connected_components(links)
    reached = F.coalesce("component", "rep").alias("reached")
    ids = classes.select("n_shingles", "d1", "d2", "rep").join(components, F.col("rep") == F.col("id"), "left").select("n_shingles", "d1", "d2", reached)
    left = unresolved(pool, components, steps)
    if left is not None:
        more = connected_components(steps(block_edges(left, texts, steps)))
        ids = ids.join(more, F.col("reached") == F.col("id"), "left").select("n_shingles", "d1", "d2", F.coalesce("component", "reached").alias("reached"))
    steps.forget(texts, pairs, pool)

    keyed = found.select("doc_id", "n_shingles", "d1", "d2")
    out = keyed.join(ids, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that stay when one of each group of near duplicates does: the one with
    the smallest id, a null id first, then the smallest text hash.

    Texts are told apart by id and text together, so an id that occurs with two texts loses none for the other's sake.
    Of rows that repeat both, one stays, by the least hash of all columns; null, empty and wordless texts link with
    nothing, and all their rows stay. An empty table gives no rows, and no column name can clash."""
    steps = Steps(docs.sparkSession)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    rows = keyed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = steps(rows.withColumn("key", F.col("doc_id").cast("long")))
    unique = rows.where("key is null").isEmpty() and rows.groupBy("key").count().where("count > 1").isEmpty()
    if not unique:  # an id of several texts, or none
        rows = steps(rows.withColumn("key", F.xxhash64("doc_id", "text_hash")))
    same = (keyed["doc_id"].eqNullSafe(F.col("of"))) & (keyed["text_hash"] == F.col("hash"))
    names = lambda df, *more: df.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), *more)
    asked = keyed.select("doc_id", "text") if unique else keyed.join(names(rows, "key"), same).select(F.col("key").alias("doc_id"), "text")
    found = steps(near_duplicates(asked).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct())
    member = rows.join(found, "key")
    least = F.min(F.struct(F.col("doc_id"), F.col("text_hash"))).alias("first")  # a null id comes first
    first = steps(member.groupBy("component_id").agg(least, F.count("*").alias("n")).where("n > 1"))
    gone = steps(join_counted(member.drop("n"), first, "component_id").where("not (doc_id <=> first.doc_id and text_hash = first.text_hash)"))
    kept = keyed.join(names(gone), same, "left_anti")
    again = steps(names(rows.where("n > 1").join(found, "key", "left_semi")))
    if not again.isEmpty():
        twice = kept.join(again, same, "left_semi").withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64("row"))))
        kept = kept.join(again, same, "left_anti").unionByName(twice.where("at = 1").drop("at"))
    return kept.select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
