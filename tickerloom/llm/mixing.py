"""Mixing sources to target weights by nested hash thresholds.

Every row gets a fixed 60-bit hash of its id and text. Sizes are summed by source and by the
hash's next ten bits; the running sum over at most 1,024 buckets of a source shows
in which one its budget ends, and only rows of that boundary bucket are summed
again, by the following ten bits, until all 60 are used. A row is then taken one
time more if its hash lies below its source's threshold: a filter, with no sort of
rows, and thresholds of growing budgets are nested. Rows meet a table with one row for each
source, and nothing else, so texts need not move. DataFrame functions only.

Defined results: a null or wordless text has size 0 and is taken 0 words; a null
source is a source of its own, last in order; a null id hashes as the text ``null``;
rows of a source that share id and text are taken together; a source whose budget ends inside such a
group takes it if at least half of it fits; sources that differ in case alone are different; a
text of any length is counted whole; an empty table gives no rows; extra columns, whatever their
names, are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.llm.common import WORD, free_names, written

#: Most often that a document is taken.
MOST = 3
LEVELS, BITS = 6, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of the md5 of id and text: rows that share an id, or have none, still differ by their texts."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A text that tells null from every source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``: their place by code point, from 0, null last. No task sees more than its range."""
    order = F.col("source").asc_nulls_last()
    placed = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("id", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task at most
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(counts.select("part", before.alias("before"))), part == F.col("part")).select(*sources.columns, (F.col("before") + F.col("id") - F.shiftleft("part", 33)).alias("number"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """key, source, source_size -> with target: shares of all words by the weights 1, 2, 3, repeating,
    none above ``most`` times its source.

    What sources can't take is shared anew among the others by weight. That raises the level, the words for
    a weight of 1, and may fill further sources, until none is filled anew.
    """
    ranked = written(numbered(sizes).withColumn("weight", F.col("number") % 3 + 1), "mix-weights")
    cap = F.col("source_size") * F.lit(most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, filled = 0.0, -1
    while True:
        full = cap < F.lit(level) * F.col("weight")
        n, given, weights = ranked.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == filled or not weights:
            break
        level, filled = (total - (given or 0)) / weights, n
    return ranked.select("key", "source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def thresholds(slim: DataFrame, most: int = MOST) -> DataFrame:
    """``slim`` (key, size, hash) -> for each source: key, source_size, target, whole (times that every row is
    taken), cut (the hash up to which rows are taken once more; null for none) and edge (whether the row at it is)."""
    sizes = slim.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("source", F.when(F.col("key") != "n", F.expr("substring(key, 2)")))
    plan = written(
        targets(sizes, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-plan",
    )
    edge = _boundary(slim.groupBy("key", _prefix(1).alias("bucket")).agg(F.sum("size").alias("size")).join(plan.select("key", F.col("budget").alias("left")), "key"))
    for level in range(2, LEVELS + 1):
        above = edge.select("key", F.col("prefix").alias("above"), "left")
        inside = slim.withColumn("above", _prefix(level - 1)).join(above, ["key", "above"]).select("key", "size", "hash", "left")
        if level == 2:  # the rest of the way looks at about a row of 1,024
            inside = written(inside, "mix-boundary")
            slim = inside.drop("left")
        edge = _boundary(inside.groupBy("key", "left", _prefix(level).alias("bucket")).agg(F.sum("size").alias("size")))
    return written(plan.join(edge.select("key", F.col("prefix").alias("cut"), (F.col("size") <= 2 * F.col("left")).alias("edge")), "key", "left").select("key", "source_size", "target", "whole", "cut", "edge"), "mix-cut")


def _prefix(level: int) -> Column:
    """The hash's first bits."""
    return F.shiftright("hash", 60 - BITS * level)


def _boundary(sums: DataFrame) -> DataFrame:
    """key, bucket, size, left -> the bucket in which ``left`` ends, as ``prefix``, its size, and what is left at its lower end.

    Past the last bucket with rows, the threshold lies at that bucket and the budget may exceed its size.
    """
    order = W.partitionBy("key").orderBy("bucket")
    run = sums.select("*", (F.sum("size").over(order) - F.col("size")).alias("before"))
    run = run.select("*", F.lead("before").over(order).alias("next"))
    here = (F.col("before") <= F.col("left")) & (F.col("next").isNull() | (F.col("next") > F.col("left")))
    return run.where(here).select("key", (F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("prefix"), "size")


def times_taken(hashed: Column, plan: Column) -> Column:
    """How often a row is taken whose source has ``plan``: a struct of whole, cut and edge."""
    below = (hashed < plan["cut"]) | ((hashed == plan["cut"]) & plan["edge"])
    return plan["whole"] + F.coalesce(below, F.lit(False)).cast("int")


def slim_rows(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-sizes")


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, source, text) -> doc_id, size, source_size, target, taken, copies."""
    slim = slim_rows(docs)
    met = slim.join(thresholds(slim.drop("doc_id"), most), "key").withColumn("copies", times_taken(F.col("hash"), F.struct("whole", "cut", "edge")))
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    key, copies = free_names(docs, "key", "copies")
    cuts = thresholds(slim_rows(docs).drop("doc_id"), most).select(F.col("key").alias(key), F.struct("whole", "cut", "edge").alias(copies))
    times = docs.withColumn(key, source_key(F.col("source"))).join(cuts, key).withColumn(copies, times_taken(row_hash(F.col("doc_id"), F.col("text")), F.col(copies)).cast("int"))
    return times.where(F.col(copies) > 0).withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)
