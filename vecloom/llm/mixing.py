"""Mixing sources to target weights by weighted fair queueing.

Each source sends its shuffled documents, again and again where its target is
above its size. A copy's virtual time is the words its source has sent when half
of the copy is sent, divided by the source's target. All copies stand in the order
of virtual time and the queue is cut where the total budget is reached. The place
of the cut is found by ranges: sums of 1,024 ranges a unit of time, then of 4,096
parts of the one that it falls into; only that part's copies are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Equal ranges of the shuffle order in which running sums are taken; a range is read by one task.
RANGES = 4096
#: Ranges of a unit of virtual time (at 1 every source has sent its target), units of time before the last range, which holds all that is later, and parts of a range.
TIME_RANGES, TIME_UNITS, PARTS = 1024, 8, 4096


def targets(sizes: DataFrame, most: float) -> DataFrame:
    """(source, source_size, target) from a row a source (source, source_size, weight).

    The targets share the sum of all sizes by weight; none is above `most` times its
    source's size, and what is above goes to the others by weight, until none is.
    With sources ordered by size over weight, those up to some point are at their
    bound and the others share the rest, so one window over the sources finds it.
    """
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "source")
    through = ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = ratio.rowsBetween(1, Window.unboundedFollowing)
    total = Window.partitionBy()
    w = sizes.withColumn("all", F.sum("source_size").over(total))
    w = w.withColumn("bound", most * F.col("source_size")).withColumn("kept", F.sum("bound").over(through) - F.col("bound"))
    w = w.withColumn("open", F.col("weight") + F.coalesce(F.sum("weight").over(after), F.lit(0)))
    # the share of a unit of weight when this source and those after it share what those before leave
    w = w.withColumn("unit", (F.col("all") - F.col("kept")) / F.col("open"))
    w = w.withColumn("unit", F.max(F.when(F.col("unit") * F.col("weight") <= F.col("bound"), F.col("unit"))).over(total))
    return w.select("source", "source_size", F.least("bound", F.coalesce("unit", F.lit(float("inf"))) * F.col("weight")).cast("double").alias("target"))


def _key(c: Column) -> Column:
    """A source as a text that isn't null."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def _cut(copies: DataFrame, place: Column, left: DataFrame) -> DataFrame:
    """Of copies (size, time) with a place in the queue, those of the place at which the words of `left` (one row) are used up, with what of them is left for it; none if they aren't."""
    at = copies.withColumn("place", place)
    sums = at.groupBy("place").agg(F.sum("size").alias("words"))
    through = F.sum("words").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.withColumn("through", through).crossJoin(F.broadcast(left)).where("through >= left")
    last = sums.agg(F.min_by(F.struct("place", (F.col("left") - F.col("through") + F.col("words")).alias("left")), "place").alias("cut")).where("cut IS NOT NULL").select("cut.*")
    return at.join(F.broadcast(last), "place").drop("place")


def weighted_mix(docs: DataFrame, weights: DataFrame, most: int = 3, seed: int = 0) -> DataFrame:
    """Add source_size, target and taken to docs (doc_id, source, size); the budget is the sum of all sizes.

    weights has one row a source: source, weight; a source without one weighs 1. taken
    is size times the copies that the mix takes, at most `most`. A null source is a
    source. Documents of size 0 are taken with 0 words. Repeated rows count as often
    as they come. The order depends on doc_id, source and size alone, so reruns agree.
    Columns of docs named as those added are replaced; others stay, whatever their
    names. docs is read several times. An empty table stays empty.
    """
    added = ("source_size", "target", "taken")
    row = F.struct(*(docs[c] for c in docs.columns if c not in added))
    d = docs.select(row.alias("row"), F.col("doc_id").alias("id"), _key(F.col("source")).alias("source"), F.col("size").cast("long").alias("size"))
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = weights.select(_key(F.col("source")).alias("source"), "weight")
    goal = targets(sums.join(known, "source", "left").select("source", "source_size", F.coalesce("weight", F.lit(1)).alias("weight")), float(most))
    d = d.withColumn("turn", F.xxhash64("id", F.lit(seed), "size"))
    d = d.withColumn("range", F.floor((F.col("turn").cast("double") + 2.0**63) / 2.0**64 * RANGES).cast("int"))
    # words of a source before each range: sums of ranges, then one short window a source
    part = d.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")).join(goal, "source")
    inside = Window.partitionBy("source", "range").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("sent", F.sum("size").over(inside)).join(base, ["source", "range"])
    middle = F.col("base") + F.col("sent") - F.col("size") / 2
    d = d.withColumn("times", F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (middle + e * F.col("source_size")) / F.col("target"))))

    copies = d.select("id", "size", F.explode("times").alias("time"))
    slot = F.least(F.floor(F.col("time") * TIME_RANGES), F.lit(TIME_RANGES * TIME_UNITS))
    tail = _cut(copies, slot, sums.agg(F.sum("source_size").alias("left")))
    tail = _cut(tail.drop("left"), F.floor((F.col("time") * TIME_RANGES - slot) * PARTS), tail.agg(F.max("left").alias("left")))
    queue = F.sum("size").over(Window.partitionBy().orderBy("time", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tail = tail.withColumn("queue", queue)
    end = tail.agg(F.max(F.when(F.col("queue") - F.col("size") / 2 <= F.col("left"), F.col("time"))).alias("inside"), F.min("time").alias("first"))
    # without a cut all copies are taken
    end = end.select(F.coalesce("inside", F.col("first") - 1e-9, F.lit(float("inf"))).alias("until"))
    d = d.crossJoin(F.broadcast(end))
    n = F.size(F.filter("times", lambda t: t <= F.col("until")))
    taken = F.coalesce(F.col("size") * F.when(F.col("size") > 0, n), F.lit(0)).cast("long")
    return d.select("row", "source_size", "target", taken.alias("taken")).select("row.*", "source_size", "target", "taken")


def cycled_weights(docs: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh the values of the cycle in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    return docs.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, cycle)), n + 1).alias("weight"))


def word_count(text: str = "text"):
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every document.

    A null or empty text has size 0 and is taken with 0 words; a null source is a
    source of its own, the last. Repeated rows and null doc_ids count as they come;
    equal places in a source's order go by doc_id and size. Other columns are ignored.
    No rows give no rows.
    """
    # words are counted once; what follows reads this small table
    docs = Scratch(spark).cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")))
    return weighted_mix(docs, cycled_weights(docs, (1, 2, 3))).select("doc_id", "size", "source_size", "target", "taken", "source")
