"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame operations only.

The mix is a sequence of slots of equally many words. The golden-ratio point of a slot, mapped through the cumulative
targets, names its source, and the slot's rank among those of the source names a block: the words
[rank * block, (rank + 1) * block) of the source's documents, which are laid end to end in a shuffled order, again and
again, at most ``most`` times. Joining slots with blocks gives the pieces of documents that make up the mix. Golden-ratio
points give a source its share of slots within a few (CLOSING, which bounds what was counted up to 10 million points). So a
source's last slots, CLOSING at most, are trimmed to its target in whole words, or as many are added after the schedule's
end: the schedule decides what is taken and when, and small sources reach their targets whatever the length of a block.

Targets: sources in order (by code point, null last) weigh the given weights, repeating, and share all words; a target
stops at ``most`` times the size of its source, and the excess is shared out by weight until none is above.

Defined results: a null text has size 0; such documents, and empty ones, are taken 0 words. A source without words has
target 0. Rows with one key are different documents; extra columns pass through ``taken_words`` (names that begin with
``mix_`` are its own). The shuffle is by hash, so reruns agree.

Scale: running totals are taken inside up to CHUNKS parts of a source and carried on over the parts, so no window holds
a whole source. What has a row a source is broadcast up to MOST_SOURCES sources and joined by shuffles beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, stored

GOLDEN, GRID, CHUNK_BITS, SLOT_CHUNK, MOST_SOURCES = 0.6180339887498949, 4096, 12, 4096, 100_000
SHORTEST, LONGEST, SLOTS, CLOSING = 16, 4096, 1_000_000, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string that sorts like the source by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """mix_key, source_size and target of each source. sizes: mix_key, size."""
    order = Window.orderBy("mix_key")
    by_room = Window.orderBy("room", "mix_key")
    everything = Window.partitionBy(F.lit(0))
    total = sizes.groupBy("mix_key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = total.withColumn("weight", weight).withColumn("room", most * F.col("source_size") / F.col("weight"))
    # from the least room on: what a unit of weight gets if all sources before this one are full
    full = F.coalesce(F.sum(most * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = table.withColumn("unit", (F.sum("source_size").over(everything) - full) / left)
    unit = F.max(F.when(F.col("room") > F.col("unit"), F.col("unit"))).over(everything)
    room = (most * F.col("source_size")).cast("double")
    return table.withColumn("target", F.coalesce(F.least(room, unit * F.col("weight")), room)).select("mix_key", "source_size", "target")


def _small(df: DataFrame, few: bool) -> DataFrame:
    """A table with about a row a source, to be broadcast if those are few."""
    return F.broadcast(df) if few else df


def schedule(sources: DataFrame, slots: int, few: bool = True) -> DataFrame:
    """mix_slot, mix_key and mix_rank (from 0, among the slots of the source) of each slot. sources: mix_key, low, high (cumulative shares)."""
    spark = sources.sparkSession
    cell = F.least(F.floor(F.col("point") * GRID), F.lit(GRID - 1)).cast("long")
    points = spark.range(slots).withColumnRenamed("id", "mix_slot").withColumn("point", F.pmod((F.col("mix_slot") + 0.5) * GOLDEN, F.lit(1.0))).withColumn("cell", cell)
    cells = sources.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * GRID).cast("long"), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1)).cast("long"))))
    named = points.join(_small(cells, few), "cell").where("point >= low and point < high").select("mix_slot", "mix_key", F.floor(F.col("mix_slot") / SLOT_CHUNK).alias("part"))
    before = named.groupBy("mix_key", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("mix_key").orderBy("part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("mix_key", "part").orderBy("mix_slot")) - 1
    return named.withColumn("inside", inside).join(before, ["mix_key", "part"]).select("mix_slot", "mix_key", (F.col("before") + F.col("inside")).alias("mix_rank"))


def laid_out(docs: DataFrame, tie: Sequence[str]) -> DataFrame:
    """docs (mix_key, size, ...) with mix_chunk, mix_row and mix_start: the words before each document in its source's shuffled order."""
    shuffled = docs.withColumn("mix_hash", F.xxhash64(*tie)).withColumn("mix_chunk", F.shiftrightunsigned("mix_hash", 64 - CHUNK_BITS))
    chunk = Window.partitionBy("mix_key", "mix_chunk")
    before = shuffled.groupBy("mix_key", "mix_chunk").agg(F.sum("size").alias("words"))
    before = before.withColumn("mix_before", F.sum("words").over(Window.partitionBy("mix_key").orderBy("mix_chunk")) - F.col("words")).drop("words")
    order = chunk.orderBy("mix_hash", *tie)
    inside = shuffled.withColumn("mix_row", F.row_number().over(order)).withColumn("mix_inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return inside.join(before, ["mix_key", "mix_chunk"]).withColumn("mix_start", F.col("mix_before") + F.col("mix_inside")).drop("mix_before", "mix_inside", "mix_hash")


def pieces(layout: DataFrame, slots: DataFrame, sources: DataFrame, block: int, count: int, few: bool = True) -> DataFrame:
    """mix_slot, mix_key, mix_chunk, mix_row, mix_pass, at, first and last: the words of documents, from 0, that each slot takes, and where they are in their source's stream.

    sources: mix_key, source_size, scheduled (words), given (slots) and place. A source's slots after its last given one
    come after the schedule, source by source.
    """
    docs = layout.where("size > 0").select("mix_key", "mix_chunk", "mix_row", "mix_start", "size").join(_small(sources.select("mix_key", "source_size", "scheduled", "given", "place"), few), "mix_key")
    docs = docs.withColumn("mix_pass", F.explode(F.expr("sequence(0L, (scheduled - 1) div source_size)"))).withColumn("at", F.col("mix_pass") * F.col("source_size") + F.col("mix_start")).where("at < scheduled")
    docs = docs.withColumn("mix_rank", F.explode(F.expr(f"sequence(at div {block}, (least(at + size, scheduled) - 1) div {block})")))
    first = F.greatest(F.col("mix_rank") * block - F.col("at"), F.lit(0))
    last = F.least(F.expr(f"(mix_rank + 1) * {block}"), F.col("at") + F.col("size"), F.col("scheduled")) - F.col("at")
    after = F.lit(count) + F.col("place") * CLOSING + F.col("mix_rank") - F.col("given")
    joined = docs.join(slots, ["mix_key", "mix_rank"], "left").withColumn("mix_slot", F.coalesce("mix_slot", F.when(F.col("mix_rank") >= F.col("given"), after)))
    return joined.where("mix_slot is not null").select("mix_slot", "mix_key", "mix_chunk", "mix_row", "mix_pass", "at", first.alias("first"), last.alias("last"))


def taken_words(docs: DataFrame, tie: Sequence[str], weights: Sequence[float] = (5, 2, 1), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """docs (with size and source) plus source_size, target, taken, mix_key/chunk/row and, of the pieces, mix_slots (first and last) and mix_copies (slot and place of each first word); and the pieces that make up the mix.

    tie: the columns that order the documents of a source after shuffling; rows that agree in all of them are alike.
    """
    docs = docs.withColumn("mix_key", source_key(F.col("source")))
    sources = stored(targets(docs.select("mix_key", "size"), weights, most))
    count, words = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    few = count <= MOST_SOURCES
    block = min(LONGEST, max(SHORTEST, words // SLOTS))
    slots = round(words / block)
    share = F.try_divide(F.sum("target").over(Window.orderBy("mix_key")), F.sum("target").over(Window.partitionBy(F.lit(0))))
    shares = sources.withColumn("high", share).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("mix_key")), F.lit(0.0)))
    shares = shares.withColumn("high", F.when(F.col("high") >= 1, F.lit(1.5)).otherwise(F.col("high")))
    plan = stored(schedule(shares.select("mix_key", "low", "high"), slots, few))
    given = plan.groupBy("mix_key").agg(F.count("*").alias("given"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy("mix_key")) - 1).join(_small(given, few), "mix_key", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    wanted = F.ceil(F.round("target", 6)).cast("long")
    closed = F.greatest(F.least(wanted, (F.col("given") + CLOSING) * block), (F.col("given") - CLOSING) * block)
    sources = sources.withColumn("scheduled", F.least(closed, most * F.col("source_size")))
    layout = laid_out(docs, tie)
    parts = pieces(layout, plan, sources, block, slots, few)
    copy = F.when(F.col("first") == 0, F.struct("mix_slot", "at"))
    taken = parts.groupBy("mix_key", "mix_chunk", "mix_row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.struct(F.min("mix_slot").alias("first"), F.max("mix_slot").alias("last")).alias("mix_slots"), F.collect_list(copy).alias("mix_copies"))
    full = layout.join(taken, ["mix_key", "mix_chunk", "mix_row"], "left").join(_small(sources.select("mix_key", "source_size", "target"), few), "mix_key")
    return full.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")), parts


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the first and last slot of the schedule that takes words of every document."""
    sized = stored(docs.select("doc_id", word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source")))
    rows = taken_words(sized, ["doc_id", "size"])[0]
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.col("mix_slots.first").alias("first_slot"), F.col("mix_slots.last").alias("last_slot"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix as documents with unchanged columns: a row for each time that a document's first word is taken, in the order of the slots that take it."""
    inner = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("mix_doc"), F.xxhash64("text").alias("mix_text"))
    whole = stored(inner).withColumn("mix_id", F.monotonically_increasing_id())  # the same at each reading of the stored rows
    rows, _ = taken_words(whole.drop("mix_doc"), ["doc_id", "size", "mix_text"], weights, most)  # without texts
    copies = rows.select("mix_id", F.explode("mix_copies").alias("mix_copy")).select("mix_id", "mix_copy.*")
    each = whole.select("mix_id", "mix_doc").join(copies, "mix_id")
    return each.repartitionByRange("mix_slot", "at").sortWithinPartitions("mix_slot", "at").select("mix_doc.*")
