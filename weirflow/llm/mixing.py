"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source has a weight, and at most ``max_epochs`` times its own size may be taken.  The whole
budget is shared by weight; what a source can't take is shared again among the others until
none is above its cap.  That fixed point is reached directly: with sources in order of
cap / weight, the first k are capped, and the rest share what is left by weight.

A source is then read ``target / size`` times: every document as often as the whole part says,
and once more for the documents that come first in a seeded order until the fractional part of
the target is filled.  The order is by a seeded hash.  It is not sorted as a whole: sizes are
summed by source and slot of the hash, the running sum over ``SLOTS`` slots finds the one in
which the target is reached; that slot's documents are summed by ``SLOTS`` parts of their hash
in the same way, and only those of one part, one of ``SLOTS`` times ``SLOTS`` of a source, are
sorted.  The sources themselves are ranked in one task: a row each.

Defined results: a null text has size 0, a null source is a source of its own and comes last; a
source of size 0 has target 0 and its documents are not taken; rows equal in id and text are
taken equally often, together, so a source can miss its target by half of such a group; an empty
table gives an empty result.  Columns other than id, source, text and those kept are not read;
kept ones may have any name but size, source_size, target and times and those that begin with _.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, scratch, stored, written

MAX_EPOCHS = 3
#: Slots of a source, by the lowest bits of a document's number, and parts of a slot, by the highest.
SLOTS = 4096
DRAW_BITS = 60


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, text: Column, seed: int) -> Column:
    """A row's seeded number below 2**60, from its id and text."""
    seen = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(seen), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of ``sources`` (source, weight, source_size): adds target.

    One row per source is sorted in one task; the table is as long as there are sources.
    """
    cap = F.col("source_size") * max_epochs
    before = W.orderBy(cap / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    earlier, everything = before.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    staged = sources.withColumn("_left", left).withColumn("_weight", weight_left).withColumn("_at", F.row_number().over(before))
    fits = cap * F.col("_weight") <= F.col("weight") * F.col("_left")  # its share of what is left reaches its cap
    staged = staged.withColumn("_open", F.min(F.when(~fits, F.col("_at"))).over(everything))
    rest = [F.max(F.when(F.col("_at") == F.col("_open"), F.col(c))).over(everything) for c in ("_left", "_weight")]
    share = F.col("weight").cast("double") * rest[0].cast("double") / rest[1].cast("double")
    target = F.when(F.col("_open").isNull() | (F.col("_at") < F.col("_open")), cap.cast("double")).otherwise(share)
    return staged.withColumn("target", target).drop("_left", "_weight", "_at", "_open")


def cycled_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Sources of ``sizes`` (source, source_size) by code point, null last, with weights 1 to ``cycle``, repeating."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", (F.pmod(place - 1, F.lit(cycle)) + 1).cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", seed: int = 7, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and times (how often it is taken).

    ``keep`` names further columns to pass through.  Sources are weighted as by
    ``cycled_weights``.
    """
    columns = list(dict.fromkeys([key, "source", *keep]))
    rows = docs.select(*columns, word_count(F.col("text")).alias("size"), draw(F.col(key), F.col("text"), seed).alias("_draw"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    slot = F.pmod(F.col("_draw"), F.lit(SLOTS)).cast("int")
    part = F.shiftright("_draw", DRAW_BITS - SLOTS.bit_length() + 1).cast("int")
    with scratch() as keep_table:
        if set(keep) <= {key, "source"}:
            held = written(rows, "sizes")
            rows = sized = held.frame
            keep_table(held)
        else:
            sized = stored(rows.select("source", "size", "_draw"), "sizes")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        targets = water_fill(cycled_weights(sizes), max_epochs).withColumn("_whole", whole)
        targets = targets.select(F.col("source").alias("_source"), "source_size", "target", "_whole", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_part"))
        targets = stored(targets, "targets")
        # the slot in which the part is filled, by source, and what is still wanted there
        slots = sized.groupBy("source", slot.alias("_slot")).agg(F.sum("size").alias("_slot_size"))
        upto = F.sum("_slot_size").over(W.partitionBy("source").orderBy("_slot"))
        slots = slots.withColumn("_upto", upto).join(targets.select("_source", "_part"), same).where("_upto >= _part and _part > 0")
        border = slots.groupBy("_source").agg(F.min(F.struct("_slot", (F.col("_part") - F.col("_upto") + F.col("_slot_size")).alias("_want"))).alias("_border"))
        border = stored(border.select("_source", "_border._slot", "_border._want"), "border")
        # documents follow in the order of their draw, and one is taken if at least half of it is
        # wanted: all of the parts that are wanted whole, and some of the first that is not
        there = stored(sized.join(border, same & (slot == F.col("_slot"))).where("size > 0").select("_source", "_want", "size", "_draw", part.alias("_at")), "there")
        parts = there.groupBy("_source", "_want", "_at").agg(F.sum("size").alias("_size"), F.max("_draw").alias("_most"))
        parts = parts.withColumn("_upto", F.sum("_size").over(W.partitionBy("_source").orderBy("_at")))
        before = parts.where("_upto < _want").groupBy("_source").agg(F.max("_most").alias("_last"))
        first = parts.where("_upto >= _want").groupBy("_source").agg(F.min(F.struct("_at", (F.col("_want") - F.col("_upto") + F.col("_size")).alias("_rest"))).alias("_first"))
        first = first.select(F.col("_source").alias("_f"), F.col("_first._at").alias("_first_at"), "_first._rest")
        within = there.join(first, F.col("_source").eqNullSafe(F.col("_f")) & (F.col("_at") == F.col("_first_at")))
        running = F.sum("size").over(W.partitionBy("_source").orderBy("_draw"))
        within = within.withColumn("_running", running).where(F.col("_running") - F.col("size") / 2 <= F.col("_rest")).groupBy("_source").agg(F.max("_draw").alias("_last"))
        last = before.unionByName(within).groupBy("_source").agg(F.max("_last").alias("_last"))
        border = border.withColumnRenamed("_source", "_b").join(last.withColumnRenamed("_source", "_l"), F.col("_b").eqNullSafe(F.col("_l")), "left")
        plan = targets.join(border.select("_b", "_slot", "_last"), F.col("_source").eqNullSafe(F.col("_b")), "left")
        # a table of its own: its size is then known when it is joined, and a skewed join can be split
        plan = written(plan.select("_source", "source_size", "target", "_whole", "_slot", "_last"), "plan")
        keep_table(plan)
    more = F.coalesce((slot < F.col("_slot")) | ((slot == F.col("_slot")) & (F.col("_draw") <= F.col("_last"))), F.lit(False)) & (F.col("size") > 0)
    placed = rows.join(plan.frame, same, "left")
    return placed.select(*columns, "size", "source_size", "target", (F.col("_whole") + more.cast("long")).alias("times"))


def repeated(docs: DataFrame, times: str = "times") -> DataFrame:
    """Each row as often as its column ``times`` says."""
    return docs.where(F.col(times) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(times)))).drop("_copy", times)
