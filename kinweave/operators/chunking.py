"""Greedy chunks of ordered lists of any length, with no list in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ordering import numbered
from kinweave.scratch import discard, materialize


def greedy_chunks(rows: DataFrame, group: str, order: str, size: Column, max_items: int, max_size: int) -> DataFrame:
    """group, chunk (from 0), items and chars of what filling chunks one after the other gives.

    A chunk takes the next row as long as it has ``max_items`` rows and ``max_size`` in all at most; a row that is too
    large by itself is a chunk of its own.  Null sizes count as 0, null groups are left out; rows of equal ``order`` come
    in any order.  Rows get their places and sums so far in one global order.  The row at which a chunk that begins at a
    row would end is found by steps of halved length, each a join on places; then, of all these possible chunks, those
    that the list's first row leads to are found by pointers that double their reach each round.
    """
    sized = rows.where(F.col(group).isNotNull()).select(group, order, F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"))
    placed = materialize(numbered(sized, group, order, name="at", total_of="size").select(F.col(group).alias("g"), "at", "size", F.col("at_total").alias("total")), "placed")
    bounds = placed.groupBy("g").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    found = placed.join(bounds, "g").select("g", "at", "last", (F.col("total") - F.col("size")).alias("before"), F.col("at").alias("end"), "total")
    step = 1 << max(0, (max_items - 1).bit_length() - 1)
    while step and max_items > 1:
        probe = placed.select((F.col("at") - step).alias("end"), F.col("total").alias("reached"))
        fits = F.col("reached").isNotNull() & (F.col("end") + step <= F.col("last")) & (F.col("end") + step - F.col("at") < max_items) & (F.col("reached") - F.col("before") <= max_size)
        found = found.join(probe, "end", "left").select("g", "at", "last", "before", F.when(fits, F.col("end") + step).otherwise(F.col("end")).alias("end"), F.when(fits, F.col("reached")).otherwise(F.col("total")).alias("total"))
        step //= 2
    chunks = materialize(found.select("g", "at", (F.col("end") + 1).alias("next"), (F.col("end") - F.col("at") + 1).alias("items"), (F.col("total") - F.col("before")).alias("chars")), "chunks")
    jumps = chunks.select("at", "next").join(bounds.select((F.col("last") + 1).alias("next")), "next", "left_anti")  # the last chunk leads nowhere
    reached = materialize(bounds.select(F.col("first").alias("at"), F.lit(0).cast("long").alias("chunk")), "reached")
    jumps, hops = materialize(jumps.select("at", "next"), "jumps"), 1
    while not jumps.isEmpty():
        further = reached.join(jumps, "at").select(F.col("next").alias("at"), (F.col("chunk") + hops).alias("chunk"))
        more = materialize(reached.unionByName(further), "reached")
        twice = materialize(jumps.join(jumps.toDF("next", "then"), "next").select("at", F.col("then").alias("next")), "jumps")
        discard(reached, jumps)
        reached, jumps, hops = more, twice, 2 * hops
    return chunks.join(reached, "at").select(F.col("g").alias(group), "chunk", "items", "chars")
