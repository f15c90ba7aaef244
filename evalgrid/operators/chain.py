"""Greedy chains: pick a row, skip what is too near, pick the next - without walking the rows.

Refractory pauses and throttled alerts choose rows one after the other. Here every row first finds
its own successor (the first row it would allow), all at once; the rows on the path from each key's
first row are then found by doubling the step, so the number of rounds is the logarithm of the
longest chain and no key is read in order by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.operators.skew import join_on, running
from evalgrid.session import cut_lineage


def successors(df: DataFrame, keys: Sequence[str], place: str, reach: Column, slot_len: int) -> DataFrame:
    """(keys, at, to): for every row the first place of its key at or after `reach`, if there is one."""
    rows = df.select(*keys, F.col(place).cast("bigint").alias("_place"), reach.cast("bigint").alias("_reach"))
    none = F.lit(None).cast("bigint")
    ask = rows.select(*keys, F.col("_reach").alias("_at"), F.lit(0).alias("_kind"), F.col("_place").alias("at"), none.alias("_here"))
    tell = rows.select(*keys, F.col("_place").alias("_at"), F.lit(1).alias("_kind"), none.alias("at"), F.col("_place").alias("_here"))
    both = ask.union(tell).withColumn("_slot", F.floor(F.col("_at") / slot_len))
    found = running(both, keys, "_slot", ["_at", "_kind"], nexts={"to": "_here"})
    return found.where("_kind = 0 AND to IS NOT NULL").select(*keys, "at", "to")


def jump_chain(df: DataFrame, keys: Sequence[str], place: str, reach: Column, slot_len: int) -> DataFrame:
    """The rows of the greedy chain of each key: its first row, then always the first row at or
    after the `reach` of the row before. `place` is unique within a key and below its row's reach;
    null keys are a key; rows with a null place are dropped."""
    keys = list(keys)
    df = cut_lineage(df.where(F.col(place).isNotNull()))
    jumps = cut_lineage(successors(df, keys, place, reach, slot_len))
    picked = cut_lineage(df.groupBy(*keys).agg(F.min(F.col(place).cast("bigint")).alias("at")))
    n, before = picked.count(), -1
    while n != before:
        step = join_on(picked, jumps, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        picked = cut_lineage(picked.union(step).distinct())
        n, before = picked.count(), n
        if n != before:
            further = jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far"))
            jumps = cut_lineage(join_on(jumps, further, [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")))
    return join_on(df, picked.withColumnRenamed("at", place), [*keys, place])
