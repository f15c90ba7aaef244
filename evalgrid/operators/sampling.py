"""Seeded sampling and ordering that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.draws import md5_rank
from evalgrid.operators.skew import top_per_key


def stratified(df: DataFrame, stratum: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows per stratum by hash order; pruned per map task, so strata may be any size."""
    return top_per_key(df, [stratum], [md5_rank(seed, F.col(row_id)), F.col(row_id)], n, rank="draw")


def round_robin(df: DataFrame, stratum: str, order: Sequence[str], n: int) -> DataFrame:
    """First n rows taken one per stratum in turn. No stratum can give more than n."""
    turns = top_per_key(df, [stratum], [F.col(c) for c in order], n, rank="turn")
    return turns.orderBy("turn", stratum).limit(n)


def sample_units(df: DataFrame, unit: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct units by hash order (a top-n, not a sort)."""
    return df.select(unit).distinct().orderBy(md5_rank(seed, F.col(unit)), unit).limit(n)


def natural_number(name: Column) -> Column:
    """Sort key of ids such as P_9, P_10."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not yet in the output: what a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
