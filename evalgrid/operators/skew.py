"""Building blocks that keep working when one key holds a large share of all rows.

* attach      - join a one-row-per-key table to facts, hot keys salted over several tasks
* running     - running count / sum / max / last / next over a key, in two levels: totals per
                (key, slot) are small and are prefix-summed, rows only sort inside their slot
* quantiles   - exact, linearly interpolated quantiles without gathering a group in one task
* top_per_key - first k rows per key; Spark prunes to k per map task before the shuffle

Nothing here hints a broadcast: whether a side is small enough is left to Spark's own size
checks (autoBroadcastJoinThreshold at planning, adaptive execution at run time).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.session import cut_lineage

FAN = 16


def salt(cols: Sequence[str | Column], fan: int = FAN) -> Column:
    """A salt that depends only on row content, so a retried task repeats it."""
    return F.pmod(F.xxhash64(*cols), F.lit(fan)).cast("int")


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the key columns of `left` stay."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(named, same, how).drop(*[f"_on_{c}" for c in on])


def attach(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    fan: int = FAN,
    null_safe: bool = False,
) -> DataFrame:
    """Join a small `dim` (one or a few rows per `on`) to `facts`; the fact rows of one key are
    spread over `fan` tasks by `spread_by`. Null keys meet nothing unless `null_safe`."""
    if how not in ("left", "inner"):
        raise ValueError("attach keeps the fact side: use 'left' or 'inner'")
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    keyed = facts.withColumn("_salt", salt(spread_by, fan))
    joined = join_on(keyed, copies, [*on, "_salt"], how) if null_safe else keyed.join(copies, [*on, "_salt"], how)
    return joined.drop("_salt")


def running(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    order: Sequence[str],
    count: str | None = None,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    nexts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running values over `keys` in `order`, with `slot` a coarse bucket that grows with `order`.

    count: 1-based row number. sums / maxes: over the rows strictly before. lasts / nexts: last
    non-null value strictly before / first non-null value strictly after. Each mapping is
    {output column: input column}. A key is never sorted as a whole: the longest sort is one slot.
    Null keys and null slots are keys and slots like any other, the null slot the first.
    """
    sums, maxes, lasts, nexts = (dict(m or {}) for m in (sums, maxes, lasts, nexts))
    cell = [*keys, slot]
    place = F.struct(*order)

    def where_set(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), place)

    totals = [F.count(F.lit(1)).alias("_n")]
    totals += [F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    totals += [F.max(c).alias(f"_t_{o}") for o, c in maxes.items()]
    totals += [F.max_by(c, where_set(c)).alias(f"_t_{o}") for o, c in lasts.items()]
    totals += [F.min_by(c, where_set(c)).alias(f"_t_{o}") for o, c in nexts.items()]
    per_slot = df.groupBy(*cell).agg(*totals)

    back = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(slot)).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("_n").over(back).alias("_c_n")]
    carried += [F.sum(f"_t_{o}").over(back).alias(f"_c_{o}") for o in sums]
    carried += [F.max(f"_t_{o}").over(back).alias(f"_c_{o}") for o in maxes]
    carried += [F.last(f"_t_{o}", ignorenulls=True).over(back).alias(f"_c_{o}") for o in lasts]
    carried += [F.last(f"_t_{o}", ignorenulls=True).over(ahead).alias(f"_c_{o}") for o in nexts]
    carry = per_slot.select(*cell, *carried)

    here = Window.partitionBy(*cell).orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy(*cell)
        .orderBy(*[F.desc(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = []
    if count:
        out.append((F.row_number().over(here) + F.coalesce("_c_n", F.lit(0))).alias(count))
    for o, c in sums.items():
        out.append((F.coalesce(F.sum(c).over(before), F.lit(0)) + F.coalesce(f"_c_{o}", F.lit(0))).alias(o))
    for o, c in maxes.items():
        out.append(F.greatest(F.max(c).over(before), f"_c_{o}").alias(o))
    for o, c in lasts.items():
        out.append(F.coalesce(F.last(c, ignorenulls=True).over(before), f"_c_{o}").alias(o))
    for o, c in nexts.items():
        out.append(F.coalesce(F.last(c, ignorenulls=True).over(after), f"_c_{o}").alias(o))
    return join_on(df, carry, cell).select(*[F.col(c) for c in df.columns], *out)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    cells: int = 64,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key, one column per named prob.

    Equal values are counted first. The counts are laid over at most `cells` value bands per key of
    about as many values each, the bands holding the wanted ranks are found from their totals, and only values inside those
    bands are ordered. Null and NaN values are skipped; a key without values gives no row; a null
    key is a key.
    """
    whole = not keys
    if whole:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    keys = list(keys)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    tally = df.select(*keys, v.alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_c")).where("_c > 0")
    # any edges give the exact result; sketched ones give bands with about as many values each, however
    # far some values lie from the others
    edges = F.percentile_approx("_v", [i / cells for i in range(1, cells)], 1000)
    span = tally.groupBy(*keys).agg(edges.alias("_edges"), F.sum("_c").alias("_n"))
    band = F.size(F.filter("_edges", lambda e: e <= F.col("_v")))
    banded = attach(tally, span, keys, ["_v"], how="inner", null_safe=True).select(
        *keys, "_v", "_c", "_n", band.cast("int").alias("_band")
    )
    totals = banded.groupBy(*keys, "_band").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
    by_band = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at"))
                for name, p in probs.items()
            ]
        )
    )
    ranks = (
        totals.withColumn("_before", F.coalesce(F.sum("_bc").over(by_band), F.lit(0)))
        .select("*", wanted.alias("_w"))
        .select("*", F.explode(F.array(F.floor("_w.at"), F.ceil("_w.at"))).alias("_rank"))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bc")))
        .select(
            *keys, "_band", "_before", F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at"), "_rank"
        )
        .distinct()
    )
    in_band = Window.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    kept = join_on(banded, ranks.select(*keys, "_band").distinct(), [*keys, "_band"])
    placed = kept.select(*keys, "_band", "_v", "_c", F.coalesce(F.sum("_c").over(in_band), F.lit(0)).alias("_cum"))
    hit = join_on(placed, ranks, [*keys, "_band"]).where(
        (F.col("_rank") >= F.col("_before") + F.col("_cum"))
        & (F.col("_rank") < F.col("_before") + F.col("_cum") + F.col("_c"))
    )
    out = []
    for name in probs:
        mine = F.col("_name") == name
        low = F.min(F.when(mine, F.col("_v")))
        high = F.max(F.when(mine, F.col("_v")))
        part = F.max(F.when(mine, F.col("_at") - F.floor("_at")))
        out.append((low + (high - low) * part).alias(name))
    result = hit.groupBy(*keys).agg(*out)
    return result.drop("_all") if whole else result


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each key; Spark's window group limit prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Number all rows from 1 in `order`, which must tell rows apart. Rows are dealt by range and
    each range is counted, so no task sorts more than its range and one sees only the counts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(before, "_part").withColumn(out, F.col("_before") + inner).drop("_part", "_before")


def haloed(df: DataFrame, keys: Sequence[str], t: str, slot_len: int, lookback: int, slot: str = "slot") -> DataFrame:
    """Copy each row into every slot whose rows may look back on it; `_own` marks the original.

    Sliding windows of at most `lookback` then run per (keys, slot) instead of per key. Keep only
    `_own` rows afterwards.
    """
    first = F.floor(F.col(t) / slot_len)
    last = F.floor((F.col(t) + lookback) / slot_len)
    return (
        df.withColumn("_home", first)
        .withColumn(slot, F.explode(F.sequence(F.col("_home"), last)))
        .withColumn("_own", F.col(slot) == F.col("_home"))
        .drop("_home")
    )
