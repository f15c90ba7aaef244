"""Resampling inference: bootstrap intervals of a mean over units, clusters, pairs and strata.

Reduce to one row per unit first (cluster_means, paired_differences). Every unit gets a Poisson(1)
weight in every replicate, by inverting the distribution on a hash of (seed, replicate, unit): the
same method at every size, without unit numbers, and the same weights however rows are partitioned.
A unit's weights depend on nothing else, so they are drawn once for all cells that it is in: rows are
dealt and sorted by unit, tasks multiply values with weights as matrices, and only sums per (cell,
replicates) are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.draws import normal_cdf, normal_quantile, poisson_weights, weights_room
from evalgrid.functions.zones import finite
from evalgrid.session import cut_lineage

REPS = 5000
BCA_REPS = 10000
DRAWS = 160_000  # weights held at once in a task: few, so that they stay in the processor's cache
HELD = 2_500_000  # sums that a task holds before it hands them on
BLOCK = 500  # replicates in one row of sums


def weighted_sums(batches: Iterator[pd.DataFrame], cell: list[str], reps: int, most: int) -> Iterator[pd.DataFrame]:
    """Within a task: (cell, _block, n, s, w), the sums of BLOCK replicates as arrays. The rows (cell,
    _u, _v, _seed) come best in the order of their units; a unit's weights serve all its cells in a batch.
    About `most` cells are held at once."""
    held: dict[tuple, list] = {}
    every, step = np.arange(reps, dtype=np.int64)[None, :], max(1, DRAWS // reps)
    room, sums = weights_room((step, reps)), np.empty((0, reps))

    def handed_on() -> pd.DataFrame:
        rows = [(*c, at // BLOCK, n, s[at : at + BLOCK], w[at : at + BLOCK]) for c, (n, s, w) in held.items() for at in range(0, reps, BLOCK)]
        held.clear()
        return pd.DataFrame(rows, columns=[*cell, "_block", "n", "s", "w"])

    for b in batches:
        number = b.groupby(cell, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(number, return_index=True)[1]
        named = [tuple(c) for c in b[cell].astype(object).where(b[cell].notna(), None).iloc[first].to_numpy().tolist()]
        unit, value, seeds = b["_u"].to_numpy(np.int64), b["_v"].to_numpy(float), b["_seed"].to_numpy()
        for seed in np.unique(seeds):
            for low in range(0, len(named), most):
                rows = np.flatnonzero((seeds == seed) & (number >= low) & (number < low + most))
                rows = rows[np.argsort(unit[rows], kind="stable")]
                units, start = np.unique(unit[rows], return_index=True)
                ends = np.r_[start, len(rows)]
                for at in range(0, len(units), step):
                    drawn = units[at : at + step]
                    some = rows[ends[at] : ends[at + len(drawn)]]
                    here, c = np.unique(number[some], return_inverse=True)
                    place = c, np.searchsorted(drawn, unit[some])
                    x = np.zeros((2, len(here), len(drawn)))
                    np.add.at(x[0], place, value[some])
                    np.add.at(x[1], place, 1.0)
                    weights = poisson_weights(int(seed), every, drawn[:, None], [r[: len(drawn)] for r in room])
                    if len(sums) < 2 * len(here):
                        sums = np.empty((2 * len(here), reps))
                    s, w = np.matmul(x.reshape(-1, len(drawn)), weights, out=sums[: 2 * len(here)]).reshape(2, len(here), reps)
                    for i, n in enumerate(np.bincount(c)):
                        mine = held.setdefault(named[here[i]], [0, np.zeros(reps), np.zeros(reps)])
                        mine[0] += int(n)
                        mine[1] += s[i]
                        mine[2] += w[i]
                if len(held) >= most:
                    yield handed_on()
    if held:
        yield handed_on()


def _by_unit(units: DataFrame, cell: Sequence[str], unit: str, value: str) -> DataFrame:
    """The finite values, written once in the order of their units: they are read several times and not
    computed again from what they came from."""
    v = F.col(value).cast("double")
    rows = units.select(*cell, unit, v.alias(value)).where(finite(v))
    # a set number of parts: adaptive execution would make few of them, and drawing costs much per byte
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(rows.repartition(parts, unit).sortWithinPartitions(unit))


def replicate_sums(units: DataFrame, cell: Sequence[str], unit: str, value: str, reps: int = REPS, seed: int | Column = 0) -> DataFrame:
    """(cell, _rep, s, w, n): weighted sum, weight and number of units of each bootstrap replicate;
    cells with < 2 units give none. `unit` is an integer identifier, unique within the cell (hash
    other keys with xxhash64)."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    v = F.col(value).cast("double")
    cell = list(cell)
    clean = units.select(*cell, F.col(unit).cast("bigint").alias("_u"), v.alias("_v"), seed.cast("bigint").alias("_seed"))
    clean = clean.where(finite(F.col("_v")))
    kinds = ", ".join(f"`{c}` {clean.schema[c].dataType.simpleString()}" for c in cell)
    fields = f"{kinds}, _block int, n bigint, s array<double>, w array<double>"

    # the tasks' parts are added up number by number, in their own tasks first: no group holds them all
    most = max(1, HELD // reps)
    parts = clean.mapInPandas(lambda batches: weighted_sums(batches, cell, reps, most), fields)
    each = parts.select(*cell, "n", (F.col("_block") * BLOCK).alias("_at"), F.posexplode(F.arrays_zip("s", "w")).alias("_i", "_p"))
    sums = each.groupBy(*cell, (F.col("_at") + F.col("_i")).cast("bigint").alias("_rep")).agg(F.sum("_p.s").alias("s"), F.sum("_p.w").alias("w"), F.sum("n").alias("n"))
    return sums.where("n >= 2")


def bootstrap_ci(
    units: DataFrame,
    cell: Sequence[str],
    unit: str,
    value: str,
    reps: int = REPS,
    seed: int = 0,
    level: float = 0.95,
) -> DataFrame:
    """(cell, n, estimate, ci_lo, ci_hi) of the mean over units; a null interval below two units."""
    cell = list(cell)
    whole = not cell
    if whole:
        units, cell = units.withColumn("_all", F.lit(0)), ["_all"]
    units = _by_unit(units, cell, unit, value)
    est = units.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("estimate"))
    tail = (1 - level) / 2
    means = replicate_sums(units, cell, unit, value, reps, seed)
    ends = means.groupBy(*cell).agg(
        F.percentile(F.try_divide("s", "w"), F.array(F.lit(tail), F.lit(1 - tail))).alias("_p")
    )
    out = est.join(ends, cell, "left").select(
        *cell, "n", "estimate", F.col("_p")[0].alias("ci_lo"), F.col("_p")[1].alias("ci_hi")
    )
    return out.drop("_all") if whole else out


def metric_intervals(units: DataFrame, cell: Sequence[str], unit: str, metrics: Sequence[str], reps: int = REPS, seed: int = 0) -> DataFrame:
    """(cell, <metric>_lo and <metric>_hi per metric): intervals of several means over the same units,
    to be joined to a result table. All metrics share a unit's weights."""
    long = units.select(*cell, unit, F.inline(F.array(*[F.struct(F.lit(m).alias("_metric"), F.col(m).cast("double").alias("_v")) for m in metrics])))
    ci = bootstrap_ci(long, [*cell, "_metric"], unit, "_v", reps, seed)
    ends = [F.max(F.when(F.col("_metric") == m, F.col(f"ci_{e}"))).alias(f"{m}_{e}") for m in metrics for e in ("lo", "hi")]
    return ci.groupBy(*cell).agg(*ends)


def cluster_means(rows: DataFrame, cell: Sequence[str], cluster: str, value: str, out: str = "value") -> DataFrame:
    """One unweighted mean per cluster: the unit of a cluster bootstrap."""
    return rows.groupBy(*cell, cluster).agg(F.avg(F.col(value).cast("double")).alias(out))


def paired_differences(long: DataFrame, pairs: DataFrame, unit: str, by: Sequence[str], side: str, value: str) -> DataFrame:
    """(a, b, by, unit, diff) where both sides have a finite value; `pairs` holds columns a, b.

    The values stay in long form: each row meets only the pairs that name its side.
    """
    ok = long.where(finite(F.col(value).cast("double")))
    left = ok.withColumnRenamed(side, "a").join(pairs, "a").select("a", "b", *by, unit, F.col(value).alias("_x"))
    right = ok.select(F.col(side).alias("b"), *by, unit, F.col(value).alias("_y"))
    return left.join(right, ["b", *by, unit]).select(
        "a", "b", *by, unit, (F.col("_x") - F.col("_y")).cast("double").alias("diff")
    )


def stratified_ci(units: DataFrame, cell: Sequence[str], stratum: str, unit: str, value: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    """Resample units within each stratum, then pool: strata keep their shares in every replicate.
    `unit` is unique over the strata of a cell, so that their draws are independent."""
    units = _by_unit(units, [*cell, stratum], unit, value)
    sums = replicate_sums(units, [*cell, stratum], unit, value, reps, seed)
    pooled = sums.groupBy(*cell, "_rep").agg((F.sum(F.col("n") * F.try_divide("s", "w")) / F.sum(F.when(F.col("w") > 0, F.col("n")))).alias("m"))
    ends = pooled.groupBy(*cell).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    est = units.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("estimate"))
    return est.join(ends, list(cell), "left").select(
        *cell, "n", "estimate", F.col("_p")[0].alias("ci_lo"), F.col("_p")[1].alias("ci_hi")
    )


def bca_ci(units: DataFrame, cell: Sequence[str], unit: str, value: str, reps: int = BCA_REPS, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Bias-corrected accelerated interval of the mean.

    For a mean the jackknife acceleration is skewness / (6 sqrt n). All values equal gives the
    degenerate (v, v); where the correction is undefined the plain percentiles are used.
    """
    v = F.col(value).cast("double")
    units = _by_unit(units, cell, unit, value)
    est = units.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("estimate"), F.skewness(v).alias("_skew"), F.min(v).alias("_min"), F.max(v).alias("_max")
    )
    sums = replicate_sums(units, cell, unit, value, reps, seed)
    means = sums.select(*cell, F.try_divide("s", "w").alias("m"))
    sorted_means = means.groupBy(*cell).agg(F.array_sort(F.collect_list("m")).alias("_m"))
    d = est.join(sorted_means, list(cell), "left")
    # every step is its own column: inlined, each would repeat the scans of the replicate array
    below = F.size(F.filter("_m", lambda m: m < F.col("estimate")))
    upto = F.size(F.filter("_m", lambda m: m <= F.col("estimate")))
    d = d.withColumn("_share", (below + upto) / (2.0 * F.size("_m"))).withColumn("_z0", normal_quantile(F.col("_share")))
    d = d.withColumn("_a", F.col("_skew") / (6 * F.sqrt("n")))
    same = F.abs(F.col("_max") - F.col("_min")) <= 1e-8 + 1e-5 * F.abs(F.col("_min"))
    for end, p in (("ci_lo", (1 - level) / 2), ("ci_hi", (1 + level) / 2)):
        d = d.withColumn("_z", F.col("_z0") + normal_quantile(F.lit(p)))
        d = d.withColumn("_s", normal_cdf(F.col("_z0") + F.col("_z") / (1 - F.col("_a") * F.col("_z"))))
        usable = finite(F.col("_s")) & (F.col("_s") >= 0) & (F.col("_s") <= 1)
        d = d.withColumn("_at", F.when(usable, F.col("_s")).otherwise(F.lit(p)) * (F.size("_m") - 1))
        lo, hi = F.get("_m", F.floor("_at").cast("int")), F.get("_m", F.ceil("_at").cast("int"))
        value = lo + (hi - lo) * (F.col("_at") - F.floor("_at"))
        d = d.withColumn(end, F.when(same & (F.col("n") > 0), F.col("_min")).when(F.col("n") >= 2, value))
    return d.select(*cell, "n", "estimate", "ci_lo", "ci_hi")
