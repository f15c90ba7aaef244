"""Zone classification: answers per grid, accuracy tables, error decomposition, calibration curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.draws import add_hash
from evalgrid.functions.zones import NO_ZONE, grid_list, zone_of
from evalgrid.operators.skew import attach, top_per_key
from evalgrid.session import cut_lineage

# Calibration sizes, draws per size, size from which a slope is fitted, slope range.
CALIB_K = [1, 3, 5, 9, 16]
CALIB_DRAWS = 20
PRUNE = 8  # a draw of k rows sorts those with the lowest hashes, about PRUNE * k
SLOPE_FROM = 5
SLOPE_RANGE = (0.5, 3.0)
MIN_SPREAD = 1e-9


def zone_answers(df: DataFrame, grids=None, truth=("gx", "gy"), pred=("px", "py")) -> DataFrame:
    """One row per (input row, grid): truth zone zt, answered zone zp (NO_ZONE = none), ok."""
    g = df.select("*", F.inline(grid_list(grids)))
    g = g.withColumn("zt", zone_of(*truth, "rows", "cols")).withColumn("zp", zone_of(*pred, "rows", "cols"))
    return g.withColumn("ok", (F.col("zt") == F.col("zp")) & (F.col("zt") != NO_ZONE))


def _mean(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(c.cast("double"))


def group_accuracy(answers: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Per group: n, correct, answered, and accuracy where no answer counts as wrong."""
    return answers.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("ok").cast("bigint")).alias("correct"),
        F.sum((F.col("zp") != NO_ZONE).cast("bigint")).alias("answered"),
        _mean("ok").alias("acc"),
    )


def macro_accuracy(per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean / min / max of group accuracies, pooled and answered-only accuracy beside them."""
    return per_group.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("acc").alias("acc_mean"),
        F.min("acc").alias("acc_min"),
        F.max("acc").alias("acc_max"),
        (F.sum("correct") / F.sum("n")).alias("acc_pooled"),
        F.try_divide(F.sum("correct"), F.sum("answered")).alias("acc_answered"),
    )


def balanced_accuracy(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean recall over the classes that occur."""
    recall = answers.where(F.col("zt") != NO_ZONE).groupBy(*keys, "zt").agg(_mean("ok").alias("recall"))
    return recall.groupBy(*keys).agg(F.avg("recall").alias("balanced_acc"), F.count(F.lit(1)).alias("classes"))


def confusion(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long row-normalised confusion matrix; zp = NO_ZONE is the "no answer" column."""
    counts = answers.groupBy(*keys, "zt", "zp").agg(F.count(F.lit(1)).alias("n"))
    row = Window.partitionBy(*keys, "zt")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(row))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts and shares of each value within the keys."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over counts: one row per distinct value
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))


def leave_one_out_majority(answers: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Most frequent truth zone among the *other* groups (tie: smallest) and its accuracy here.

    Totals minus own counts; every group meets each zone of its grid once, never another group.
    """
    own = answers.groupBy(*keys, group, "zt").agg(F.count(F.lit(1)).alias("own"))
    total = own.groupBy(*keys, "zt").agg(F.sum("own").alias("total"))
    zones = total.groupBy(*keys).agg(F.collect_list(F.struct("zt", "total")).alias("zones"))  # <= cells of a grid
    per_group = own.groupBy(*keys, group).agg(F.map_from_entries(F.collect_list(F.struct("zt", "own"))).alias("mine"), F.sum("own").alias("n"))
    full = per_group.join(zones, list(keys)).select(*keys, group, "mine", "n", F.inline("zones"))
    own_n = F.coalesce(F.try_element_at("mine", F.col("zt")), F.lit(0))
    best = full.groupBy(*keys, group).agg(
        F.max_by("zt", F.struct(F.col("total") - own_n, -F.col("zt"))).alias("majority_zone"),
        F.first("mine").alias("mine"),
        F.first("n").alias("n"),
    )
    hit = F.coalesce(F.try_element_at("mine", F.col("majority_zone")), F.lit(0))
    return best.select(*keys, group, "majority_zone", (hit / F.col("n")).alias("acc"))


def axis_errors(df: DataFrame, keys: Sequence[str], pairs: dict[str, Column]) -> DataFrame:
    """Long form (keys, axis, e): one row per axis with a defined error."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), e.cast("double").alias("e")) for a, e in pairs.items()])
    return df.select(*keys, F.inline(axes)).where(F.col("e").isNotNull())


def bias_and_scatter(errors: DataFrame, group: str) -> DataFrame:
    """Per axis: total RMS error, RMS of group bias and of scatter around it, share of the MSE a
    per-group offset would remove."""
    g = errors.groupBy("axis", group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("bias"), F.stddev("e").alias("sd"), F.sum(F.col("e") * F.col("e")).alias("ss")
    )
    mse = F.sum("ss") / F.sum("n")
    bias2 = F.avg(F.col("bias") * F.col("bias"))
    return g.groupBy("axis").agg(
        F.sqrt(mse).alias("rms_total"),
        F.sqrt(bias2).alias("rms_bias"),
        F.sqrt(F.avg(F.col("sd") * F.col("sd"))).alias("rms_scatter"),
        (bias2 / mse).alias("removable_share"),
    )


def shared_error(errors: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One-way ICC for unbalanced groups, the naive shared fraction and RMSE of rows vs group means.

    Works on group moments; sums of squares are centred on the grand mean, so nothing cancels.
    """
    g = errors.groupBy("axis", *groups).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("e").alias("m"), F.var_pop("e").alias("v"), F.sum(F.col("e") * F.col("e")).alias("ss")
    )
    grand = g.groupBy("axis").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    g = attach(g, grand, ["axis"], list(groups), how="inner")
    dev = F.col("m") - F.col("grand")
    t = g.groupBy("axis").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * dev * dev).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum("ss").alias("ss"),
        F.avg(F.col("m") * F.col("m")).alias("mean_m2"),
        F.avg("n").alias("mean_n"),
    )
    k1 = F.greatest(F.col("groups") - 1, F.lit(1))
    msb = F.col("ssb") / k1
    msw = F.col("ssw") / F.greatest(F.col("rows") - F.col("groups"), F.lit(1))
    n0 = (F.col("rows") - F.col("n2") / F.col("rows")) / k1
    den = msb + (n0 - 1) * msw
    total = F.col("ssb") + F.col("ssw")
    return t.select(
        "axis",
        "groups",
        F.col("rows").cast("bigint").alias("rows"),
        F.when(den > 0, (msb - msw) / den).alias("icc"),
        F.try_divide(F.col("ssb"), total).alias("naive_share"),
        F.col("mean_n").alias("rows_per_group"),
        F.sqrt(F.col("ss") / F.col("rows")).alias("rmse_row"),
        F.sqrt("mean_m2").alias("rmse_group_mean"),
    )


def nearest_point_error(marked: list[tuple[Column, Column]], found: list[tuple[Column, Column]], width: Column) -> Column:
    """Mean distance of each marked point to its nearest found point, relative to `width`."""
    nearest = [F.least(*[F.sqrt((mx - fx) ** 2 + (my - fy) ** 2) for fx, fy in found]) for mx, my in marked]
    total = nearest[0]
    for d in nearest[1:]:
        total = total + d
    return total / len(nearest) / F.greatest(width, F.lit(1e-6))


def calibration_fits(df: DataFrame, subject: str, row_id: str, day: str, axes: dict[str, tuple[str, str]], draws: int = CALIB_DRAWS, sizes=None, seed: int = 0):
    """k-shot corrections t = a p + b per (subject, scheme, k, draw): returns (fits, drawn rows).

    Pools: "random" = every answered row, "first session" = those of the subject's first day.
    A draw is the k rows of lowest hash, so sizes of one draw are nested.
    """
    sizes = sizes or CALIB_K
    answered = F.lit(True)
    for p, _ in axes.values():
        answered = answered & F.col(p).isNotNull()
    per_day = df.groupBy(subject, day).agg(F.count_if(answered).alias("_n"))
    first = per_day.groupBy(subject).agg(F.min(day).alias("_first"), F.sum("_n").alias("_all"), F.min_by("_n", day).alias("_early"))
    d = attach(df, first, [subject], [row_id], how="inner")
    early = F.struct(F.lit("first session").alias("scheme"), F.col("_early").alias("_n"))
    every = F.struct(F.lit("random").alias("scheme"), F.col("_all").alias("_n"))
    pool = d.where(answered).select("*", F.inline(F.when(F.col(day) == F.col("_first"), F.array(every, early)).otherwise(F.array(every))))
    # of n hashes the lowest few lie below a limit that a small multiple of them is expected under; only
    # those rows are sorted. Where a draw has too few there, all its rows are
    most = max(sizes)
    limit = F.when(F.col("_n") > PRUNE * most, F.ceil(F.lit(float(PRUNE * most << 32)) / F.col("_n"))).otherwise(F.lit(1 << 32))
    cell = [subject, "scheme", "draw"]

    def drawn_from(rows: DataFrame) -> DataFrame:
        return add_hash(rows, F.lit(seed), F.col("draw"), F.col(row_id), "_h")

    each = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    near = drawn_from(each).where(F.col("_h").isNull() | (F.col("_h") < limit))
    drawn = cut_lineage(top_per_key(near, cell, [F.col("_h"), F.col(row_id)], most, rank="_r"))
    pools = first.select(subject, F.inline(F.array(every, early))).where((F.col("_n") > 0) & F.col(subject).isNotNull())
    pools = pools.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    got = drawn.groupBy(*cell).agg(F.count(F.lit(1)).alias("_got"))
    short = cut_lineage(pools.join(got, cell, "left").where(F.coalesce("_got", F.lit(0)) < F.least("_n", F.lit(most))).select(*cell))
    if not short.isEmpty():
        again = drawn_from(pool.join(short, [subject, "scheme"])).select(*[c for c in drawn.columns if c != "_r"])
        again = top_per_key(again, cell, [F.col("_h"), F.col(row_id)], most, rank="_r")
        drawn = cut_lineage(drawn.join(short, cell, "left_anti").unionByName(again))
    by_k = drawn.select("*", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k")).where(F.col("_r") <= F.col("k"))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for a, (p, t) in axes.items():
        aggs += [F.avg(p).alias(f"_p_{a}"), F.avg(t).alias(f"_t_{a}"), F.covar_pop(p, t).alias(f"_c_{a}"), F.var_pop(p).alias(f"_v_{a}")]
    m = by_k.groupBy(subject, "scheme", "k", "draw").agg(*aggs).where(F.col("_n") == F.col("k"))
    cols = []
    for a in axes:
        slope = F.greatest(F.lit(SLOPE_RANGE[0]), F.least(F.lit(SLOPE_RANGE[1]), F.col(f"_c_{a}") / F.col(f"_v_{a}")))
        spread = F.col(f"_v_{a}") * F.col("k") > MIN_SPREAD
        s = F.when((F.col("k") >= SLOPE_FROM) & spread, slope).otherwise(F.lit(1.0))
        cols += [s.alias(f"a_{a}"), (F.col(f"_t_{a}") - s * F.col(f"_p_{a}")).alias(f"b_{a}")]
    return m.select(subject, "scheme", "k", "draw", *cols), by_k, d


def calibration_curve(df: DataFrame, subject: str, row_id: str, day: str, grids, draws: int = CALIB_DRAWS, seed: int = 0) -> DataFrame:
    """Accuracy after k-shot correction, scored on rows not used to calibrate.

    Corrections meet the rows by subject and are aggregated before any shuffle. For the random
    pool the drawn rows' hits are subtracted from the subject's total instead of anti-joining
    every draw. Result: mean over draws per subject, then mean / min / max over subjects.
    """
    axes = {"x": ("px", "gx"), "y": ("py", "gy")}
    fits, drawn, days = calibration_fits(df, subject, row_id, day, axes, draws, seed=seed)
    data = [subject, row_id, "px", "py", "gx", "gy"]

    def hits(rows: DataFrame, on: list[str], cond: Column) -> DataFrame:
        j = rows.join(fits, on).where(cond)
        j = j.withColumn("qx", F.col("a_x") * F.col("px") + F.col("b_x")).withColumn("qy", F.col("a_y") * F.col("py") + F.col("b_y"))
        ok = [
            F.sum(((zone_of("qx", "qy", r, c) == zone_of("gx", "gy", r, c)) & (zone_of("gx", "gy", r, c) != NO_ZONE)).cast("bigint")).alias(g)
            for g, r, c in grids
        ]
        return j.groupBy(subject, "scheme", "k", "draw").agg(F.count(F.lit(1)).alias("n"), *ok)

    later = (F.col("scheme") == "random") | (F.col(day) != F.col("_first"))
    on_all = hits(days.select(*data, day, "_first"), [subject], later)
    on_drawn = hits(drawn.where(F.col("scheme") == "random").select(*data, "scheme", "k", "draw"), [subject, "scheme", "k", "draw"], F.lit(True))
    minus = on_drawn.select(subject, "scheme", "k", "draw", F.col("n").alias("_n"), *[F.col(g).alias(f"_{g}") for g, _, _ in grids])
    j = on_all.join(minus, [subject, "scheme", "k", "draw"], "left")
    left = F.col("n") - F.coalesce("_n", F.lit(0))
    per_draw = j.where(left > 0).select(
        subject, "scheme", "k",
        F.inline(F.array(*[F.struct(F.lit(g).alias("grid"), ((F.col(g) - F.coalesce(f"_{g}", F.lit(0))) / left).alias("acc")) for g, _, _ in grids])),
    )
    per_subject = per_draw.groupBy("scheme", "grid", "k", subject).agg(F.avg("acc").alias("acc"))
    return per_subject.groupBy("scheme", "grid", "k").agg(
        F.avg("acc").alias("acc_mean"), F.min("acc").alias("acc_min"), F.max("acc").alias("acc_max"), F.count(F.lit(1)).alias("subjects")
    )
