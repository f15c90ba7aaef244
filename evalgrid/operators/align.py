"""Time alignment of two streams: nearest sample, interpolation, clock lag, timestamp repair.

Streams are never sorted per key. Two mechanisms are used: equi-joins on (key, time bucket), and
`running` over the union of both streams, whose longest sort is one time slot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from evalgrid.operators.skew import attach, quantiles, running
from evalgrid.session import cut_lineage

# Match tolerance, fallback frame period, fewest good stamps, default frame rate.
MATCH_MS = 20
FALLBACK_PERIOD_MS = 33.3
MIN_GOOD = 5
DEFAULT_FPS = 30.0


def neighbours(points: DataFrame, refs: DataFrame, keys: Sequence[str], t: str, slot_len: int, payload: Sequence[str]) -> DataFrame:
    """Each point with the reference sample at or before it (`prev`) and after it (`next`)."""
    sample = F.struct(F.col(t), *payload)
    tagged = refs.select(*keys, t, F.lit(0).alias("_kind"), sample.alias("_ref"))
    width = tagged.schema["_ref"].dataType
    own = [c for c in points.columns if c not in (*keys, t)]
    rows = points.select(*keys, t, F.lit(1).alias("_kind"), F.lit(None).cast(width).alias("_ref"), F.struct(*own).alias("_row") if own else F.lit(0).alias("_row"))
    both = tagged.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows)
    both = both.withColumn("_slot", F.floor(F.col(t) / slot_len))
    order = [t, "_kind"]
    r = running(both, keys, "_slot", order, lasts={"prev": "_ref"}, nexts={"next": "_ref"}).where("_kind = 1")
    return r.select(*keys, t, *([F.col(f"_row.{c}").alias(c) for c in own]), "prev", "next")


def nearest_sample(points: DataFrame, refs: DataFrame, keys: Sequence[str], t: str, slot_len: int, tolerance: int, values: Sequence[str], valid: str) -> DataFrame:
    """Nearest reference sample in time, the earlier one on a tie, over *all* samples.

    Its values are attached only if it is within `tolerance` and valid; the distance dt is kept
    either way. This is not the nearest valid sample.
    """
    n = neighbours(points, refs, keys, t, slot_len, [*values, valid])
    back, ahead = F.col(t) - F.col(f"prev.{t}"), F.col(f"next.{t}") - F.col(t)
    take_prev = F.col("next").isNull() | (F.col("prev").isNotNull() & (back <= ahead))
    n = n.withColumn("_near", F.when(take_prev, F.col("prev")).otherwise(F.col("next")))
    n = n.withColumn("dt", F.abs(F.col(t) - F.col(f"_near.{t}")))
    ok = (F.col("dt") <= tolerance) & (F.col(f"_near.{valid}") == 1)
    return n.select(*[c for c in points.columns], "dt", *[F.when(ok, F.col(f"_near.{v}")).alias(v) for v in values])


def nearest_within(points: DataFrame, refs: DataFrame, keys: Sequence[str], t: str, tolerance: int, values: Sequence[str], valid: str, row_id: str) -> DataFrame:
    """As nearest_sample where distances beyond the tolerance are not needed: an equi-join of
    time buckets as wide as the tolerance, each point looking into its own and both neighbours."""
    bucket = F.floor(F.col(t) / tolerance)
    near = points.select(*keys, t, row_id, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    samples = refs.select(*keys, F.col(t).alias("_rt"), bucket.alias("_b"), *values, F.col(valid).alias("_ok"))
    cand = near.join(samples, [*keys, "_b"]).where(F.abs(F.col(t) - F.col("_rt")) <= tolerance)
    best = cand.groupBy(*keys, row_id).agg(
        F.min_by(F.struct("_rt", "_ok", *values), F.struct(F.abs(F.col(t) - F.col("_rt")), F.col("_rt"))).alias("_s")
    )
    j = points.join(best, [*keys, row_id], "left")
    return j.select(*points.columns, *[F.when(F.col("_s._ok") == 1, F.col(f"_s.{v}")).alias(v) for v in values])


def interpolate(points: DataFrame, refs: DataFrame, keys: Sequence[str], t: str, slot_len: int, value: str, out: str = "ref") -> DataFrame:
    """Reference value at each point's time, linear between samples and held beyond the ends."""
    n = neighbours(points, refs, keys, t, slot_len, [value])
    a, b = F.col("prev"), F.col("next")
    share = (F.col(t) - a[t]) / (b[t] - a[t])
    line = a[value] + (b[value] - a[value]) * share
    est = F.when(a.isNull(), b[value]).when(b.isNull(), a[value]).otherwise(line)
    return n.select(*points.columns, est.alias(out))


def _packed_around(homes: DataFrame, refs: DataFrame, keys: Sequence[str], t: str, value: str, slot_len: int, halo: int) -> DataFrame:
    """(keys, _slot, samples) for every slot of `homes`: the reference's (t, value) in the slots up to
    `halo` before and after it, and the next sample beyond them on each side, where there is one."""
    slots = refs.withColumn("_slot", F.floor(F.col(t) / slot_len)).groupBy(*keys, "_slot").agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("v")))).alias("s"))
    slots = cut_lineage(slots)
    near = slots.select(*keys, F.explode(F.sequence(F.col("_slot") - halo, F.col("_slot") + halo)).alias("_slot"), "s")
    near = near.join(homes, [*keys, "_slot"], "left_semi").groupBy(*keys, "_slot").agg(F.flatten(F.collect_list("s")).alias("s"))
    ends = slots.select(*keys, "_slot", F.element_at("s", 1).alias("_first"), F.element_at("s", -1).alias("_last"), F.lit(False).alias("_home"))
    none = F.lit(None).cast(ends.schema["_first"].dataType)
    both = ends.unionByName(homes.select(*keys, "_slot", none.alias("_first"), none.alias("_last"), F.lit(True).alias("_home")))
    by = Window.partitionBy(*keys).orderBy("_slot")
    before = F.last("_last", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, -halo - 1))
    after = F.first("_first", ignorenulls=True).over(by.rangeBetween(halo + 1, Window.unboundedFollowing))
    edges = both.withColumn("_before", before).withColumn("_after", after).where("_home").select(*keys, "_slot", "_before", "_after")
    samples = F.concat(F.array("_before"), F.coalesce("s", F.array().cast(near.schema["s"].dataType)), F.array("_after"))
    return edges.join(near, [*keys, "_slot"], "left").select(*keys, "_slot", F.array_compact(samples).alias("samples"))


def lag_moments(points: DataFrame, refs: DataFrame, keys: Sequence[str], t: str, signal: str, value: str, lags: Sequence[int], slot_len: int) -> DataFrame:
    """(keys, lag, n, mx, my, xx, yy, xy): per slot of a stream, the number, the means and the centred
    sums of products of `signal` and the reference at t + lag. The shuffle carries points and samples
    once; a task holds a slot of points, the samples around it and one number per lag."""
    shift, chunk, names = np.array(lags, np.int64), 2048, list(keys)
    halo = -(-max(abs(int(lag)) for lag in lags) // slot_len)
    p = points.select(*keys, F.floor(F.col(t) / slot_len).alias("_slot"), F.col(t).cast("bigint").alias("_t"), F.col(signal).cast("double").alias("_x"))
    r = refs.select(*keys, F.col(t).cast("bigint").alias("_t"), F.col(value).cast("double").alias("_v"))
    packed = _packed_around(p.select(*keys, "_slot").distinct(), r, keys, "_t", "_v", slot_len, halo)
    own = {f.name: f.dataType for f in p.select(*keys).schema.fields}

    def moments(key: tuple, frames: pa.Table, around: pa.Table) -> pa.Table:
        x, at = frames["_x"].to_numpy(), frames["_t"].to_numpy()
        s = around["samples"].combine_chunks().flatten() if around.num_rows else None
        if s is None or not len(x) or not len(s):
            return pa.Table.from_pylist([], schema)
        ts, vs = s.field("t").to_numpy(), s.field("v").to_numpy()
        order = np.argsort(ts, kind="stable")
        origin, ts, vs = ts.min(), (ts - ts.min())[order], vs[order]
        n, mx = len(x), float(x.mean())
        total, yy, xy = np.zeros(len(shift)), np.zeros(len(shift)), np.zeros(len(shift))
        pivot = float(vs.mean())
        for a in range(0, n, chunk):
            y = np.interp((at[a : a + chunk, None] - origin + shift).astype(float), ts, vs) - pivot
            total += y.sum(axis=0)
            yy += (y * y).sum(axis=0)
            xy += (x[a : a + chunk] - mx) @ y
        my, full = total / n, len(shift)
        same = [pa.array([k.as_py()] * full, schema.field(i).type) for i, k in enumerate(key[: len(names)])]
        rows = [np.array(lags, np.int64), np.full(full, n), np.full(full, mx), my + pivot, np.full(full, float(((x - mx) ** 2).sum())), np.maximum(yy - n * my * my, 0.0), xy]
        return pa.Table.from_arrays([*same, *[pa.array(c) for c in rows]], schema=schema)

    kind = StructType([*[StructField(k, own[k]) for k in names], StructField("lag", LongType()), StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("mx", "my", "xx", "yy", "xy")]])
    schema = to_arrow_schema(kind)
    cells = [*names, "_slot"]
    return p.groupBy(*cells).cogroup(packed.groupBy(*cells)).applyInArrow(moments, kind)


def lag_scan(points: DataFrame, refs: DataFrame, who: str, keys: Sequence[str], t: str, signal: str, value: str, lags: Sequence[int], slot_len: int, min_samples: int = 100) -> DataFrame:
    """Correlation of `signal` with the reference at t + lag (linear between samples, held beyond the
    ends), per stream, then averaged over the streams of each `who`: (who, lag, r, streams).

    Streams with fewer than `min_samples` points or reference times are skipped, as are missing
    signals and values and null keys; reference values at one time count as their mean; a stream that
    does not vary has no correlation.
    """
    keys = list(keys)
    p = points.select(*keys, t, signal).where(F.col(signal).isNotNull() & F.col(t).isNotNull())
    r = refs.where(F.col(value).isNotNull() & F.col(t).isNotNull()).groupBy(*keys, t).agg(F.avg(value).alias(value))
    size = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_np")).join(r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), keys)
    size = cut_lineage(size.where((F.col("_np") >= min_samples) & (F.col("_nr") >= min_samples)).select(*keys))
    m = lag_moments(p.join(size, keys, "left_semi"), r.join(size, keys, "left_semi"), keys, t, signal, value, lags, slot_len)
    n = F.sum("n")
    joined = lambda own, a, b: F.sum(own) + F.sum(F.col("n") * F.col(a) * F.col(b)) - F.sum(F.col("n") * F.col(a)) * F.sum(F.col("n") * F.col(b)) / n
    per = m.groupBy(*keys, "lag").agg(n.alias("n"), joined("xx", "mx", "mx").alias("xx"), joined("yy", "my", "my").alias("yy"), joined("xy", "mx", "my").alias("xy"))
    varies = (F.col("xx") > 1e-12 * F.col("n")) & (F.col("yy") > 1e-12 * F.col("n"))
    per = per.where(varies).withColumn("r", F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return per.groupBy(who, "lag").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("streams"))


def best_lag(scan: DataFrame, who: str) -> DataFrame:
    """Lag of the highest correlation (tie: smallest lag) and the correlation without a shift."""
    r = F.round("r", 9)
    return scan.groupBy(who).agg(
        F.max_by("lag", F.struct(r, -F.col("lag"))).alias("best_lag"),
        F.max("r").alias("r_at_best"),
        F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r_at_zero"),
    )


def lag_per_setup(best: DataFrame, setup: str) -> DataFrame:
    """Median of the participants' lags in each setup."""
    q = quantiles(best, [setup], "best_lag", {"setup_lag": 0.5})
    return q.join(best.groupBy(setup).agg(F.count(F.lit(1)).alias("participants")), setup)


def resync(points: DataFrame, who: str, t: str, lags: DataFrame, row_id: str) -> DataFrame:
    """Shift each participant's times by its lag (`lags`: who, lag); no lag means no shift."""
    j = attach(points, lags.select(who, F.col("lag").alias("_lag")), [who], [row_id])
    return j.withColumn(t, F.col(t) + F.coalesce("_lag", F.lit(0))).drop("_lag")


def repair_times(frames: DataFrame, keys: Sequence[str], frame: str, stamp: str, slot_len: int = 100_000) -> DataFrame:
    """Repair presentation stamps by frame number.

    A stamp counts if it lies strictly above every earlier one. Others are filled linearly by
    frame number between good neighbours; the ends are extended with the median period. A stream
    with fewer than MIN_GOOD good stamps gets a fixed frame period.
    """
    d = frames.withColumn("_slot", F.floor(F.col(frame) / slot_len))
    d = running(d, keys, "_slot", [frame], maxes={"_top": stamp})
    good = F.col(stamp).isNotNull() & (F.col("_top").isNull() | (F.col(stamp) > F.col("_top")))
    at = F.struct(F.col(frame).alias("i"), F.col(stamp).alias("p"))
    d = d.withColumn("_good", F.when(good, at)).drop("_top")
    # read several times below, after two passes over the stream
    d = cut_lineage(running(d, keys, "_slot", [frame], lasts={"_prev": "_good"}, nexts={"_next": "_good"}))
    step = F.array(
        F.struct(F.lit("p").alias("of"), (F.col("_good.p") - F.col("_prev.p")).cast("double").alias("step")),
        F.struct(F.lit("i").alias("of"), (F.col("_good.i") - F.col("_prev.i")).cast("double").alias("step")),
    )
    steps = d.where(F.col("_good").isNotNull() & F.col("_prev").isNotNull()).select(*keys, F.inline(step))
    middle = quantiles(steps, [*keys, "of"], "step", {"_step": 0.5})
    period = middle.groupBy(*keys).agg(
        F.max(F.when(F.col("of") == "p", F.col("_step"))).alias("_dp"), F.max(F.when(F.col("of") == "i", F.col("_step"))).alias("_di")
    )
    counts = d.groupBy(*keys).agg(F.count("_good").alias("_ngood")).join(period, list(keys), "left")
    d = attach(d, counts, keys, [frame])
    per = F.col("_dp") / F.greatest(F.col("_di"), F.lit(1.0))
    i, a, b = F.col(frame), F.col("_prev"), F.col("_next")
    t = (
        F.when(F.col("_ngood") < MIN_GOOD, i * FALLBACK_PERIOD_MS)
        .when(F.col("_good").isNotNull(), F.col(stamp))
        .when(a.isNull(), b["p"] - per * (b["i"] - i))
        .when(b.isNull(), a["p"] + per * (i - a["i"]))
        .otherwise(a["p"] + (b["p"] - a["p"]) * (i - a["i"]) / (b["i"] - a["i"]))
    )
    return d.select(*frames.columns, t.cast("double").alias("t_repaired"))


def monotone_clock(rows: DataFrame, keys: Sequence[str], seq: str, t: str, out: str = "t_mono", slot_len: int = 100_000) -> DataFrame:
    """max(t, previous + 1) along `seq` (1, 2, 3, ...): the running maximum of t - seq, plus seq."""
    d = rows.withColumn("_lead", F.col(t) - F.col(seq)).withColumn("_slot", F.floor(F.col(seq) / slot_len))
    d = running(d, keys, "_slot", [seq], maxes={"_top": "_lead"})
    return d.select(*rows.columns, (F.greatest("_lead", "_top") + F.col(seq)).alias(out))


def frame_rate(frames: DataFrame, keys: Sequence[str], t: str, per_second: float) -> DataFrame:
    """(n - 1) / span of each stream, the default rate where there is no span."""
    span = (F.max(t) - F.min(t)) / per_second
    n = F.count(F.lit(1))
    return frames.groupBy(*keys).agg(n.alias("frames"), F.coalesce(F.when(span > 0, (n - 1) / span), F.lit(DEFAULT_FPS)).alias("fps"))


def gaps(frames: DataFrame, keys: Sequence[str], t: str, slot_len: int, tie: str) -> DataFrame:
    """Longest gap between consecutive frames of each stream (0 for a single frame)."""
    d = frames.select(*keys, t, tie).withColumn("_slot", F.floor(F.col(t) / slot_len))
    d = running(d, keys, "_slot", [t, tie], lasts={"_before": t})
    return d.groupBy(*keys).agg(F.coalesce(F.max(F.col(t) - F.col("_before")), F.lit(0)).alias("longest_gap"))


def with_setup(df: DataFrame, setups: DataFrame, who: str, row_id: str, default: Column | None = None) -> DataFrame:
    """Attach a lookup of one row per participant."""
    j = attach(df, setups, [who], [row_id])
    return j if default is None else j.fillna({setups.columns[-1]: default})
