"""Dwell windows, window answers, fixations and sliding statistics."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.zones import NO_ZONE, grid_list, zone_of
from evalgrid.operators.chain import jump_chain
from evalgrid.operators.skew import attach, haloed, join_on, quantiles, running
from evalgrid.session import cut_lineage

# Share of valid samples, share of frames, smoothing span, live-rate window,
# frame-rate floor, largest gap inside a fixation.
MIN_VALID = 0.7
MIN_FRAMES = 0.5
SMOOTH_MS = 180
RATE_FRAMES = 40
MIN_FPS = 15.0
FIXATION_GAP_MS = 50


def window_index(df: DataFrame, start: DataFrame, keys: Sequence[str], t: str, lengths: Sequence[int], spread_by: Sequence[str]) -> DataFrame:
    """Explode rows over window lengths: dwell, k = window number from the stream's own start."""
    j = attach(df, start, keys, spread_by, how="inner").where(F.col(t) >= F.col("t0"))
    j = j.withColumn("dwell", F.explode(F.array(*[F.lit(n).cast("bigint") for n in lengths])))
    return j.withColumn("k", F.floor((F.col(t) - F.col("t0")) / F.col("dwell")))


def stream_start(refs: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    return refs.groupBy(*keys).agg(F.min(t).alias("t0"))


def dwell_windows(refs: DataFrame, keys: Sequence[str], t: str, x: str, y: str, valid: str, lengths: Sequence[int], dispersions: Sequence[float], per_unit_rate: float) -> DataFrame:
    """Stable windows laid end to end over each reference stream, for all settings in one pass.

    A window counts if at least 70 % of the expected samples (rate x length) are valid and their
    spread sqrt(var x + var y) is at most the dispersion; a single sample has no spread.
    """
    start = stream_start(refs, keys, t)
    ix = window_index(refs.select(*keys, t, x, y, valid), start, keys, t, lengths, [t]).where(F.col(valid) == 1)
    g = ix.groupBy("dwell", *keys, "k").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("gx"), F.avg(y).alias("gy"), F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.first("t0").alias("t0")
    )
    g = g.where(F.col("n") >= MIN_VALID * F.col("dwell") * per_unit_rate)
    g = g.withColumn("disp", F.explode(F.array(*[F.lit(float(d)) for d in dispersions])))
    g = g.where(F.sqrt(F.col("_vx") + F.col("_vy")) <= F.col("disp"))
    w_start = F.col("t0") + F.col("k") * F.col("dwell")
    return g.select("dwell", "disp", *keys, "k", w_start.alias("w_start"), (w_start + F.col("dwell")).alias("w_end"), "n", "gx", "gy")


def assign_frames(frames: DataFrame, windows: DataFrame, refs: DataFrame, keys: Sequence[str], t: str, lengths: Sequence[int], row_id: str) -> DataFrame:
    """Frames inside a window. Windows lie on a grid, so w_start <= t < w_end is an equi-join on
    (dwell, key, k) and one hot stream is spread over its windows."""
    ix = window_index(frames, stream_start(refs, keys, t), keys, t, lengths, [row_id]).drop("t0")
    return ix.join(windows, ["dwell", *keys, "k"])


def window_answers(inside: DataFrame, windows: DataFrame, keys: Sequence[str], t: str, expected: Column, grids=None) -> DataFrame:
    """Zone of each window by grid and method: single (frame nearest the centre, earliest on a
    tie), mean, median, vote (tie: zone of the mean). Too few frames: no answer.

    A window holds at most rate x length frames, so the per-window median is bounded.
    """
    wkey = ["dwell", "disp", *keys, "k"]
    off = F.abs(F.col(t) - (F.col("w_start") + F.col("w_end")) / 2)
    per = inside.groupBy(*wkey).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min_by(F.struct("px", "py"), F.struct(off, F.col(t))).alias("single"),
        F.struct(F.avg("px").alias("px"), F.avg("py").alias("py")).alias("mean"),
        F.struct(F.percentile("px", F.lit(0.5)).alias("px"), F.percentile("py", F.lit(0.5)).alias("py")).alias("median"),
    )
    grid = grid_list(grids)
    votes = inside.select(*wkey, "px", "py", F.inline(grid)).withColumn("z", zone_of("px", "py", "rows", "cols")).where(F.col("z") != NO_ZONE)
    votes = votes.groupBy(*wkey, "grid", "z").agg(F.count(F.lit(1)).alias("c"))
    top = votes.groupBy(*wkey, "grid").agg(F.max("c").alias("most"), F.max_by("z", F.struct(F.col("c"), -F.col("z"))).alias("z"), F.collect_list("c").alias("cs"))
    top = top.select(*wkey, "grid", "z", (F.size(F.filter("cs", lambda c: c == F.col("most"))) == 1).alias("alone"))
    w = windows.join(per, wkey, "left").select("*", F.inline(grid)).join(top, [*wkey, "grid"], "left")
    enough = F.coalesce(F.col("frames") >= MIN_FRAMES * F.greatest(expected, F.lit(1.0)), F.lit(False))
    zone = {m: zone_of(F.col(f"{m}.px"), F.col(f"{m}.py"), "rows", "cols") for m in ("single", "mean", "median")}
    zone["vote"] = F.when(F.col("alone"), F.col("z")).otherwise(zone["mean"])
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.when(enough, z).otherwise(F.lit(NO_ZONE)).alias("zp")) for m, z in zone.items()])
    out = w.withColumn("zt", zone_of("gx", "gy", "rows", "cols"))
    return out.select(*wkey, "grid", "zt", enough.alias("answered"), F.inline(methods)).withColumn("ok", (F.col("zp") == F.col("zt")) & (F.col("zp") != NO_ZONE))


def time_median(df: DataFrame, keys: Sequence[str], t: str, value: str, span: int, slot_len: int, out: str = "smooth") -> DataFrame:
    """Median of the values of the last `span` time units (a time range, not a row count)."""
    d = haloed(df, keys, t, slot_len, span)
    w = Window.partitionBy(*keys, "slot").orderBy(t).rangeBetween(-span, 0)
    return d.withColumn(out, F.percentile(value, F.lit(0.5)).over(w)).where("_own").drop("_own", "slot")


def slow_frames(df: DataFrame, keys: Sequence[str], seq: str, value: str, limit: float, last: int = RATE_FRAMES, slot_len: int = 100_000) -> DataFrame:
    """Median of the last `last` frame times, and whether it is above `limit`; null until then."""
    d = haloed(df, keys, seq, slot_len, last - 1)
    w = Window.partitionBy(*keys, "slot").orderBy(seq).rowsBetween(-(last - 1), 0)
    d = d.withColumn("recent", F.when(F.col(seq) >= last, F.percentile(value, F.lit(0.5)).over(w)))
    return d.where("_own").drop("_own", "slot").withColumn("slow", F.col("recent") > limit)


def rate_report(slow: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per session: frames, share judged slow, median and 95th percentile of the frame time."""
    s = slow.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count("slow").alias("judged"), F.avg(F.col("slow").cast("double")).alias("slow_share")
    )
    return s.join(quantiles(slow, keys, value, {"median_ms": 0.5, "p95_ms": 0.95}), list(keys), "left")


def _reach(values: np.ndarray, limit: float) -> np.ndarray:
    """For each sample the last one up to which the spread (range of x + range of y) stays within
    the limit. It never moves back, so both ends of one window advance, with the window's extremes
    kept in monotone queues."""
    n = len(values)
    series = np.c_[values, -values].T.tolist()  # the spread is the sum of these four maxima
    queues = [deque() for _ in series]
    out, end = np.empty(n, np.int64), -1
    for start in range(n):
        while end + 1 < n:
            k = end + 1
            x1, y1, x0, y0 = (max(s[q[0]], s[k]) if q else s[k] for q, s in zip(queues, series))
            if k > start and (x1 + x0) + (y1 + y0) > limit:
                break
            for q, s in zip(queues, series):
                while q and s[q[-1]] <= s[k]:
                    q.pop()
                q.append(k)
            end = k
        out[start] = end
        for q in queues:
            if q and q[0] == start:
                q.popleft()
    return out


_BOX = ["_x0", "_x1", "_y0", "_y1"]  # smallest and largest x and y since a start


def _boxes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest and largest x and y up to each sample."""
    return np.c_[np.minimum.accumulate(x), np.maximum.accumulate(x), np.minimum.accumulate(y), np.maximum.accumulate(y)]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.c_[np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 1], b[:, 1]), np.minimum(a[:, 2], b[:, 2]), np.maximum(a[:, 3], b[:, 3])]


def _spread(box: np.ndarray) -> np.ndarray:
    return (box[:, 1] - box[:, 0]) + (box[:, 3] - box[:, 2])


def reaches(v: DataFrame, run: Sequence[str], disp: float) -> DataFrame:
    """For each sample of `v` (run keys, _slot, place, t, x, y) the place and time of the last sample of
    its run up to which range of x + range of y stay within `disp`: (run keys, place, t, end, end_t).

    A slot is searched by itself, with monotone queues. Starts that reach its last sample are carried,
    as a box of four numbers, to the run's next slot, whose boxes from its first sample only grow, so
    the end is found by bisection; this is repeated while some start is carried on. No task holds more
    than a slot and the starts carried into it, and the rounds are the slots of the longest stillness.
    """
    run = list(run)
    slots = v.select(*run, "_slot").distinct()
    by = Window.partitionBy(*run).orderBy("_slot")
    slots = cut_lineage(slots.select(*run, "_slot", F.row_number().over(by).alias("_part")))  # slots of a run without holes
    v = cut_lineage(join_on(v, slots, [*run, "_slot"]).drop("_slot"))
    fields = ", ".join(f"{k} {v.schema[k].dataType.simpleString()}" for k in run)
    out = f"{fields}, place bigint, t bigint, end bigint, end_t bigint, _part int, {', '.join(f'{c} double' for c in _BOX)}, _open boolean"
    names = [*run, "place", "t", "end", "end_t", "_part", *_BOX, "_open"]

    def table(of: pa.Table, *columns: np.ndarray) -> pa.Table:
        """The run keys of `of` and the other columns of `names`."""
        return pa.Table.from_arrays([*(of[k] for k in run), *(pa.array(c) for c in columns)], names)

    def samples(rows: pa.Table) -> tuple[np.ndarray, ...]:
        order = np.argsort(rows["place"].to_numpy(), kind="stable")
        return tuple(rows[c].to_numpy()[order] for c in ("place", "t", "x", "y"))

    def own(rows: pa.Table) -> pa.Table:
        place, t, x, y = samples(rows)  # the keys and the part are one for all rows
        reach = _reach(np.c_[x, y], disp)
        back = _boxes(x[::-1], y[::-1])[::-1]  # from each sample to the slot's end
        return table(rows, place, t, place[reach], t[reach], rows["_part"].to_numpy(), *back.T.copy(), reach == len(place) - 1)

    def onward(starts: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(starts):
            return starts.select(names)
        at_place, at_t, end, end_t = (starts[c].to_numpy() for c in ("place", "t", "end", "end_t"))
        had, part = np.c_[tuple(starts[c].to_numpy() for c in _BOX)], starts["_part"].to_numpy() + np.int32(1)
        if not len(rows):  # the run is over: what was reached stays
            return table(starts, at_place, at_t, end, end_t, part, *had.T.copy(), np.zeros(len(starts), bool))
        place, t, x, y = samples(rows)
        boxes = _boxes(x, y)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(place))  # number of samples within
        while (low < high).any():
            mid = (low + high) // 2
            fits = _spread(_joined(had, boxes[np.minimum(mid, len(place) - 1)])) <= disp
            more = (low < high) & fits
            low, high = np.where(more, mid + 1, low), np.where((low < high) & ~fits, mid, high)
        some = low > 0
        at = np.maximum(low - 1, 0)
        end, end_t = np.where(some, place[at], end), np.where(some, t[at], end_t)
        return table(starts, at_place, at_t, end, end_t, part, *_joined(had, boxes[at]).T.copy(), low == len(place))

    found = cut_lineage(v.groupBy(*run, "_part").applyInArrow(own, out))
    done, todo = [found.where("NOT _open")], found.where("_open")
    while not todo.isEmpty():
        asked = todo.withColumn("_key", F.col("_part") + 1)
        met = asked.groupBy(*run, "_key").cogroup(join_on(v, asked.select(*run, F.col("_key").alias("_part")).distinct(), [*run, "_part"]).withColumn("_key", F.col("_part")).groupBy(*run, "_key"))
        found = cut_lineage(met.applyInArrow(onward, out))
        done.append(found.where("NOT _open"))
        todo = found.where("_open")
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    return every.select(*run, "place", "t", "end", "end_t")


def fixations(refs: DataFrame, keys: Sequence[str], t: str, x: str, y: str, valid: str, min_ms: float, disp: float, slot_len: int, gap: float = FIXATION_GAP_MS) -> DataFrame:
    """Dispersion-threshold fixations (keys, start, end) of valid samples, times as whole numbers.

    No fixation spans a gap longer than `gap`. In each unbroken run the first sample whose reach lasts
    `min_ms` opens a fixation, the next one is looked for behind its end. Reaches are found slot by slot
    and the greedy choice by doubling steps, so no task holds a run. Samples at one time are taken in
    order of x and y; null keys are a key.
    """
    keys = list(keys)
    v = refs.where((F.col(valid) == 1) & F.col(t).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    v = v.select(*keys, F.col(t).cast("bigint").alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    v = v.withColumn("_slot", F.floor(F.col("t") / slot_len))
    v = running(v, keys, "_slot", ["t", "x", "y"], count="place", lasts={"_before": "t"})
    v = v.withColumn("place", F.col("place").cast("bigint")).withColumn("_cut", F.coalesce(F.col("t") - F.col("_before") > gap, F.lit(True)).cast("int"))
    v = running(v, keys, "_slot", ["place"], sums={"_cuts": "_cut"}).withColumn("_run", (F.col("_cuts") + F.col("_cut")).cast("bigint"))
    run = [*keys, "_run"]
    lasting = reaches(v.select(*run, "_slot", "place", "t", "x", "y"), run, disp).where(F.col("end_t") - F.col("t") >= min_ms)
    picked = jump_chain(lasting, run, "place", F.col("end") + 1, 1 << 16)
    return picked.select(*keys, F.col("t").cast("double").alias("start"), F.col("end_t").cast("double").alias("end"))
