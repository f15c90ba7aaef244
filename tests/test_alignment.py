import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.operators import align as A
from evalgrid.operators import classify as C
from evalgrid.operators import windows as W


def streams(spark, shift, seed=0):
    """30 Hz frames and a 120 Hz reference; frames of participant p are stamped shift[p] ms early."""
    rnd, frames, refs = random.Random(seed), [], []
    phases = [(rnd.uniform(0.3, 1.2), rnd.uniform(0, 6)) for _ in range(3)]

    def x(ms):
        return 0.5 + sum(0.12 * math.sin(2 * math.pi * f * ms / 1000 + p) for f, p in phases)

    for p, s in shift.items():
        for v in ("a", "b"):
            refs += [(p, v, i * 8, x(i * 8), 1) for i in range(1500)]
            frames += [(p, v, i, i * 33, x(i * 33 + s) + rnd.gauss(0, 0.01)) for i in range(350)]
    f = spark.createDataFrame(frames, "who string, video string, frame int, t bigint, px double")
    return f, spark.createDataFrame(refs, "who string, video string, t bigint, tx double, ok int")


def test_lag_is_recovered(spark):
    f, r = streams(spark, {"late": 300, "right": 0})
    scan = A.lag_scan(f, r, "who", ["who", "video"], "t", "px", "tx", list(range(-600, 601, 30)), 1000)
    best = {x["who"]: x for x in A.best_lag(scan, "who").collect()}
    assert abs(best["late"]["best_lag"] - 300) <= 30 and best["right"]["best_lag"] == 0
    assert best["late"]["r_at_best"] > 0.95 > best["late"]["r_at_zero"]
    short = A.lag_scan(f.where("frame < 50"), r, "who", ["who", "video"], "t", "px", "tx", [0], 1000)
    assert short.count() == 0  # too few samples on one side


def nearest(spark, frames, refs, tol=20):
    f = spark.createDataFrame([("p", i, t) for i, t in enumerate(frames)], "who string, id int, t bigint")
    r = spark.createDataFrame([("p", *x) for x in refs], "who string, t bigint, v double, ok int")
    a = A.nearest_sample(f, r, ["who"], "t", 50, tol, ["v"], "ok")
    b = A.nearest_within(f, r, ["who"], "t", tol, ["v"], "ok", "id")
    assert {x["id"]: x["v"] for x in a.collect()} == {x["id"]: x["v"] for x in b.collect()}
    return {x["id"]: (x["dt"], x["v"]) for x in a.collect()}


def test_nearest_rules(spark):
    got = nearest(spark, [105, 131, 500, 5], [(100, 1.0, 1), (110, 2.0, 1), (130, 3.0, 0), (140, 4.0, 1)])
    assert got[0] == (5, 1.0)  # tie: the earlier sample
    assert got[1] == (1, None)  # the nearest sample is invalid, a valid one further away does not count
    assert got[2] == (360, None)  # too far, distance kept
    assert got[3] == (95, None)


def test_nearest_against_brute_force(spark):
    rnd = random.Random(3)
    ts = sorted(rnd.sample(range(5000), 200))
    refs = [(t, float(t), int(rnd.random() > 0.2)) for t in ts]
    frames = [rnd.randrange(5200) for _ in range(150)]
    got = nearest(spark, frames, refs)
    for i, t in enumerate(frames):
        s = min(refs, key=lambda r: (abs(r[0] - t), r[0]))
        assert got[i] == (abs(s[0] - t), s[1] if abs(s[0] - t) <= 20 and s[2] else None)


def test_interpolation_holds_the_ends(spark):
    r = spark.createDataFrame([("p", 100, 1.0), ("p", 200, 3.0)], "who string, t bigint, v double")
    f = spark.createDataFrame([("p", t) for t in (0, 100, 150, 200, 900)], "who string, t bigint")
    assert {x["t"]: x["ref"] for x in A.interpolate(f, r, ["who"], "t", 100, "v").collect()} == {0: 1.0, 100: 1.0, 150: 2.0, 200: 3.0, 900: 3.0}


@pytest.mark.parametrize("slot", [3, 100_000])
def test_repaired_stamps(spark, slot):
    stalled = [None, 0.0, 33.0, 33.0, None, 133.0, 100.0, 200.0, 233.0, 266.0, None, 2266.0, 2300.0, 2300.0]
    # median period 34 at the ends, straight lines in between, good stamps untouched
    fixed = [-34.0, 0.0, 33.0, 66.3333, 99.6667, 133.0, 166.5, 200.0, 233.0, 266.0, 1266.0, 2266.0, 2300.0, 2334.0]
    few = [0.0, None, 10.0, 5.0, None]
    rows = [("a", i, v) for i, v in enumerate(stalled)] + [("b", i, v) for i, v in enumerate(few)]
    d = spark.createDataFrame(rows, "who string, frame bigint, pts double").repartition(5)
    got = A.repair_times(d, ["who"], "frame", "pts", slot).orderBy("who", "frame").collect()
    assert [r["t_repaired"] for r in got if r["who"] == "a"] == pytest.approx(fixed, abs=1e-3)
    assert [r["t_repaired"] for r in got if r["who"] == "b"] == pytest.approx([0.0, 33.3, 66.6, 99.9, 133.2])


def test_monotone_clock(spark):
    ts, want, last = [5, 5, 4, 9, 9, 20, 1], [], -1
    for t in ts:
        last = max(t, last + 1)
        want.append(last)
    d = spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(ts)], "who string, seq bigint, t bigint")
    for slot in (2, 1000):
        assert [r["t_mono"] for r in A.monotone_clock(d, ["who"], "seq", "t", slot_len=slot).orderBy("seq").collect()] == want


def windows_case(spark, shared):
    """40 still windows of 500 ms; frames see the target with noise per frame, or per window."""
    rnd, refs, frames = random.Random(1), [], []
    for k in range(40):
        x, y, off = rnd.uniform(0.1, 0.9), rnd.uniform(0.1, 0.9), rnd.gauss(0, 0.12)
        refs += [("p", k * 500 + i * 8, x + rnd.gauss(0, 0.002), y, 1) for i in range(62)]
        for i in range(15):
            e = off if shared else rnd.gauss(0, 0.12)
            frames.append(("p", len(frames), k * 500 + i * 33 + 5, x + e + rnd.gauss(0, 0.01), y))
    r = spark.createDataFrame(refs, "who string, t bigint, tx double, ty double, ok int")
    f = spark.createDataFrame(frames, "who string, id int, t bigint, px double, py double")
    w = W.dwell_windows(r, ["who"], "t", "tx", "ty", "ok", [500], [0.03], 120 / 1000)
    inside = W.assign_frames(f, w, r, ["who"], "t", [500], "id")
    acc = W.window_answers(inside, w, ["who"], "t", F.lit(30 * 0.5), [("1x3", 1, 3)]).groupBy("method").agg(F.avg(F.col("ok").cast("double")).alias("a"))
    icc = C.shared_error(inside.select(F.lit("x").alias("axis"), "k", (F.col("px") - F.col("gx")).alias("e")), ["k"]).first()["icc"]
    return {x["method"]: x["a"] for x in acc.collect()}, icc


def test_averaging_helps_only_independent_noise(spark):
    own, icc_own = windows_case(spark, shared=False)
    same, icc_same = windows_case(spark, shared=True)
    assert icc_own < 0.2 and icc_same > 0.9
    assert own["mean"] > own["single"] + 0.05
    assert abs(same["mean"] - same["single"]) < 0.06


def test_unstable_and_unanswered_windows(spark):
    refs = [("p", i * 8, 0.2, 0.2, 1) for i in range(62)] + [("p", 500 + i * 8, 0.2 + 0.5 * (i % 2), 0.2, 1) for i in range(62)] + [("p", 1000 + i * 8, 0.2, 0.2, int(i % 2)) for i in range(62)]
    refs += [("p", 1500 + i * 8, 0.2, 0.2, 1) for i in range(62)]
    r = spark.createDataFrame(refs, "who string, t bigint, tx double, ty double, ok int")
    w = W.dwell_windows(r, ["who"], "t", "tx", "ty", "ok", [500], [0.03], 0.12)
    assert sorted(x["k"] for x in w.collect()) == [0, 3]  # 1 moves, 2 has too few valid samples
    f = spark.createDataFrame([("p", i, i * 33, 0.2, 0.2) for i in range(15)] + [("p", 99, 1600, 0.2, 0.2)], "who string, id int, t bigint, px double, py double")
    a = W.window_answers(W.assign_frames(f, w, r, ["who"], "t", [500], "id"), w, ["who"], "t", F.lit(15.0), [("1x3", 1, 3)])
    assert {(x["k"], x["answered"], x["ok"]) for x in a.collect()} == {(0, True, True), (3, False, False)}


@pytest.mark.parametrize("slot", [90, 500, 10_000])
def test_fixations(spark, slot):
    still = [(t, 0.3) for t in range(0, 201, 8)]  # 0..200: one fixation
    jump = [(t, 0.8) for t in range(208, 281, 8)]  # too short before the gap
    after = [(t, 0.8) for t in range(400, 561, 8)]  # unbroken again: a second one
    moving = [(568 + 8 * i, 0.1 + 0.05 * i) for i in range(15)]
    lost = [(t, 0.8) for t in range(284, 400, 8)]  # invalid samples do not bridge a gap
    rows = [("p", t, x, 0.5, 1) for t, x in still + jump + after + moving] + [("p", t, x, 0.5, 0) for t, x in lost]
    d = spark.createDataFrame(rows, "who string, t bigint, x double, y double, ok int")
    got = W.fixations(d, ["who"], "t", "x", "y", "ok", 100, 0.04, slot)
    assert sorted((r["start"], r["end"]) for r in got.collect()) == [(0.0, 200.0), (400.0, 560.0)]


@pytest.mark.parametrize("slot", [60, 700])
def test_fixations_match_a_greedy_walk(spark, slot):
    """Long and short rests over many slots, equal times, gaps, null keys."""
    rnd, rows = random.Random(slot), []
    for who in ("a", "b", None):
        t, x, y = 0, 0.5, 0.5
        for _ in range(260):
            t += rnd.choice([0, 8, 8, 8, 16, 40]) if rnd.random() < 0.99 else 300
            if rnd.random() < 0.03:
                x, y = rnd.random(), rnd.random()
            rows.append((who, t, round(x + rnd.uniform(-0.01, 0.01), 3), round(y + rnd.uniform(-0.01, 0.01), 3), int(rnd.random() < 0.99)))
    want = []
    for who in ("a", "b", None):
        s = sorted((t, x, y) for w, t, x, y, ok in rows if w == who and ok)
        i = 0
        while i < len(s):
            j = i
            while j + 1 < len(s) and s[j + 1][0] - s[j][0] <= 50:
                box = s[i : j + 2]
                if (max(p[1] for p in box) - min(p[1] for p in box)) + (max(p[2] for p in box) - min(p[2] for p in box)) > 0.04:
                    break
                j += 1
            if s[j][0] - s[i][0] >= 100:
                want.append((who, float(s[i][0]), float(s[j][0])))
                i = j
            i += 1
    d = spark.createDataFrame(rows, "who string, t bigint, x double, y double, ok int").repartition(5)
    got = [(r["who"], r["start"], r["end"]) for r in W.fixations(d, ["who"], "t", "x", "y", "ok", 100, 0.04, slot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 20
    assert W.fixations(d.limit(0), ["who"], "t", "x", "y", "ok", 100, 0.04, slot).count() == 0


def test_time_median_uses_a_time_range(spark):
    pts = [(0, 1.0), (100, 5.0), (170, 2.0), (300, 9.0), (301, 9.5)]
    d = spark.createDataFrame([("p", t, v) for t, v in pts], "who string, t bigint, v double")
    want = {t: float(np.median([v for s, v in pts if t - 180 <= s <= t])) for t, _ in pts}
    for slot in (200, 5000):
        assert {r["t"]: r["smooth"] for r in W.time_median(d, ["who"], "t", "v", 180, slot).collect()} == want


def test_registered_scan_reads_161_lags(spark):
    from evalgrid.plans import alignment as P

    assert len(P.LAGS) == 161 and {b - a for a, b in zip(P.LAGS, P.LAGS[1:])} == {P.LAG_STEP} and 0 in P.LAGS and P.MIN_SAMPLES == 100
    got = P.lag_scan(spark, "/root/testdata/sf0.01")
    assert got.count() == 161 * P.STREAMS and got.select("lag").distinct().count() == 161


@pytest.mark.parametrize("slot_len", [50, 700, 10_000])
def test_lag_scan_matches_a_plain_interpolation(spark, slot_len):
    """Sparse samples, gaps longer than the halo, equal times, missing values, slots without samples."""
    rnd = random.Random(slot_len)
    points, refs = [], []
    for who in ("a", "b"):
        at = 0
        for _ in range(120):
            at += rnd.choice([3, 9, 40, 400])
            points.append((who, at, None if rnd.random() < 0.05 else rnd.random()))
        points.append((who, at, 0.5))
        at = 500
        for _ in range(100):
            at += rnd.choice([0, 7, 120, 900])
            refs.append((who, at, None if rnd.random() < 0.05 else rnd.random()))
    refs += [("c", 1, 1.0)] * 200
    points += [("c", i, 1.0) for i in range(200)] + [(None, i, 1.0) for i in range(200)]
    p = spark.createDataFrame(points, "who string, t bigint, x double").repartition(4)
    r = spark.createDataFrame(refs, "who string, t bigint, v double").repartition(3)
    lags = list(range(-300, 301, 50))
    got = {(x["who"], x["lag"]): x["r"] for x in A.lag_scan(p, r, "who", ["who"], "t", "x", "v", lags, slot_len, 40).collect()}
    assert {k[0] for k in got} == {"a", "b"} and len(got) == 2 * len(lags)
    for who in ("a", "b"):
        by = {}
        for w, t, v in refs:
            if w == who and v is not None:
                by.setdefault(t, []).append(v)
        ts = sorted(by)
        xs = [(t, x) for w, t, x in points if w == who and x is not None]
        for lag in lags:
            ref = np.interp([t + lag for t, _ in xs], ts, [np.mean(by[t]) for t in ts])
            assert got[who, lag] == pytest.approx(np.corrcoef([x for _, x in xs], ref)[0, 1], abs=1e-9)


def test_fixation_slots_are_not_turned_into_pandas_frames(spark, monkeypatch):
    """A stream has many slots of few samples: a frame for each took most of the time."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    def refuse(*_):
        raise AssertionError("a pandas frame per slot")

    for kind in (PandasCogroupedOps, PandasGroupedOpsMixin):
        monkeypatch.setattr(kind, "applyInPandas", refuse)
    d = spark.createDataFrame([("p", 8 * i, 0.3, 0.5, 1) for i in range(20)], "who string, t bigint, x double, y double, ok int")
    assert [(r["start"], r["end"]) for r in W.fixations(d, ["who"], "t", "x", "y", "ok", 100, 0.04, 500).collect()] == [(0.0, 152.0)]
