"""Two-stream queries: nearest sample, lag scan, dwell windows and their answers, clocks, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.functions.scores import readings_per_dwell
from evalgrid.operators import align as A
from evalgrid.operators import windows as W
from evalgrid.operators.resample import REPS, metric_intervals
from evalgrid.operators.skew import running
from evalgrid.plans.classification import r6, rounded
from evalgrid.plans.registry import query
from evalgrid.plans.roles import DAY, HOUR, base, bootstrap_sql, frame_stream, reference_stream, sql
from evalgrid.session import cut_lineage

EPOCH_MS = 1704067200000


def _refs(spark, sf):
    r = reference_stream(spark, sf)
    return r.withColumn("video", F.floor(F.col("t_us") / (10 * DAY))).withColumn("tx", F.col("tx") / 500).withColumn("ty", F.pmod(F.floor(F.col("t_us") / 1000), F.lit(1000)) / 1000)


def _frames(spark, sf):
    f = frame_stream(spark, sf)
    return f.withColumn("video", F.floor(F.col("t_us") / (10 * DAY))).withColumn("px", F.col("px") / 500).withColumn("py", (F.col("event_id") % 97) / F.lit(97.0))


_STREAMS = """
rf AS (SELECT participant, t_us//864000000000 AS video, t_us, tx/500 AS tx, ((t_us//1000)%1000)/1000 AS ty, tvalid FROM rs),
fm AS (SELECT participant, t_us//864000000000 AS video, event_id, t_us, px/500 AS px, (event_id%97)/97e0 AS py, k FROM fr)"""

_NEAR = """
p AS (SELECT fr.event_id, fr.participant, fr.t_us, rs.t_us AS pt, rs.tx AS px_, rs.tvalid AS pv FROM fr ASOF LEFT JOIN rs ON fr.participant=rs.participant AND fr.t_us>=rs.t_us),
n AS (SELECT p.*, rs.t_us AS nt, rs.tx AS nx, rs.tvalid AS nv FROM p ASOF LEFT JOIN rs ON p.participant=rs.participant AND p.t_us<rs.t_us),
c AS (SELECT *, nt IS NULL OR (pt IS NOT NULL AND t_us-pt<=nt-t_us) AS back FROM n),
d AS (SELECT event_id, participant, CASE WHEN back THEN t_us-pt ELSE nt-t_us END AS dt, CASE WHEN back THEN px_ ELSE nx END AS x, CASE WHEN back THEN pv ELSE nv END AS v FROM c)"""


@query("q_c3_nearest", sql(f"""WITH {_NEAR}
SELECT event_id, participant, dt, CASE WHEN dt<={6*HOUR} AND v=1 THEN x END AS tx FROM d""", "fr", "rs"))
def nearest(spark, sf):
    n = A.nearest_sample(frame_stream(spark, sf), reference_stream(spark, sf), ["participant"], "t_us", DAY, 6 * HOUR, ["tx"], "tvalid")
    return n.select("event_id", "participant", "dt", "tx")


@query("q_c3_nearest_within", sql(f"""WITH {_NEAR}
SELECT event_id, participant, CASE WHEN dt<={6*HOUR} AND v=1 THEN x END AS tx FROM d""", "fr", "rs"))
def nearest_within(spark, sf):
    n = A.nearest_within(frame_stream(spark, sf), reference_stream(spark, sf), ["participant"], "t_us", 6 * HOUR, ["tx"], "tvalid", "event_id")
    return n.select("event_id", "participant", "tx")


# 161 evenly spaced lags over a day, 100 samples a stream; a stream is a group of users
LAG_STEP = 24 * HOUR // 160
LAGS = [i * LAG_STEP for i in range(-80, 81)]
STREAMS, MIN_SAMPLES = 15, 100
_SCAN = f"""{_STREAMS},
fp AS (SELECT participant%{STREAMS} AS stream, event_id, t_us, px FROM fm), rp AS (SELECT participant%{STREAMS} AS stream, t_us, avg(tx) AS tx FROM rf WHERE tx IS NOT NULL GROUP BY 1,2),
ok AS (SELECT stream FROM (SELECT stream, count(px) n FROM fp GROUP BY 1) a JOIN (SELECT stream, count(*) m FROM rp GROUP BY 1) r USING (stream) WHERE n>={MIN_SAMPLES} AND m>={MIN_SAMPLES}),
sh AS (SELECT f.stream, f.px, l.h*{LAG_STEP} AS lag, f.t_us+l.h*{LAG_STEP} AS t FROM fp f JOIN ok USING (stream), (SELECT unnest(range(-80,81)) h) l WHERE f.px IS NOT NULL),
p AS (SELECT sh.*, rp.t_us AS pt, rp.tx AS pv FROM sh ASOF LEFT JOIN rp ON sh.stream=rp.stream AND sh.t>=rp.t_us),
n AS (SELECT p.*, rp.t_us AS nt, rp.tx AS nv FROM p ASOF LEFT JOIN rp ON p.stream=rp.stream AND p.t<rp.t_us),
i AS (SELECT stream, lag, px, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv ELSE pv+(nv-pv)*(CAST(t-pt AS DOUBLE)/(nt-pt)) END AS ref FROM n),
scan AS (SELECT stream, lag, CAST(avg(r) AS DOUBLE) AS r, count(*) AS streams FROM (SELECT stream, lag, CASE WHEN stddev_pop(ref)>0 AND stddev_pop(px)>0 THEN corr(px,ref) END AS r FROM i GROUP BY 1,2) WHERE r IS NOT NULL GROUP BY 1,2),
best AS (SELECT stream, max(r) AS r_at_best, max(CASE WHEN lag=0 THEN r END) AS r_at_zero, arg_max(lag, (round(r,9), -lag)) AS best_lag FROM scan GROUP BY 1)"""


def _scan(spark, sf):
    stream = (F.col("participant") % STREAMS).alias("stream")
    return A.lag_scan(_frames(spark, sf).select(stream, "t_us", "px"), _refs(spark, sf).select(stream, "t_us", "tx"), "stream", ["stream"], "t_us", "px", "tx", LAGS, DAY, MIN_SAMPLES)


@query("q_d13_lag_scan", sql(f"WITH {_SCAN} SELECT stream, lag, round(r,6) AS r, streams FROM scan", "fr", "rs"))
def lag_scan(spark, sf):
    return rounded(_scan(spark, sf), "r")


def _setup(of):
    return F.when(F.col(of) % 2 == 0, "Laptop").otherwise("PC").alias("setup")


def _setup_lags(spark, sf):
    return A.lag_per_setup(A.best_lag(_scan(spark, sf), "stream").select("*", _setup("stream")), "setup")


@query("q_d14_setup_lag", sql(f"""WITH {_SCAN},
s AS (SELECT CASE WHEN stream%2=0 THEN 'Laptop' ELSE 'PC' END AS setup, best_lag FROM best)
SELECT setup, round(quantile_cont(best_lag,0.5),6) AS setup_lag, count(*) AS participants FROM s GROUP BY 1""", "fr", "rs"))
def setup_lag(spark, sf):
    return rounded(_setup_lags(spark, sf), "setup_lag")


@query("q_d14_resync", sql(f"""WITH {_SCAN},
s AS (SELECT CASE WHEN stream%2=0 THEN 'Laptop' ELSE 'PC' END AS setup, quantile_cont(best_lag,0.5) AS lag FROM best GROUP BY 1)
SELECT event_id, round(t_us+lag,0) AS t_synced FROM fp JOIN s ON s.setup=CASE WHEN stream%2=0 THEN 'Laptop' ELSE 'PC' END""", "fr", "rs"))
def resynced(spark, sf):
    f = _frames(spark, sf).withColumn("stream", F.col("participant") % STREAMS).select("*", _setup("stream"))
    lags = _setup_lags(spark, sf).select("setup", F.col("setup_lag").alias("lag"))
    return A.resync(f.join(lags, "setup", "left_semi"), "setup", "t_us", lags, "event_id").select("event_id", F.round("t_us", 0).alias("t_synced"))


LENGTHS, DISPS, RATE = [5 * DAY, 10 * DAY], [0.2, 0.4], 0.4 / DAY
_WIN = f"""{_STREAMS},
st AS (SELECT participant, min(t_us) AS t0 FROM rf GROUP BY 1),
ln AS (SELECT * FROM (VALUES ({5*DAY}),({10*DAY})) l(dwell)), ds AS (SELECT * FROM (VALUES (2e-1),(4e-1)) d(disp)),
g AS (SELECT dwell, participant, (t_us-t0)//dwell AS k, count(*) AS n, avg(tx) AS gx, avg(ty) AS gy, var_samp(tx) AS vx, var_samp(ty) AS vy, any_value(t0) AS t0
  FROM rf JOIN st USING (participant), ln WHERE tvalid=1 GROUP BY 1,2,3),
w AS (SELECT dwell, disp, participant, k, t0+k*dwell AS w_start, t0+(k+1)*dwell AS w_end, n, gx, gy FROM g, ds
  WHERE n >= 7e-1*dwell*{RATE!r} AND sqrt(vx+vy)<=disp)"""


def _windows(spark, sf):
    return W.dwell_windows(_refs(spark, sf), ["participant"], "t_us", "tx", "ty", "tvalid", LENGTHS, DISPS, RATE)


@query("q_g4_windows", sql(f"""WITH {_WIN}
SELECT dwell, disp, participant, k, w_start, w_end, n, round(gx,6) AS gx, round(gy,6) AS gy FROM w""", "fr", "rs"))
def dwell_windows(spark, sf):
    return rounded(_windows(spark, sf), "gx", "gy")


def _inside(spark, sf, windows):
    return W.assign_frames(_frames(spark, sf).drop("video"), windows, _refs(spark, sf), ["participant"], "t_us", LENGTHS, "event_id")


@query("q_c4_window_join", sql(f"""WITH {_WIN}
SELECT w.dwell, w.disp, fm.event_id, w.k FROM fm JOIN w ON fm.participant=w.participant AND fm.t_us>=w.w_start AND fm.t_us<w.w_end""", "fr", "rs"))
def window_join(spark, sf):
    return _inside(spark, sf, _windows(spark, sf)).select("dwell", "disp", "event_id", "k")


@query("q_g6_answers", sql(f"""WITH {_WIN},
fps AS (SELECT participant, CASE WHEN max(t_us)>min(t_us) THEN (count(*)-1)/(CAST(max(t_us)-min(t_us) AS DOUBLE)/{DAY}) ELSE 30e0 END AS fps FROM fm GROUP BY 1),
ins AS (SELECT w.dwell, w.disp, w.participant, w.k, fm.t_us, px, py, abs(fm.t_us-(w_start+w_end)/2) AS off FROM fm JOIN w ON fm.participant=w.participant AND fm.t_us>=w.w_start AND fm.t_us<w.w_end),
per AS (SELECT dwell, disp, participant, k, count(*) AS frames, arg_min(px,(off,t_us)) AS sx, arg_min(py,(off,t_us)) AS sy, avg(px) AS mx, avg(py) AS my, quantile_cont(px,0.5) AS dx, quantile_cont(py,0.5) AS dy FROM ins GROUP BY 1,2,3,4),
v AS (SELECT dwell, disp, participant, k, grid, CAST(least(greatest(floor(py*rows_),0),rows_-1)*cols_+least(greatest(floor(px*cols_),0),cols_-1) AS INT) AS z, count(*) AS c FROM ins, grids GROUP BY 1,2,3,4,5,6),
v2 AS (SELECT *, rank() OVER (PARTITION BY dwell,disp,participant,k,grid ORDER BY c DESC) AS rk, row_number() OVER (PARTITION BY dwell,disp,participant,k,grid ORDER BY c DESC, z) AS rn FROM v),
top AS (SELECT dwell,disp,participant,k,grid, max(CASE WHEN rn=1 THEN z END) AS z, sum(CASE WHEN rk=1 THEN 1 ELSE 0 END)=1 AS alone FROM v2 GROUP BY 1,2,3,4,5),
j AS (SELECT w.dwell,w.disp,w.participant,w.k,g.grid,g.rows_,g.cols_,gx,gy,per.*EXCLUDE(dwell,disp,participant,k), coalesce(frames >= 5e-1*greatest(fps*w.dwell/{DAY},1e0), false) AS answered,
   top.z, top.alone FROM w CROSS JOIN grids g LEFT JOIN per ON per.dwell=w.dwell AND per.disp=w.disp AND per.participant=w.participant AND per.k=w.k
   LEFT JOIN top ON top.dwell=w.dwell AND top.disp=w.disp AND top.participant=w.participant AND top.k=w.k AND top.grid=g.grid LEFT JOIN fps ON fps.participant=w.participant),
zz AS (SELECT *, least(greatest(floor(gy*rows_),0),rows_-1)*cols_+least(greatest(floor(gx*cols_),0),cols_-1) AS zt,
  least(greatest(floor(sy*rows_),0),rows_-1)*cols_+least(greatest(floor(sx*cols_),0),cols_-1) AS z1,
  least(greatest(floor(my*rows_),0),rows_-1)*cols_+least(greatest(floor(mx*cols_),0),cols_-1) AS z2,
  least(greatest(floor(dy*rows_),0),rows_-1)*cols_+least(greatest(floor(dx*cols_),0),cols_-1) AS z3 FROM j),
m AS (SELECT dwell,disp,participant,grid,answered,'single' AS method, answered AND z1=zt AS ok FROM zz UNION ALL SELECT dwell,disp,participant,grid,answered,'mean', answered AND z2=zt FROM zz
 UNION ALL SELECT dwell,disp,participant,grid,answered,'median', answered AND z3=zt FROM zz UNION ALL SELECT dwell,disp,participant,grid,answered,'vote', answered AND (CASE WHEN alone THEN z ELSE z2 END)=zt FROM zz),
pp AS (SELECT dwell,disp,grid,method,participant, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS acc, count(*) AS n, sum(CASE WHEN answered THEN 1 ELSE 0 END) AS a FROM m GROUP BY 1,2,3,4,5),
units AS (SELECT dwell, disp, grid, method, participant AS unit, acc AS v FROM pp),
{bootstrap_sql('units', 'dwell, disp, grid, method', REPS)},
su AS (SELECT dwell, disp, grid, method, round(avg(acc),6) AS acc, round(min(acc),6) AS worst, round(max(acc),6) AS best, CAST(sum(n) AS BIGINT) AS windows, round(sum(a)/sum(n),6) AS answered_frac FROM pp GROUP BY 1,2,3,4)
SELECT su.*, round(ci_lo,6) AS acc_lo, round(ci_hi,6) AS acc_hi FROM su LEFT JOIN b_ci ON b_ci.dwell=su.dwell AND b_ci.disp=su.disp AND b_ci.grid=su.grid AND b_ci.method=su.method
""", "fr", "rs", "grids"))
def answers(spark, sf):
    fps = A.frame_rate(_frames(spark, sf), ["participant"], "t_us", DAY).select("participant", "fps")
    w = A.with_setup(_windows(spark, sf), fps, "participant", "k")
    a = W.window_answers(_inside(spark, sf, w), w, ["participant"], "t_us", F.col("fps") * F.col("dwell") / DAY)
    per = a.groupBy("dwell", "disp", "grid", "method", "participant").agg(
        F.avg(F.col("ok").cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"), F.sum(F.col("answered").cast("bigint")).alias("a")
    )
    per = cut_lineage(per)
    ci = metric_intervals(per, ["dwell", "disp", "grid", "method"], "participant", ["acc"], REPS)
    out = per.groupBy("dwell", "disp", "grid", "method").agg(
        F.avg("acc").alias("acc"), F.min("acc").alias("worst"), F.max("acc").alias("best"), F.sum("n").alias("windows"), (F.sum("a") / F.sum("n")).alias("answered_frac")
    )
    return rounded(out.join(ci, ["dwell", "disp", "grid", "method"], "left"), "acc", "worst", "best", "answered_frac", "acc_lo", "acc_hi")


def _numbered(spark, sf):
    """Frames numbered from 1 per participant, with stamps that repeat, go missing and step back."""
    f = frame_stream(spark, sf).withColumn("slot", F.floor(F.col("t_us") / DAY))
    f = running(f, ["participant"], "slot", ["t_us", "event_id"], count="seq")
    ms = (F.col("t_us") - EPOCH_MS * 1000) / F.lit(1000.0)
    return f.select(
        "participant", "event_id", F.col("seq").cast("bigint").alias("seq"),
        F.when(F.col("k") % 10 == 0, None).when(F.col("k") % 10 == 1, ms - 3 * DAY / 1000).otherwise(ms).alias("stamp"),
        (F.floor(F.col("t_us") / HOUR) - F.when(F.col("k") % 10 == 1, 72).otherwise(0)).alias("clock"),
    )


_NUM = f"""nf AS (SELECT participant, event_id, row_number() OVER (PARTITION BY participant ORDER BY t_us, event_id) AS seq,
  CASE WHEN k%10=0 THEN NULL WHEN k%10=1 THEN (t_us-{EPOCH_MS}000)/1e3-{3*DAY//1000} ELSE (t_us-{EPOCH_MS}000)/1e3 END AS stamp,
  t_us//{HOUR} - CASE WHEN k%10=1 THEN 72 ELSE 0 END AS clock FROM fr)"""


@query("q_g7_repair", sql(f"""WITH {_NUM},
a AS (SELECT *, max(stamp) OVER (PARTITION BY participant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM nf),
g AS (SELECT *, stamp IS NOT NULL AND (top IS NULL OR stamp>top) AS good FROM a),
h AS (SELECT *, CASE WHEN good THEN seq END AS gi, CASE WHEN good THEN stamp END AS gp FROM g),
n AS (SELECT *, last_value(gi IGNORE NULLS) OVER b AS ai, last_value(gp IGNORE NULLS) OVER b AS ap, first_value(gi IGNORE NULLS) OVER f AS bi, first_value(gp IGNORE NULLS) OVER f AS bp
  FROM h WINDOW b AS (PARTITION BY participant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY participant ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT participant, count(gi) AS ng, quantile_cont(CASE WHEN good THEN gp-ap END,0.5)/greatest(quantile_cont(CASE WHEN good THEN gi-ai END,0.5),1) AS per FROM n GROUP BY 1)
SELECT event_id, round(CASE WHEN ng<5 THEN seq*33.3e0 WHEN good THEN stamp WHEN ai IS NULL THEN bp-per*(bi-seq) WHEN bi IS NULL THEN ap+per*(seq-ai)
  ELSE ap+(bp-ap)*(seq-ai)/(bi-ai) END,5) AS t_repaired FROM n JOIN c USING (participant)""", "fr"))
def repair(spark, sf):
    r = A.repair_times(_numbered(spark, sf), ["participant"], "seq", "stamp")
    return r.select("event_id", F.round("t_repaired", 5).alias("t_repaired"))


@query("q_g11_monotone", sql(f"""WITH {_NUM}
SELECT event_id, max(clock-seq) OVER (PARTITION BY participant ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)+seq AS clock_mono FROM nf""", "fr"))
def monotone(spark, sf):
    return A.monotone_clock(_numbered(spark, sf), ["participant"], "seq", "clock", out="clock_mono").select("event_id", "clock_mono")


@query("q_g8_smooth", sql(f"""SELECT event_id, round(quantile_cont(value,0.5) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {2*DAY} PRECEDING AND CURRENT ROW),6) AS smooth FROM b""", "b"))
def smooth(spark, sf):
    d = W.time_median(base(spark, sf).select("user_id", "event_id", "t_us", "value"), ["user_id"], "t_us", "value", 2 * DAY, 5 * DAY)
    return d.select("event_id", r6(F.col("smooth"), "smooth"))


SLOW_LIMIT = 40.0


@query("q_g9_slow", sql(f"""
WITH s AS (SELECT user_id AS participant, value, seq, quantile_cont(value,0.5) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS med FROM evt),
j AS (SELECT *, CASE WHEN seq>=40 THEN med>{SLOW_LIMIT} END AS slow FROM s)
SELECT participant, count(*) AS frames, count(slow) AS judged, round(avg(CASE WHEN slow THEN 1e0 WHEN NOT slow THEN 0e0 END),6) AS slow_share,
 round(quantile_cont(value,0.5),6) AS median_ms, round(quantile_cont(value,0.95),6) AS p95_ms FROM j GROUP BY 1""", "evt"))
def slow(spark, sf):
    b = base(spark, sf).withColumn("slot", F.floor(F.col("t_us") / DAY))
    d = running(b, ["user_id"], "slot", ["t_us", "event_id"], count="seq").withColumnRenamed("user_id", "participant")
    s = W.slow_frames(d.select("participant", "seq", "value"), ["participant"], "seq", "value", SLOW_LIMIT)
    return rounded(W.rate_report(s, ["participant"], "value"), "slow_share", "median_ms", "p95_ms")


@query("q_g10_gap", sql(f"""
WITH g AS (SELECT participant, t_us, t_us-lag(t_us) OVER (PARTITION BY participant ORDER BY t_us, event_id) AS gap FROM fr)
SELECT participant, coalesce(max(gap),0) AS longest_gap FROM g GROUP BY 1""", "fr"))
def longest_gap(spark, sf):
    return A.gaps(frame_stream(spark, sf), ["participant"], "t_us", DAY, "event_id")


@query("q_d34_rate", sql(f"""
WITH f AS (SELECT participant, t_us//864000000000 AS video, count(*) AS frames, CASE WHEN max(t_us)>min(t_us) THEN (count(*)-1)/(CAST(max(t_us)-min(t_us) AS DOUBLE)/{DAY}) ELSE 30e0 END AS fps FROM fr GROUP BY 1,2)
SELECT participant, video, frames, round(fps,6) AS fps, round(fps*5e2/1e3,6) AS readings, fps<15e0 AS below_floor FROM f""", "fr"))
def rate(spark, sf):
    f = A.frame_rate(_frames(spark, sf), ["participant", "video"], "t_us", DAY)
    return f.select("participant", "video", "frames", r6(F.col("fps"), "fps"), r6(readings_per_dwell(F.col("fps"), F.lit(500.0)), "readings"), (F.col("fps") < W.MIN_FPS).alias("below_floor"))


@query("q_g5_fixation_rows", sql(f"""WITH {_STREAMS},
v AS (SELECT participant, t_us AS t, tx AS x, ty AS y, row_number() OVER (PARTITION BY participant ORDER BY t_us, tx, ty) AS k FROM rf WHERE tvalid=1 AND tx IS NOT NULL AND ty IS NOT NULL),
c AS (SELECT *, CASE WHEN t-lag(t) OVER (PARTITION BY participant ORDER BY k) <= {3*DAY} THEN 0 ELSE 1 END AS cut FROM v),
r AS (SELECT *, sum(cut) OVER (PARTITION BY participant ORDER BY k) AS run FROM c),
w AS (SELECT a.participant, a.run, a.k, a.t, b.k AS bk, b.t AS bt, (max(b.x) OVER f - min(b.x) OVER f) + (max(b.y) OVER f - min(b.y) OVER f) AS spread
  FROM r a JOIN r b ON a.participant=b.participant AND a.run=b.run AND b.k>=a.k WINDOW f AS (PARTITION BY a.participant, a.k ORDER BY b.k)),
e AS (SELECT participant, run, k, any_value(t) AS t, max(bk) AS ek, max(bt) AS et FROM w WHERE spread<=8e-1 GROUP BY 1,2,3),
l AS (SELECT * FROM e WHERE et-t>={12*HOUR}),
g AS (SELECT participant, run, min(k) AS k FROM l GROUP BY 1,2
  UNION ALL SELECT g.participant, g.run, (SELECT min(n.k) FROM l n WHERE n.participant=g.participant AND n.run=g.run AND n.k>h.ek) FROM g JOIN l h USING (participant, run, k) WHERE g.k IS NOT NULL)
SELECT participant, CAST(t AS DOUBLE) AS start, CAST(et AS DOUBLE) AS "end" FROM g JOIN l USING (participant, run, k)""", "fr", "rs").replace("WITH ", "WITH RECURSIVE ", 1))
def fixation_rows(spark, sf):
    return W.fixations(_refs(spark, sf), ["participant"], "t_us", "tx", "ty", "tvalid", 12 * HOUR, 0.8, 10 * DAY, gap=3 * DAY)
