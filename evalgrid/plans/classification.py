"""Zone classification queries over prediction / truth pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.functions.scores import bits_per_selection, distance
from evalgrid.functions.zones import NO_ZONE, from_pixels, strip_zone, threshold_zone, zone_of
from evalgrid.operators import classify as C
from evalgrid.operators.resample import bootstrap_ci
from evalgrid.operators.skew import quantiles
from evalgrid.plans.registry import query
from evalgrid.plans.roles import DAY, bootstrap_sql, predictions, sql


def r6(c, name):
    return F.round(c, 6).alias(name)


def rounded(df, *names):
    """Round the named double columns to 6 places, keep the rest."""
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("q_d1_zone_accuracy", sql(f"""
WITH units AS (SELECT grid, subject AS unit, avg(CASE WHEN zt=zp THEN 1e0 ELSE 0e0 END) AS v, count(*) AS m,
       sum(CASE WHEN zt=zp THEN 1 ELSE 0 END) AS c FROM pz GROUP BY grid, subject),
{bootstrap_sql('units', 'grid', 5000)},
s AS (SELECT grid, avg(v) AS acc_mean, min(v) AS acc_min, max(v) AS acc_max, CAST(sum(c) AS DOUBLE)/sum(m) AS acc_pooled FROM units GROUP BY grid)
SELECT s.grid, round(acc_mean,6) AS acc_mean, round(acc_min,6) AS acc_min, round(acc_max,6) AS acc_max,
       round(acc_pooled,6) AS acc_pooled, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM s LEFT JOIN b_ci USING (grid)
""", "pz"))
def zone_accuracy(spark, sf):
    per = C.group_accuracy(C.zone_answers(predictions(spark, sf)), ["grid"], "subject")
    ci = bootstrap_ci(per, ["grid"], "subject", "acc").select("grid", "ci_lo", "ci_hi")
    m = C.macro_accuracy(per, ["grid"]).join(ci, "grid", "left")
    cols = ["acc_mean", "acc_min", "acc_max", "acc_pooled", "ci_lo", "ci_hi"]
    return rounded(m.select("grid", *cols), *cols)


@query("q_d2_macro_pooled", sql("""
WITH g AS (SELECT grid, subject, count(*) n, sum(CASE WHEN zt=zp THEN 1 ELSE 0 END) c, sum(CASE WHEN zp>=0 THEN 1 ELSE 0 END) a FROM pz GROUP BY 1,2)
SELECT grid, count(*) AS groups, round(avg(c/n),6) AS acc_mean, round(min(c/n),6) AS acc_min, round(max(c/n),6) AS acc_max,
  round(sum(c)/sum(n),6) AS acc_pooled, round(sum(c)/sum(a),6) AS acc_answered FROM g GROUP BY grid
""", "pz"))
def macro_pooled(spark, sf):
    per = C.group_accuracy(C.zone_answers(predictions(spark, sf)), ["grid"], "subject")
    return rounded(C.macro_accuracy(per, ["grid"]), "acc_mean", "acc_min", "acc_max", "acc_pooled", "acc_answered")


@query("q_d3_balanced", sql("""
WITH r AS (SELECT grid, zt, avg(CASE WHEN zt=zp THEN 1e0 ELSE 0e0 END) AS recall FROM pz GROUP BY 1,2)
SELECT grid, round(avg(recall),6) AS balanced_acc, count(*) AS classes FROM r GROUP BY grid""", "pz"))
def balanced(spark, sf):
    return rounded(C.balanced_accuracy(C.zone_answers(predictions(spark, sf)), ["grid"]), "balanced_acc")


@query("q_d4_confusion", sql("""
WITH c AS (SELECT grid, zt, zp, count(*) AS n FROM pz GROUP BY 1,2,3)
SELECT grid, zt, zp, n, round(n/sum(n) OVER (PARTITION BY grid, zt),6) AS share FROM c""", "pz"))
def confusion(spark, sf):
    return rounded(C.confusion(C.zone_answers(predictions(spark, sf)), ["grid"]), "share")


@query("q_d5_loo_majority", sql("""
WITH own AS (SELECT grid, subject, zt, count(*) n FROM pz GROUP BY 1,2,3),
tot AS (SELECT grid, zt, sum(n) t FROM own GROUP BY 1,2),
s AS (SELECT grid, subject, sum(n) sn FROM own GROUP BY 1,2),
f AS (SELECT s.grid, s.subject, sn, tot.zt, t-coalesce(n,0) AS o, coalesce(n,0) AS n,
   row_number() OVER (PARTITION BY s.grid, s.subject ORDER BY t-coalesce(n,0) DESC, tot.zt) AS rn
   FROM s JOIN tot ON s.grid=tot.grid LEFT JOIN own ON own.grid=s.grid AND own.subject=s.subject AND own.zt=tot.zt)
SELECT grid, subject, zt AS majority_zone, round(n/sn,6) AS acc FROM f WHERE rn=1""", "pz"))
def loo_majority(spark, sf):
    return rounded(C.leave_one_out_majority(C.zone_answers(predictions(spark, sf)), ["grid"], "subject"), "acc")


@query("q_d7_distribution", sql("""
WITH c AS (SELECT grid, zp AS zone, count(*) AS n FROM pz GROUP BY 1,2)
SELECT grid, zone, n, round(n/sum(n) OVER (PARTITION BY grid),6) AS share FROM c""", "pz"))
def distribution(spark, sf):
    a = C.zone_answers(predictions(spark, sf)).withColumnRenamed("zp", "zone")
    return rounded(C.distribution(a, ["grid"], "zone"), "share")


_ERR_MM = "sqrt(pow((px-gx)*screen_w_mm,2)+pow((py-gy)*screen_h_mm,2))"


def _mm_error():
    return distance((F.col("px") - F.col("gx")) * F.col("screen_w_mm"), (F.col("py") - F.col("gy")) * F.col("screen_h_mm"))


@query("q_d8_quantiles", sql("""
SELECT subject, round(quantile_cont(px,0.01),6) AS q01, round(quantile_cont(px,0.5),6) AS q50, round(quantile_cont(px,0.99),6) AS q99
FROM pr WHERE px IS NOT NULL GROUP BY subject""", "pr"))
def quantile_table(spark, sf):
    q = quantiles(predictions(spark, sf), ["subject"], "px", {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return rounded(q, "q01", "q50", "q99")


@query("q_a14_qa_profile", sql("""
WITH s AS (SELECT subject, count(*) n, avg(CASE WHEN px IS NULL THEN 0e0 ELSE 1e0 END) det FROM pr GROUP BY 1)
SELECT (SELECT count(*) FROM pr) AS frames, (SELECT count(*) FROM s) AS subjects,
 (SELECT round(avg(CASE WHEN px IS NULL THEN 0e0 ELSE 1e0 END),6) FROM pr) AS detected_rate,
 (SELECT round(min(det),6) FROM s) AS min_subject_rate,
 (SELECT round(avg(CASE WHEN px<0 OR px>0.9e0 OR py<0 OR py>0.9e0 THEN 1e0 ELSE 0e0 END),6) FROM pr WHERE px IS NOT NULL) AS out_of_range,
 (SELECT round(quantile_cont(screen_w_mm,0.5),6) FROM pr) AS screen_w_median,
 (SELECT min(n) FROM s) AS min_frames, (SELECT max(n) FROM s) AS max_frames,
 (SELECT count(*) FROM s WHERE n < 0.9e0*(SELECT max(n) FROM s)) AS low_coverage_subjects""", "pr"))
def qa_profile(spark, sf):
    from evalgrid.sources.features import coverage

    p = predictions(spark, sf).withColumn("g", F.lit("all"))
    seen = F.col("px").isNotNull()
    out = (F.col("px") < 0) | (F.col("px") > 0.9) | (F.col("py") < 0) | (F.col("py") > 0.9)
    per = p.groupBy("g", "subject").agg(
        F.count(F.lit(1)).alias("n"), F.sum(seen.cast("bigint")).alias("det"), F.sum((seen & out).cast("bigint")).alias("out")
    )
    one = per.groupBy("g").agg(
        F.sum("n").alias("frames"), F.count(F.lit(1)).alias("subjects"), r6(F.sum("det") / F.sum("n"), "detected_rate"),
        r6(F.min(F.col("det") / F.col("n")), "min_subject_rate"), r6(F.sum("out") / F.sum("det"), "out_of_range"),
        F.min("n").alias("min_frames"), F.max("n").alias("max_frames"),
    )
    low = coverage(per.withColumnRenamed("n", "frames"), ["g"], "frames").groupBy("g").agg(F.sum(F.col("low_coverage").cast("bigint")).alias("low_coverage_subjects"))
    med = quantiles(p, ["g"], "screen_w_mm", {"screen_w_median": 0.5})
    return rounded(one.join(low, "g").join(med, "g").drop("g"), "screen_w_median")


@query("q_b2_zone_functions", sql("""
SELECT event_id, CASE WHEN px IS NULL THEN -1 ELSE CAST(least(greatest(floor(px/0.333e0),0),2) + 3*least(greatest(floor(py/0.333e0),0),2) AS INT) END AS threshold_zone,
 CASE WHEN px IS NULL THEN -1 ELSE CAST(least(greatest(floor(px*3),0),2) AS INT) END AS strip_zone,
 CASE WHEN px IS NULL THEN -1 ELSE CAST(least(greatest(floor(px*3),0),2)+3*least(greatest(floor(py*3),0),2) AS INT) END AS grid_zone,
 round(px*screen_w_mm/screen_w_mm,6) AS x_fraction FROM pr""", "pr"))
def zone_functions(spark, sf):
    p = predictions(spark, sf)
    return p.select(
        "event_id", threshold_zone("px", "py").alias("threshold_zone"), strip_zone("px", 3).alias("strip_zone"),
        zone_of("px", "py", 3, 3).alias("grid_zone"), r6(from_pixels(F.col("px") * F.col("screen_w_mm"), "screen_w_mm"), "x_fraction"),
    )


@query("q_b5_mm_error", sql(f"""
WITH e AS (SELECT subject, {_ERR_MM} AS e FROM pr WHERE px IS NOT NULL),
g AS (SELECT subject, avg(e) AS mean_mm, quantile_cont(e,0.5) AS median_mm, quantile_cont(e,0.9) AS p90_mm FROM e GROUP BY 1)
SELECT subject, round(mean_mm,6) AS mean_mm, round(median_mm,6) AS median_mm, round(p90_mm,6) AS p90_mm FROM g""", "pr"))
def mm_error(spark, sf):
    e = predictions(spark, sf).select("subject", _mm_error().alias("e"))
    q = quantiles(e, ["subject"], "e", {"median_mm": 0.5, "p90_mm": 0.9})
    m = e.groupBy("subject").agg(F.avg("e").alias("mean_mm"))
    return rounded(m.join(q, "subject"), "mean_mm", "median_mm", "p90_mm")


@query("q_b6_bits", sql("""
WITH a AS (SELECT grid, n_zones, subject, avg(CASE WHEN zt=zp THEN 1e0 ELSE 0e0 END) AS p FROM pz GROUP BY 1,2,3),
c AS (SELECT *, least(greatest(p,1e-9),1-1e-9) AS q FROM a),
t AS (SELECT grid, n_zones, p, CASE WHEN q<=1e0/n_zones THEN 0e0 ELSE log2(n_zones)+q*log2(q)+(1-q)*log2((1-q)/(n_zones-1)) END AS bits FROM c)
SELECT grid, n_zones, round(avg(p),6) AS acc_mean, round(avg(bits),6) AS bits_mean, round(min(bits),6) AS bits_min, round(max(bits),6) AS bits_max FROM t GROUP BY 1,2
""", "pz"))
def bits(spark, sf):
    a = C.zone_answers(predictions(spark, sf)).withColumn("n_zones", F.col("rows") * F.col("cols"))
    per = C.group_accuracy(a, ["grid", "n_zones"], "subject").withColumn("bits", bits_per_selection(F.col("acc"), F.col("n_zones")))
    out = per.groupBy("grid", "n_zones").agg(
        F.avg("acc").alias("acc_mean"), F.avg("bits").alias("bits_mean"), F.min("bits").alias("bits_min"), F.max("bits").alias("bits_max")
    )
    return rounded(out, "acc_mean", "bits_mean", "bits_min", "bits_max")


_AXES_SQL = """
e AS (SELECT subject, t_us//86400000000 AS day, 'x' AS axis, (px-gx)*screen_w_mm AS e FROM pr WHERE px IS NOT NULL
      UNION ALL SELECT subject, t_us//86400000000, 'y', (py-gy)*screen_h_mm FROM pr WHERE py IS NOT NULL)"""


def _errors(spark, sf):
    p = predictions(spark, sf).withColumn("day", F.floor(F.col("t_us") / DAY))
    return C.axis_errors(p, ["subject", "day"], {
        "x": (F.col("px") - F.col("gx")) * F.col("screen_w_mm"), "y": (F.col("py") - F.col("gy")) * F.col("screen_h_mm")})


@query("q_d9_bias_scatter", sql(f"""
WITH {_AXES_SQL},
g AS (SELECT axis, subject, avg(e) bias, stddev_samp(e) sd FROM e GROUP BY 1,2),
t AS (SELECT axis, avg(e*e) mse FROM e GROUP BY 1),
h AS (SELECT axis, avg(bias*bias) b2, avg(sd*sd) s2 FROM g GROUP BY 1)
SELECT axis, round(sqrt(mse),6) AS rms_total, round(sqrt(b2),6) AS rms_bias, round(sqrt(s2),6) AS rms_scatter, round(b2/mse,6) AS removable_share
FROM t JOIN h USING (axis)""", "pr"))
def bias_scatter(spark, sf):
    return rounded(C.bias_and_scatter(_errors(spark, sf), "subject"), "rms_total", "rms_bias", "rms_scatter", "removable_share")


@query("q_d10_icc", sql(f"""
WITH {_AXES_SQL},
g AS (SELECT axis, subject, day, CAST(count(*) AS DOUBLE) n, avg(e) m, var_pop(e)*count(*) w FROM e GROUP BY 1,2,3),
a AS (SELECT axis, avg(e) gm, avg(e*e) ms FROM e GROUP BY 1),
t AS (SELECT g.axis, count(*) k, sum(n) nn, sum(n*n) n2, sum(n*(m-gm)*(m-gm)) ssb, sum(w) ssw, avg(m*m) mm, avg(n) mn, any_value(ms) ms FROM g JOIN a ON g.axis=a.axis GROUP BY g.axis),
u AS (SELECT *, ssb/(k-1) msb, ssw/(nn-k) msw, (nn-n2/nn)/(k-1) n0 FROM t)
SELECT axis, k AS groups, CAST(nn AS BIGINT) AS rows, round((msb-msw)/(msb+(n0-1)*msw),6) AS icc, round(ssb/(ssb+ssw),6) AS naive_share,
 round(mn,6) AS rows_per_group, round(sqrt(ms),6) AS rmse_row, round(sqrt(mm),6) AS rmse_group_mean FROM u""", "pr"))
def icc(spark, sf):
    return rounded(C.shared_error(_errors(spark, sf), ["subject", "day"]), "icc", "naive_share", "rows_per_group", "rmse_row", "rmse_group_mean")


KSHOT_GRIDS = [("1x3", 1, 3), ("2x2", 2, 2), ("3x3", 3, 3), ("4x4", 4, 4)]


@query("q_d16_kshot", sql("""
WITH d0 AS (SELECT *, t_us//86400000000 AS day, min(t_us//86400000000) OVER (PARTITION BY subject) AS first FROM pr),
pool AS (SELECT 'random' AS scheme, * FROM d0 WHERE px IS NOT NULL UNION ALL SELECT 'first session', * FROM d0 WHERE px IS NOT NULL AND day=first),
h0 AS (SELECT *, (draw*668265263 + event_id*1640531527) & 4294967295 AS x FROM pool, range(20) r(draw)),
h1 AS (SELECT * EXCLUDE x, (xor(x>>16,x)*73244475)&4294967295 AS x FROM h0),
h2 AS (SELECT * EXCLUDE x, (xor(x>>16,x)*73244475)&4294967295 AS x FROM h1),
h3 AS (SELECT *, row_number() OVER (PARTITION BY subject, scheme, draw ORDER BY xor(x>>16,x), event_id) AS rn FROM h2),
cal AS (SELECT subject, scheme, draw, k, event_id, px, py, gx, gy FROM h3, (VALUES (1),(3),(5),(9),(16)) kk(k) WHERE rn<=k),
m AS (SELECT subject, scheme, draw, k, count(*) n, avg(px) mpx, avg(gx) mgx, covar_pop(px,gx) cx, var_pop(px) vx, avg(py) mpy, avg(gy) mgy, covar_pop(py,gy) cy, var_pop(py) vy FROM cal GROUP BY 1,2,3,4),
f0 AS (SELECT *, CASE WHEN k>=5 AND vx*k>1e-9 THEN greatest(0.5e0,least(3e0,cx/vx)) ELSE 1e0 END ax, CASE WHEN k>=5 AND vy*k>1e-9 THEN greatest(0.5e0,least(3e0,cy/vy)) ELSE 1e0 END ay FROM m WHERE n=k),
f AS (SELECT *, mgx-ax*mpx bx, mgy-ay*mpy AS by_ FROM f0),
s AS (SELECT f.subject, f.scheme, f.draw, f.k, ax*px+bx qx, ay*py+by_ qy, gx, gy FROM d0 JOIN f ON f.subject=d0.subject
  WHERE (f.scheme='random' AND NOT EXISTS (SELECT 1 FROM cal c WHERE c.subject=f.subject AND c.scheme=f.scheme AND c.draw=f.draw AND c.k=f.k AND c.event_id=d0.event_id))
     OR (f.scheme='first session' AND day<>first)),
z AS (SELECT subject, scheme, draw, k, grid, CASE WHEN qx IS NULL THEN -1 ELSE least(greatest(floor(qy*rows_),0),rows_-1)*cols_+least(greatest(floor(qx*cols_),0),cols_-1) END zp,
  least(greatest(floor(gy*rows_),0),rows_-1)*cols_+least(greatest(floor(gx*cols_),0),cols_-1) zt FROM s, grids WHERE grid IN ('1x3','2x2','3x3','4x4')),
a AS (SELECT scheme, grid, k, subject, draw, avg(CASE WHEN zp=zt THEN 1e0 ELSE 0e0 END) acc FROM z GROUP BY 1,2,3,4,5),
p AS (SELECT scheme, grid, k, subject, avg(acc) acc FROM a GROUP BY 1,2,3,4)
SELECT scheme, grid, k, round(avg(acc),6) AS acc_mean, round(min(acc),6) AS acc_min, round(max(acc),6) AS acc_max, count(*) AS subjects FROM p GROUP BY 1,2,3
""", "pr", "grids"))
def kshot(spark, sf):
    p = predictions(spark, sf).withColumn("day", F.floor(F.col("t_us") / DAY))
    return rounded(C.calibration_curve(p, "subject", "event_id", "day", KSHOT_GRIDS), "acc_mean", "acc_min", "acc_max")


@query("q_d36_corner", sql("""
WITH pts AS (SELECT px, py, gx, gy, screen_w_mm/1e3 AS w FROM pr WHERE px IS NOT NULL),
d AS (SELECT w, [ (SELECT min(sqrt(pow(gx+5e-2*i-(px+5e-2*j),2)+pow(gy+3e-2*i-(py+4e-2*j),2))) FROM range(4) t(j)) FOR i IN range(4)] AS ds FROM pts),
r AS (SELECT list_sum(ds)/4/w AS rel FROM d)
SELECT round(quantile_cont(rel,0.5),6) AS rel_median, round(avg(CASE WHEN rel>0.2e0 THEN 1e0 ELSE 0e0 END),6) AS share_above FROM r""", "pr")
    .replace("[ (SELECT min(sqrt(pow(gx+5e-2*i-(px+5e-2*j),2)+pow(gy+3e-2*i-(py+4e-2*j),2))) FROM range(4) t(j)) FOR i IN range(4)]",
             "[" + ",".join("least(" + ",".join(f"sqrt(pow(gx+{5*i}e-2-(px+{5*j}e-2),2)+pow(gy+{3*i}e-2-(py+{4*j}e-2),2))" for j in range(4)) + ")" for i in range(4)) + "]"))
def corner(spark, sf):
    p = predictions(spark, sf).where(F.col("px").isNotNull())
    marked = [(F.col("gx") + F.lit(5 * i / 100), F.col("gy") + F.lit(3 * i / 100)) for i in range(4)]
    found = [(F.col("px") + F.lit(5 * j / 100), F.col("py") + F.lit(4 * j / 100)) for j in range(4)]
    e = p.select(F.lit("all").alias("g"), C.nearest_point_error(marked, found, F.col("screen_w_mm") / 1000).alias("rel"))
    share = e.groupBy("g").agg(r6(F.avg((F.col("rel") > 0.2).cast("double")), "share_above"))
    return rounded(quantiles(e, ["g"], "rel", {"rel_median": 0.5}).join(share, "g").drop("g"), "rel_median")
