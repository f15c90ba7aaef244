"""Regression, calibration and cross-validation queries over lineitem and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.functions.scores import correlation
from evalgrid.operators import boosting as B
from evalgrid.operators import classify as C
from evalgrid.operators import models as M
from evalgrid.operators.resample import BCA_REPS, bca_ci
from evalgrid.plans.classification import r6, rounded
from evalgrid.plans.registry import query
from evalgrid.plans.roles import bca_sql, predictions, sql, table

PRICE_CAP = 100000.0
GBT_FOLDS = 10


def regression(spark, sf):
    """RG: y = price, x = quantity, discount; the group is the supplier. Rows get a content hash id."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") / PRICE_CAP).alias("price"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % 2).alias("held_out"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("row_id"),
    )


_RG = """rg AS (SELECT l_suppkey AS grp, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_extendedprice/100000e0 AS price, l_returnflag AS flag FROM lineitem)"""


@query("q_d15_fit_both_ways", f"""WITH {_RG},
g AS (SELECT grp, count(*) AS n, covar_pop(price,qty) AS c, var_pop(price) AS vp, var_pop(qty) AS vt, avg(price) AS mp, avg(qty) AS mt FROM rg GROUP BY 1),
f AS (SELECT *, c/vp AS aw, CASE WHEN abs(c/vt)>1e-3 THEN vt/c END AS a FROM g)
SELECT grp, n, round(aw,6) AS a_wrong, round(mt-aw*mp,6) AS b_wrong, round(a,4) AS a, round(mt-a*mp,4) AS b FROM f""")
def fit_both_ways(spark, sf):
    f = M.line_fits(regression(spark, sf), ["grp"], "price", "qty").drop("raw_lo", "raw_hi")
    return rounded(f, "a_wrong", "b_wrong").withColumn("a", F.round("a", 4)).withColumn("b", F.round("b", 4))


@query("q_d17_snr", f"""WITH {_RG},
p AS (SELECT flag, qty, avg(price) AS m, stddev_samp(price) AS s FROM rg GROUP BY 1,2),
g AS (SELECT flag, max(m)-min(m) AS signal, avg(s) AS noise, (max(m)-min(m))/avg(s) AS snr FROM p GROUP BY 1), c AS (SELECT flag, corr(price,qty) AS r FROM rg GROUP BY 1)
SELECT flag, round(signal,6) AS signal, round(noise,6) AS noise, round(snr,6) AS snr, round(r,6) AS r, CASE WHEN snr<1.5e0 THEN 'nothing to recover' WHEN snr<3e0 THEN 'marginal' ELSE 'workable' END AS snr_verdict,
 CASE WHEN abs(r)<0.3e0 THEN 'useless' WHEN abs(r)<0.6e0 THEN 'weak' ELSE 'usable' END AS r_verdict FROM g JOIN c USING (flag)""")
def snr(spark, sf):
    return rounded(M.signal_to_noise(regression(spark, sf), ["flag"], "qty", "price"), "signal", "noise", "snr", "r")


@query("q_d33_corr_tertiles", f"""WITH {_RG},
p AS (SELECT grp, round(avg(qty),4) AS w, round(avg(price),6) AS acc FROM rg GROUP BY 1),
k AS (SELECT *, (rank() OVER (ORDER BY w) + rank() OVER (ORDER BY w DESC)) AS d1, (rank() OVER (ORDER BY acc) + rank() OVER (ORDER BY acc DESC)) AS d2, rank() OVER (ORDER BY w)-rank() OVER (ORDER BY w DESC) AS rw, rank() OVER (ORDER BY acc)-rank() OVER (ORDER BY acc DESC) AS ra FROM p),
c AS (SELECT corr(w,acc) AS pearson, (SELECT corr(rw,ra) FROM k) AS spearman, quantile_cont(w,1/3) AS q1, quantile_cont(w,2/3) AS q2 FROM p),
t AS (SELECT CASE WHEN w<=q1 THEN 'smallest' WHEN w<=q2 THEN 'middle' ELSE 'largest' END AS third, w, acc, pearson, spearman FROM p, c)
SELECT third, count(*) AS n, round(avg(w),6) AS width, round(avg(acc),6) AS acc, round(any_value(pearson),6) AS pearson, round(any_value(spearman),6) AS spearman FROM t GROUP BY 1""")
def corr_tertiles(spark, sf):
    p = regression(spark, sf).groupBy("grp").agg(F.round(F.avg("qty"), 4).alias("w"), F.round(F.avg("price"), 6).alias("acc")).withColumn("g", F.lit("all"))
    t = M.thirds(p, ["g"], "w", ["grp"])
    t = t.groupBy("g", "third").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("width"), F.avg("acc").alias("acc"))
    c = p.groupBy("g").agg(correlation("w", "acc").alias("pearson")).join(M.rank_correlation(p, ["g"], "w", "acc"), "g")
    return rounded(t.join(c, "g").drop("g"), "width", "acc", "pearson", "spearman")


@query("q_f1_logo_linear", f"""WITH {_RG},
g AS (SELECT grp, count(*)*1e0 n, sum(qty) sx, sum(price) sy, sum(qty*qty) sxx, sum(qty*price) sxy FROM rg GROUP BY 1),
t AS (SELECT sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy FROM g),
f AS (SELECT g.grp, t.n-g.n n, t.sx-g.sx sx, t.sy-g.sy sy, t.sxx-g.sxx sxx, t.sxy-g.sxy sxy FROM g, t),
c AS (SELECT grp, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS b, sy/n AS my, sx/n AS mx FROM f)
SELECT rg.grp, count(*) AS n, round(sqrt(avg(pow(price-(my+b*(qty-mx)),2))),6) AS rmse, round(avg(my+b*(qty-mx)),6) AS mean_prediction FROM rg JOIN c USING (grp) GROUP BY 1""")
def logo_linear(spark, sf):
    d = regression(spark, sf)
    p = M.predict(d, M.fit_folds(d, "grp", ["qty"], "price"), "grp", ["qty"], "row_id")
    e = F.col("price") - F.col("prediction")
    g = p.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("prediction").alias("mean_prediction"))
    return rounded(g, "rmse", "mean_prediction")


_SETS = {"all": ["qty", "disc"], "eye": ["qty"], "head": ["disc"]}


@query("q_f5_ablation", f"""WITH {_RG},
m AS (SELECT avg(qty) aq, avg(disc) ad, avg(price) mp FROM rg), z AS (SELECT grp, qty-aq q, disc-ad d, price-mp y FROM rg, m),
g AS (SELECT grp, count(*)*1e0 n, sum(q) q, sum(d) d, sum(y) y, sum(q*q) qq, sum(d*d) dd, sum(q*d) qd, sum(q*y) qy, sum(d*y) dy FROM z GROUP BY 1),
t AS (SELECT sum(n) n, sum(q) q, sum(d) d, sum(y) y, sum(qq) qq, sum(dd) dd, sum(qd) qd, sum(qy) qy, sum(dy) dy FROM g),
r AS (SELECT g.grp, t.n-g.n n, t.q-g.q q, t.d-g.d d, t.y-g.y y, t.qq-g.qq qq, t.dd-g.dd dd, t.qd-g.qd qd, t.qy-g.qy qy, t.dy-g.dy dy FROM g, t),
s AS (SELECT grp, n, q/n mq, d/n md, y/n my, qq-q*q/n qq, dd-d*d/n dd, qd-q*d/n qd, qy-q*y/n qy, dy-d*y/n dy FROM r),
c AS (SELECT grp, mq, md, my, 'all' AS feature_set, (qy*dd-dy*qd)/(qq*dd-qd*qd) AS bq, (dy*qq-qy*qd)/(qq*dd-qd*qd) AS bd FROM s UNION ALL SELECT grp, mq, md, my, 'eye', qy/qq, 0 FROM s UNION ALL SELECT grp, mq, md, my, 'head', 0, dy/dd FROM s),
p AS (SELECT feature_set, z.grp, y+mp AS y, my+mp+bq*(q-mq)+bd*(d-md) AS p FROM z JOIN c USING (grp), m),
a AS (SELECT feature_set, sqrt(avg(pow(y-p,2))) AS rmse, avg(CASE WHEN least(greatest(floor(p*3),0),2)=least(greatest(floor(y*3),0),2) THEN 1e0 ELSE 0e0 END) AS acc FROM p GROUP BY 1)
SELECT feature_set, round(rmse,6) AS rmse, round(acc,6) AS zone_accuracy, round(acc-(SELECT acc FROM a WHERE feature_set='all'),6) AS gap_to_all FROM a""")
def ablation(spark, sf):
    d = regression(spark, sf)
    p = M.predict(d, M.fit_folds(d, "grp", ["qty", "disc"], "price", _SETS), "grp", ["qty", "disc"], "row_id")
    e = F.col("price") - F.col("prediction")
    ok = M.strip_zone("prediction", 3) == M.strip_zone("price", 3)
    a = p.groupBy("feature_set").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(ok.cast("double")).alias("zone_accuracy"))
    full = a.where("feature_set = 'all'").select(F.col("zone_accuracy").alias("_full"), F.explode(F.array(*[F.lit(s) for s in _SETS])).alias("feature_set"))
    return rounded(a.join(full, "feature_set").withColumn("gap_to_all", F.col("zone_accuracy") - F.col("_full")).drop("_full"), "rmse", "zone_accuracy", "gap_to_all")


@query("q_f2_folds", f"""WITH {_RG},
g AS (SELECT grp, count(*) AS n FROM rg GROUP BY 1), p AS (SELECT n, row_number() OVER (ORDER BY n DESC, grp)-1 AS p FROM g),
f AS (SELECT n, CASE WHEN (p//5)%2=0 THEN p%5 ELSE 4-p%5 END AS fold FROM p)
SELECT CAST(fold AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups FROM f GROUP BY 1""")
def folds(spark, sf):
    d = regression(spark, sf)
    return d.join(M.group_folds(d, "grp", 5), "grp").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups"))


def _ridge_sql(alpha: str) -> str:
    """beta (q, d, t) of a ridge on standardised features from centred sums, by Cramer's rule: the
    penalty on a standardised feature is alpha times its variance on the plain one."""
    s = {i + j: i + j if i != j else f"({i}{j}*(1e0+{alpha}/n))" for i in "qdt" for j in "qdt" if i <= j}
    m = [[s[min(i, j) + max(i, j)] for j in "qdt"] for i in "qdt"]

    def det(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"

    def beta(k):
        return f"{det([[f'{r}y' if j == k else m[i][j] for j in range(3)] for i, r in enumerate('qdt')])}/{det(m)}"

    return ", ".join(f"{beta(k)} AS b{c}" for k, c in enumerate("qdt"))


# per group the centred sums of all other groups, for qty, disc, tax and price
_REST = f"""{_RG},
m AS (SELECT avg(qty) aq, avg(disc) ad, avg(tax) ax, avg(price) ay FROM rg), z AS (SELECT grp, qty-aq q, disc-ad d, tax-ax t, price-ay y, price FROM rg, m),
g AS (SELECT grp, count(*)*1e0 n, sum(q) q, sum(d) d, sum(t) t, sum(y) y, sum(q*q) qq, sum(d*d) dd, sum(t*t) tt, sum(y*y) yy, sum(d*q) dq, sum(q*t) qt, sum(d*t) dt, sum(q*y) qy, sum(d*y) dy, sum(t*y) ty FROM z GROUP BY 1),
a AS (SELECT sum(n) n, sum(q) q, sum(d) d, sum(t) t, sum(y) y, sum(qq) qq, sum(dd) dd, sum(tt) tt, sum(dq) dq, sum(qt) qt, sum(dt) dt, sum(qy) qy, sum(dy) dy, sum(ty) ty FROM g),
r AS (SELECT g.grp, a.n-g.n n, a.q-g.q q, a.d-g.d d, a.t-g.t t, a.y-g.y y, a.qq-g.qq qq, a.dd-g.dd dd, a.tt-g.tt tt, a.dq-g.dq dq, a.qt-g.qt qt, a.dt-g.dt dt, a.qy-g.qy qy, a.dy-g.dy dy, a.ty-g.ty ty FROM g, a),
s AS (SELECT grp, n, q/n mq, d/n md, t/n mt, y/n my, qq-q*q/n qq, dd-d*d/n dd, tt-t*t/n tt, dq-d*q/n dq, qt-q*t/n qt, dt-d*t/n dt, qy-q*y/n qy, dy-d*y/n dy, ty-t*y/n ty FROM r)"""


@query("q_f3_ridge_rows", f"""WITH {_REST},
c AS (SELECT *, {_ridge_sql('1e0')} FROM s)
SELECT grp, round(sqrt(avg(pow(y-my-bq*(z.q-mq)-bd*(z.d-md)-bt*(z.t-mt),2))),6) AS rmse FROM z JOIN (SELECT grp, mq, md, mt, my, bq, bd, bt FROM c) USING (grp) GROUP BY 1""")
def ridge(spark, sf):
    d = regression(spark, sf)
    p = M.predict(d, M.fit_folds(d, "grp", ["qty", "disc", "tax"], "price", alpha=1.0), "grp", ["qty", "disc", "tax"], "row_id")
    e = F.col("price") - F.col("prediction")
    return rounded(p.groupBy("grp").agg(F.sqrt(F.avg(e * e)).alias("rmse")), "rmse")


@query("q_f4_gbt_rows")
def gbt(spark, sf):
    d = regression(spark, sf)
    d = d.join(M.group_folds(d, "grp", GBT_FOLDS), "grp")
    d = d.withColumn("qty", F.when(F.col("disc") < 0.09, F.col("qty")))  # some features are missing
    p = B.cross_predictions(d.select("grp", "fold", "qty", "disc", "tax", "price"), "fold", ["qty", "disc", "tax"], "price")
    e = F.col("price") - F.col("prediction")
    return rounded(p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")), "rmse")


# min-max form of the monotone fit of points p (key, i, x, y, w): the largest, over starts at or before a
# point, of the smallest mean from there to any end at or after it
def _monotone_sql(key: str) -> str:
    return f"""u AS (SELECT *, sum(y*w) OVER o AS sy, sum(w) OVER o AS sw FROM p WINDOW o AS (PARTITION BY {key} ORDER BY i)),
seg AS (SELECT a.{key}, a.i AS a, b.i AS b, (b.sy-a.sy+a.y*a.w)/(b.sw-a.sw+a.w) AS m FROM u a JOIN u b ON a.{key}=b.{key} AND b.i>=a.i),
low AS (SELECT {key}, a, b, min(m) OVER (PARTITION BY {key}, a ORDER BY b DESC) AS m FROM seg),
fit AS (SELECT p.{key}, p.i, p.x, max(low.m) AS y FROM p JOIN low ON low.{key}=p.{key} AND low.b=p.i GROUP BY 1,2,3),
ends AS (SELECT {key}, min(x) AS lo, max(x) AS hi FROM fit GROUP BY 1),
nx AS (SELECT *, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM fit WINDOW o AS (PARTITION BY {key} ORDER BY i)),
kg AS (SELECT {key}, j, lo+(hi-lo)*j/23e0 AS kx FROM ends, (SELECT unnest(range(24)) AS j)),
kn AS (SELECT kg.{key}, j, kx, CASE WHEN x1>x THEN y+(y1-y)*(kx-x)/(x1-x) ELSE y END AS ky FROM kg ASOF JOIN nx ON kg.{key}=nx.{key} AND kg.kx>=nx.x)"""


@query("q_f6_isotonic_rows", f"""WITH {_RG},
p AS (SELECT flag, qty AS x, avg(price) AS y, count(*)*1e0 AS w, row_number() OVER (PARTITION BY flag ORDER BY qty) AS i FROM rg GROUP BY 1,2),
{_monotone_sql('flag')}
SELECT flag, CAST(j AS INTEGER) AS knot, round(kx,6) AS x, round(ky,6) AS y FROM kn""")
def isotonic(spark, sf):
    k = M.isotonic_knots(M.isotonic_blocks(regression(spark, sf), ["flag"], "qty", "price"), ["flag"])
    rows = k.select("flag", F.posexplode(F.arrays_zip("knots_x", "knots_y")).alias("knot", "k")).select("flag", "knot", F.col("k.knots_x").alias("x"), F.col("k.knots_y").alias("y"))
    return rounded(rows, "x", "y")


@query("q_f7_mapping_rows", """WITH rg AS (SELECT l_suppkey AS grp, l_extendedprice/100000e0 AS x, l_quantity/50 AS y, l_orderkey%2 AS held FROM lineitem),
p AS (SELECT grp, x, avg(y) AS y, count(*)*1e0 AS w, row_number() OVER (PARTITION BY grp ORDER BY x) AS i FROM rg WHERE held=0 GROUP BY 1,2),
g AS (SELECT grp, covar_pop(x,y) AS c, var_pop(y) AS vt, avg(x) AS mx, avg(y) AS my FROM rg WHERE held=0 GROUP BY 1),
f AS (SELECT grp, CASE WHEN abs(c/vt)>1e-3 THEN vt/c END AS a, my, mx FROM g),
""" + _monotone_sql("grp") + """,
kl AS (SELECT *, lead(kx) OVER o AS kx1, lead(ky) OVER o AS ky1 FROM kn WINDOW o AS (PARTITION BY grp ORDER BY j)),
t AS (SELECT rg.grp, least(greatest(floor(y*3),0),2) AS truth, least(greatest(CASE WHEN kx IS NULL THEN (SELECT ky FROM kn k0 WHERE k0.grp=rg.grp AND k0.j=0) WHEN kx1>kx THEN ky+(ky1-ky)*(x-kx)/(kx1-kx) ELSE ky END,0),1) AS mono
  FROM (SELECT * FROM rg WHERE held=1) rg ASOF LEFT JOIN kl ON rg.grp=kl.grp AND rg.x>=kl.kx),
l AS (SELECT rg.grp, least(greatest(floor(y*3),0),2) AS truth, least(greatest(a*x+(my-a*mx),0),1) AS line FROM rg JOIN f USING (grp) WHERE held=1),
sm AS (SELECT t.grp, count(*) AS n, avg(CASE WHEN truth=least(greatest(floor(mono*3),0),2) THEN 1e0 ELSE 0e0 END) AS am FROM t JOIN f USING (grp) GROUP BY 1),
sl AS (SELECT grp, avg(CASE WHEN truth=least(greatest(floor(line*3),0),2) THEN 1e0 ELSE 0e0 END) AS al FROM l GROUP BY 1)
SELECT f.grp, n AS held_out, round(al,6) AS accuracy_line, round(am,6) AS accuracy_monotone, CASE WHEN n>20 AND am>=al THEN 'isotonic' ELSE 'linear' END AS mapping FROM f LEFT JOIN sm USING (grp) LEFT JOIN sl USING (grp)""")
def mapping(spark, sf):
    d = regression(spark, sf).withColumn("target", F.col("qty") / 50)
    m = M.pick_mapping(d, ["grp"], "price", "target", "held_out", 3, "row_id")
    return m.select("grp", "held_out", r6(F.col("accuracy_line"), "accuracy_line"), r6(F.col("accuracy_monotone"), "accuracy_monotone"), "mapping")


@query("q_f8_alpha_rows", f"""WITH {_REST},
al AS (SELECT CAST(pow(1e1, -3+e*5e-1) AS DOUBLE) AS alpha FROM (SELECT unnest(range(13)) AS e)),
c AS (SELECT grp, alpha, mq, md, mt, my, {_ridge_sql('alpha')} FROM s, al)
SELECT round(alpha,9) AS alpha, round(avg(pow(y-my-bq*(z.q-mq)-bd*(z.d-md)-bt*(z.t-mt),2)),6) AS mse FROM z JOIN c USING (grp) GROUP BY 1""")
def alphas(spark, sf):
    return rounded(M.alpha_search(regression(spark, sf), "grp", ["qty", "disc", "tax"], "price"), "mse").withColumn("alpha", F.round("alpha", 9))


@query("q_f10_pipeline_rows", f"""WITH {_RG},
m AS (SELECT count(*)*1e0 AS n, avg(qty) mq, avg(disc) md, avg(price) my, var_samp(qty) vq, var_samp(disc) vd, count(*)*var_pop(qty) qq, count(*)*var_pop(disc) dd, count(*)*covar_pop(qty,disc) qd, count(*)*covar_pop(qty,price) qy, count(*)*covar_pop(disc,price) dy FROM rg),
b AS (SELECT *, ((dd+vd)*qy-qd*dy)/((qq+vq)*(dd+vd)-qd*qd) AS bq, ((qq+vq)*dy-qd*qy)/((qq+vq)*(dd+vd)-qd*qd) AS bd FROM m)
SELECT flag, round(avg(my+bq*(qty-mq)+bd*(disc-md)),6) AS mean_prediction, round(avg(price),6) AS mean_price FROM rg, b GROUP BY 1""")
def pipeline(spark, sf):
    d = regression(spark, sf)
    return M.ridge_fit(d, ["qty", "disc"], "price").transform(d).groupBy("flag").agg(r6(F.avg("prediction"), "mean_prediction"), r6(F.avg("price"), "mean_price"))


_PER = "units AS (SELECT grid, subject AS unit, avg(CASE WHEN zt=zp THEN 1e0 ELSE 0e0 END) AS v FROM pz GROUP BY grid, subject)"


@query("q_e3_bca", sql(f"""WITH {_PER},
{bca_sql('units', 'grid', BCA_REPS)}
SELECT grid, n, round(est,6) AS estimate, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM c_bca""", "pz"))
def bca(spark, sf):
    per = C.group_accuracy(C.zone_answers(predictions(spark, sf)), ["grid"], "subject")
    return rounded(bca_ci(per, ["grid"], "subject", "acc"), "estimate", "ci_lo", "ci_hi")
