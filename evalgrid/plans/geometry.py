"""Eye and head geometry and piecewise maps over numeric columns of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.functions.geometry import centred, eye_geometry, head_angles
from evalgrid.operators.models import add_interpolated
from evalgrid.plans.registry import query
from evalgrid.plans.roles import table

KEYS = ["l_orderkey", "l_linenumber"]


def numbers(spark, sf):
    """LM: q in (0, 1], d and x two small numbers, p a price below two; the row's key."""
    c = table(spark, sf, "lineitem")
    return c.select(*KEYS, (F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"), (F.col("l_extendedprice") / 100000).alias("p"))


_LM = "lm AS (SELECT l_orderkey, l_linenumber, l_quantity/50 AS q, l_discount AS d, l_tax AS x, l_extendedprice/100000e0 AS p FROM lineitem)"


def _rounded(df, *cols, digits=9):
    return df.select(*KEYS, *[F.round(c, digits).alias(n) for n, c in cols])


# every fourth eye is mirrored, some are shut; the SQL projects on a unit axis and its normal
@query("q_b16_eye_geometry", f"""WITH {_LM},
e AS (SELECT *, CASE WHEN l_linenumber=4 THEN -1e0 ELSE 1e0 END AS m FROM lm),
pts AS (SELECT *, q AS ox, d AS oy, q+m*(sqrt(5e-2)+x) AS nx, d+x/3 AS ny, q+m*1e-1 AS ux, d-d/3 AS uy, q+m*11e-2 AS lx, d+x/3+sqrt(2e-4) AS ly, q+m*p/10 AS ix, d+x/7 AS iy FROM e),
w AS (SELECT *, sqrt(pow(nx-ox,2)+pow(ny-oy,2)) AS w, sqrt(pow(lx-ux,2)+pow(ly-uy,2)) AS gap FROM pts),
a AS (SELECT *, (nx-ox)/w AS ax, (ny-oy)/w AS ay, CASE WHEN nx<ox THEN -1e0 ELSE 1e0 END AS s FROM w),
n AS (SELECT *, -s*ay AS bx, s*ax AS by_ FROM a),
o AS (SELECT *, (ix-ux)*bx+(iy-uy)*by_ AS down, (lx-ux)*bx+(ly-uy)*by_ AS deep FROM n)
SELECT l_orderkey, l_linenumber, round(((ix-ox)*ax+(iy-oy)*ay)/w,6) AS h, round(((ix-ox)*bx+(iy-oy)*by_)/w,6) AS v, round(CASE WHEN gap/w>=5e-2 AND abs(deep)>1e-6 THEN greatest(-1e0,least(2e0,down/deep)) END,6) AS vlid,
 round(gap/w,6) AS open, round(w,6) AS width_px FROM o""")
def eye(spark, sf):
    q, d, x, p = (F.col(c) for c in "qdxp")
    m = F.when(F.col("l_linenumber") == 4, F.lit(-1.0)).otherwise(F.lit(1.0))
    points = [(q, d), (q + m * (F.sqrt(F.lit(0.05)) + x), d + x / 3), (q + m * 0.1, d - d / 3), (q + m * 0.11, d + x / 3 + F.sqrt(F.lit(0.0002))), (q + m * p / 10, d + x / 7)]
    return _rounded(numbers(spark, sf), *eye_geometry(*points).items(), digits=6)


# a rotation built from three angles gives the angles back
@query("q_b17_head_angles", f"""WITH {_LM}
SELECT l_orderkey, l_linenumber, round(degrees((q-5e-1)*2),9) AS yaw, round(degrees(d*20-1),9) AS pitch, round(degrees(x*30-12e-1),9) AS roll FROM lm""")
def head(spark, sf):
    yaw, pitch, roll = (F.col("q") - 0.5) * 2, F.col("d") * 20 - 1, F.col("x") * 30 - 1.2
    none = F.lit(0.0)  # entries that the angles do not need
    r = [[F.cos(roll) * F.cos(yaw), none, none], [F.sin(roll) * F.cos(yaw), none, none], [-F.sin(yaw), F.cos(yaw) * F.sin(pitch), F.cos(yaw) * F.cos(pitch)]]
    return _rounded(numbers(spark, sf), *head_angles(r).items())


@query("q_b18_centred", f"""WITH {_LM} SELECT l_orderkey, l_linenumber, round((q+d+x)/3-p+5e-1,9) AS centred FROM lm""")
def centre(spark, sf):
    return _rounded(numbers(spark, sf), ("centred", centred(F.array("q", "d", "x"), F.col("p"))))


@query("q_b27_piecewise", f"""WITH {_LM}, g AS (SELECT *, q*125e-2 AS g FROM lm)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber=7 THEN NULL WHEN g<1e-1 THEN d WHEN g<4e-1 THEN d+(x-d)*(g-1e-1)/3e-1 WHEN g<1e0 THEN x+(5e-1-x)*(g-4e-1)/6e-1 ELSE 5e-1 END,9) AS mapped FROM g""")
def piecewise(spark, sf):
    d = numbers(spark, sf).withColumn("g", F.when(F.col("l_linenumber") != 7, F.col("q") * 1.25))
    d = d.withColumn("kx", F.array(*[F.lit(k) for k in (0.1, 0.4, 1.0)])).withColumn("ky", F.array("d", "x", F.lit(0.5)))
    return _rounded(add_interpolated(d, "g", "kx", "ky", "mapped"), ("mapped", F.col("mapped")))
