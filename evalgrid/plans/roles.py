"""The given tables read in the roles the operators work on, in Spark and as SQL views.

EV  interface event log      events: a purchase closes a trial
PR  predictions with truth   events: signup plays "no face found"
RS  reference stream         events of type view
FR  frame stream             events of type error
RL  ranked lists             lineitem of each order in three orders, named by part
RV  truth per unit           orders: verified present / absent categories
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions.draws import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_SPLIT, ERFC, poisson_thresholds

from evalgrid.operators.skew import running

HOUR = 3_600_000_000
DAY = 24 * HOUR
KEYS = ["participant", "trial"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV: trial number = purchases so far, counted per day and carried over days."""
    b = base(spark, sf_dir).select(
        "*",
        F.floor(F.col("t_us") / DAY).alias("slot"),
        (F.col("event_type") == "purchase").cast("int").alias("closes"),
    )
    d = running(b, ["user_id"], "slot", ["t_us", "event_id"], count="seq", sums={"n_closed": "closes"})
    d = d.withColumn("trial", F.col("n_closed").cast("int"))
    mix = F.col("user_id") + F.col("trial")
    event = (
        F.when(F.col("event_type") == "click", "select")
        .when(F.col("event_type") == "error", "reject")
        .when(F.col("event_type") == "view", "dwell")
        .when(F.col("event_type") == "signup", "page")
        .otherwise("trial_end")
    )
    return d.select(
        F.col("user_id").alias("participant"),
        "trial",
        F.floor(F.col("trial") / 5).cast("int").alias("block"),
        F.col("seq").cast("bigint").alias("seq"),
        "t_us",
        F.col("value").alias("frame_ms"),
        event.alias("event"),
        F.when(mix % 2 == 0, "direct").otherwise("scan").alias("pattern"),
        F.when(mix % 4 < 2, "none").otherwise("double").alias("guard"),
        F.when(mix % 8 < 4, "free").otherwise("calibrated").alias("calib"),
        ((F.col("user_id") * 7 + F.col("trial")) % 5).cast("bigint").alias("cue_item"),
        F.when(F.col("k") % 11 > 0, (F.col("k") % 5).cast("bigint")).alias("item"),
        (F.col("k") % 3).cast("int").alias("zone"),
        (F.col("user_id") % 4).cast("int").alias("site"),
        F.when((F.col("user_id") % 10 == 0) | (F.col("k") % 4 == 0), F.lit(None))
        .otherwise(mix % 3)
        .cast("int")
        .alias("cue_zone"),
        F.when(F.col("k") % 7 == 0, "skipped").otherwise((F.floor(F.col("value") * 10)).cast("string")).alias("detail"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR: prediction / truth pairs of 15 subjects."""
    b = base(spark, sf_dir)
    seen = F.col("event_type") != "signup"
    gx, gy = F.col("k") / F.lit(100.0), (F.col("event_id") % 97) / F.lit(97.0)
    return b.select(
        "event_id",
        (F.col("user_id") % 15).alias("subject"),
        "t_us",
        gx.alias("gx"),
        gy.alias("gy"),
        F.when(seen, F.lit(0.7) * gx + F.lit(0.3) * F.col("value") / F.lit(500.0)).alias("px"),
        F.when(seen, F.lit(0.6) * gy + F.lit(0.4) * F.col("value") / F.lit(500.0)).alias("py"),
        (250 + 20 * (F.col("user_id") % 5)).alias("screen_w_mm"),
        (160 + 10 * (F.col("user_id") % 3)).alias("screen_h_mm"),
    )


def reference_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("event_type") == "view").select(
        F.col("user_id").alias("participant"), "t_us", F.col("value").alias("tx"),
        F.when(F.col("k") % 10 == 0, 0).otherwise(1).alias("tvalid"),
    )


def frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("event_type") == "error").select(
        F.col("user_id").alias("participant"), "event_id", "t_us", F.col("value").alias("px"), "k"
    )


# The category names of the ranked-list role (position = id); "rod" is left out on
# purpose so that some items match nothing, and "gizmo" is an alias of "widget".
CATEGORIES = ["anvil", "bolt", "gear", "plate", "ring", "widget", "hammer"]
ALIASES = {"gizmo": "widget"}
GROUPS = [["bolt", "ring"], ["gear", "plate"]]


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL: (method, unit, place, item, category), `place` a struct that orders a list. Method qty
    lists small quantities only, so it does not cover every unit."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("unit"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item"))
    keys = {"line": F.col("l_linenumber").cast("double"), "price": -F.col("l_extendedprice"), "qty": F.col("l_quantity")}
    ties = [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    methods = F.array(
        *[F.struct(F.lit(m).alias("method"), F.struct(k.alias("key"), *ties).alias("place")) for m, k in keys.items()]
    )
    noun = F.element_at(F.split("item", " "), -1)
    for alias, name in ALIASES.items():
        noun = F.when(F.element_at(F.split("item", " "), -1) == alias, F.lit(name)).otherwise(noun)
    cat = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), noun) - 1
    return (
        li.join(part, "l_partkey")
        .select("*", F.explode(methods).alias("m"))
        .where((F.col("m.method") != "qty") | (F.col("l_quantity") <= 40))
        .select("m.method", "unit", "m.place", "item", F.when(cat >= 0, cat).cast("int").alias("category"))
    )


def unit_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV: verified labels per unit; pos_l / neg_l is the single-source variant."""
    c = F.col("o_custkey")
    def ids(*steps):
        return F.array_sort(F.array_distinct(F.array(*[((c + s) % 7).cast("int") for s in steps])))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("room"),
        (F.col("o_totalprice") / 1000).alias("seconds"),
        ids(0, 3).alias("pos"), ids(1, 2, 5).alias("neg"), ids(0).alias("pos_l"), ids(1, 2).alias("neg_l"),
    )


# ---- the same roles as SQL views -------------------------------------------------------------

VIEWS: dict[str, tuple[list[str], str]] = {
    "b": ([], """SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us,
        CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events"""),
    "evt": (["b"], """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS seq,
        CAST(coalesce(sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS INT) AS trial FROM b"""),
    "ev": (["evt"], """SELECT user_id AS participant, trial, trial//5 AS block, seq, t_us, value AS frame_ms,
        CASE event_type WHEN 'click' THEN 'select' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'dwell'
                        WHEN 'signup' THEN 'page' ELSE 'trial_end' END AS event,
        CASE WHEN (user_id+trial)%2=0 THEN 'direct' ELSE 'scan' END AS pattern,
        CASE WHEN (user_id+trial)%4<2 THEN 'none' ELSE 'double' END AS guard,
        CASE WHEN (user_id+trial)%8<4 THEN 'free' ELSE 'calibrated' END AS calib,
        CAST((user_id*7+trial)%5 AS BIGINT) AS cue_item, CASE WHEN k%11>0 THEN CAST(k%5 AS BIGINT) END AS item, k%3 AS zone,
        CAST(user_id%4 AS INT) AS site,
        CASE WHEN user_id%10=0 OR k%4=0 THEN NULL ELSE CAST((user_id+trial)%3 AS INT) END AS cue_zone,
        CASE WHEN k%7=0 THEN 'skipped' ELSE CAST(CAST(floor(value*10) AS BIGINT) AS VARCHAR) END AS detail FROM evt"""),
    "pr": (["b"], """SELECT event_id, user_id%15 AS subject, t_us, k/100e0 AS gx, (event_id%97)/97e0 AS gy,
        CASE WHEN event_type='signup' THEN NULL ELSE 7e-1*(k/100e0) + 3e-1*value/500e0 END AS px,
        CASE WHEN event_type='signup' THEN NULL ELSE 6e-1*((event_id%97)/97e0) + 4e-1*value/500e0 END AS py,
        250+20*(user_id%5) AS screen_w_mm, 160+10*(user_id%3) AS screen_h_mm FROM b"""),
    "grids": ([], """SELECT * FROM (VALUES ('1x2',1,2),('2x1',2,1),('1x3',1,3),('2x2',2,2),('3x3',3,3),('4x4',4,4)) g(grid,rows_,cols_)"""),
    "pz": (["pr", "grids"], """SELECT event_id, subject, grid, rows_*cols_ AS n_zones,
        CAST(least(greatest(floor(gy*rows_),0),rows_-1)*cols_ + least(greatest(floor(gx*cols_),0),cols_-1) AS INT) AS zt,
        CASE WHEN px IS NULL OR py IS NULL THEN -1 ELSE
        CAST(least(greatest(floor(py*rows_),0),rows_-1)*cols_ + least(greatest(floor(px*cols_),0),cols_-1) AS INT) END AS zp FROM pr, grids"""),
    "rs": (["b"], """SELECT user_id AS participant, t_us, value AS tx, CASE WHEN k%10=0 THEN 0 ELSE 1 END AS tvalid FROM b WHERE event_type='view'"""),
    "fr": (["b"], """SELECT user_id AS participant, event_id, t_us, value AS px, k FROM b WHERE event_type='error'"""),
    "noun": ([], """SELECT p_partkey, p_name AS item, CASE split_part(p_name,' ',2) WHEN 'anvil' THEN 0 WHEN 'bolt' THEN 1 WHEN 'gear' THEN 2
        WHEN 'plate' THEN 3 WHEN 'ring' THEN 4 WHEN 'widget' THEN 5 WHEN 'gizmo' THEN 5 END AS category FROM part"""),
    "rl0": (["noun"], """SELECT l_orderkey AS unit, item, category, l_partkey, l_suppkey, l_extendedprice, l_linenumber, l_quantity
        FROM lineitem JOIN noun ON l_partkey=p_partkey"""),
    "rl": (["rl0"], """SELECT 'line' AS method, unit, item, category, row_number() OVER (PARTITION BY unit ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS pos FROM rl0
        UNION ALL SELECT 'price', unit, item, category, row_number() OVER (PARTITION BY unit ORDER BY -l_extendedprice,l_partkey,l_suppkey,l_extendedprice) FROM rl0
        UNION ALL SELECT 'qty', unit, item, category, row_number() OVER (PARTITION BY unit ORDER BY l_quantity,l_partkey,l_suppkey,l_extendedprice) FROM rl0 WHERE l_quantity<=40"""),
    "rv": ([], """SELECT o_orderkey AS unit, o_orderpriority AS room, o_totalprice/1000 AS seconds,
        list_sort([CAST(o_custkey%7 AS INT),CAST((o_custkey+3)%7 AS INT)]) AS pos,
        list_sort([CAST((o_custkey+1)%7 AS INT),CAST((o_custkey+2)%7 AS INT),CAST((o_custkey+5)%7 AS INT)]) AS neg,
        [CAST(o_custkey%7 AS INT)] AS pos_l, list_sort([CAST((o_custkey+1)%7 AS INT),CAST((o_custkey+2)%7 AS INT)]) AS neg_l FROM orders"""),
}


def sql(body: str, *views: str) -> str:
    """`body` with the named role views (and what they build on) in front."""
    done: list[str] = []

    def add(v: str) -> None:
        for dep in VIEWS[v][0]:
            add(dep)
        if v not in done:
            done.append(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in done)
    body = body.strip()
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"


def bootstrap_sql(units: str, cell: str, reps: int, seed: int = 0) -> str:
    """CTEs b_est, b_mean (replicate means) and b_ci over a CTE `units` with columns `cell`, unit (an
    integer), v (finite): Poisson(1) weights by hash, as functions.draws.poisson_weights."""
    weight = " + ".join(f"(x>={at})::INT" for at in poisson_thresholds())
    return f"""
b_est AS (SELECT {cell}, count(*) AS n, avg(v) AS est FROM {units} GROUP BY {cell}),
b_x0 AS (SELECT {cell}, v, rep, ({seed * 374761393}::BIGINT + rep*668265263 + (unit & 4294967295)*1640531527) & 4294967295 AS x
         FROM {units} JOIN (SELECT {cell} FROM b_est WHERE n>=2) USING ({cell}), range({reps}) r(rep)),
b_x1 AS (SELECT {cell}, v, rep, (xor(x>>16, x)*73244475) & 4294967295 AS x FROM b_x0),
b_x2 AS (SELECT {cell}, v, rep, (xor(x>>16, x)*73244475) & 4294967295 AS x FROM b_x1),
b_x3 AS (SELECT {cell}, v, rep, xor(x>>16, x) AS x FROM b_x2),
b_w AS (SELECT {cell}, v, rep, {weight} AS w FROM b_x3),
b_mean AS (SELECT {cell}, rep, sum(v*w)/sum(w) AS m FROM b_w GROUP BY {cell}, rep HAVING sum(w)>0),
b_ci AS (SELECT {cell}, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM b_mean GROUP BY {cell})"""


def _poly_sql(x: str, coef: list[float]) -> str:
    out = repr(coef[0])
    for c in coef[1:]:
        out = f"({out}*{x}+({c!r}))"
    return out


def _quantile_sql(p: str) -> str:
    """functions.draws.normal_quantile of a column or number `p`."""
    q, r = f"({p}-0.5e0)", f"(({p}-0.5e0)*({p}-0.5e0))"
    tail = lambda u: f"({_poly_sql(f'sqrt(-2e0*ln({u}))', ACKLAM_C)}/{_poly_sql(f'sqrt(-2e0*ln({u}))', ACKLAM_D)})"
    return (
        f"CASE WHEN {p}<=0 OR {p}>=1 THEN NULL WHEN {p}<{ACKLAM_SPLIT} THEN {tail(p)} WHEN {p}>1-{ACKLAM_SPLIT} THEN -{tail(f'(1e0-{p})')} "
        f"ELSE {q}*{_poly_sql(r, ACKLAM_A)}/{_poly_sql(r, ACKLAM_B)} END"
    )


def bca_sql(units: str, cell: str, reps: int) -> str:
    """CTEs of bootstrap_sql and c_bca (cell, n, est, ci_lo, ci_hi): bias-corrected accelerated ends."""
    ends = []
    for name, p in (("lo", 0.025), ("hi", 0.975)):
        ends.append(f"""
c_{name}1 AS (SELECT *, z0+({_quantile_sql(f'{p}e0')}) AS z FROM c_q),
c_{name}2 AS (SELECT *, z0+z/(1e0-a*z) AS y, 1e0/(1e0+0.5e0*(abs(z0+z/(1e0-a*z))/sqrt(2e0))) AS t FROM c_{name}1),
c_{name}3 AS (SELECT *, t*exp(-(abs(y)/sqrt(2e0))*(abs(y)/sqrt(2e0))+{_poly_sql('t', ERFC)}) AS tl FROM c_{name}2),
c_{name}4 AS (SELECT *, CASE WHEN y>=0 THEN 1e0-tl/2 ELSE tl/2 END AS s FROM c_{name}3),
c_{name}5 AS (SELECT *, (CASE WHEN isfinite(s) AND s>=0 AND s<=1 THEN s ELSE {p}e0 END)*(len(ms)-1) AS pos FROM c_{name}4),
c_{name} AS (SELECT {cell}, CASE WHEN abs(mx-mn)<=1e-8+1e-5*abs(mn) THEN mn WHEN n>=2 THEN
  ms[CAST(floor(pos) AS INT)+1]+(ms[CAST(ceil(pos) AS INT)+1]-ms[CAST(floor(pos) AS INT)+1])*(pos-floor(pos)) END AS ci_{name} FROM c_{name}5)""")
    return f"""{bootstrap_sql(units, cell, reps)},
c_s AS (SELECT {cell}, b_est.n, est, min(v) AS mn, max(v) AS mx, avg((v-est)*(v-est)) AS m2, avg((v-est)*(v-est)*(v-est)) AS m3 FROM {units} JOIN b_est USING ({cell}) GROUP BY {cell}, b_est.n, est),
c_m AS (SELECT {cell}, list(m ORDER BY m) AS ms, (count(*) FILTER (WHERE m<est)+count(*) FILTER (WHERE m<=est))/(2e0*count(*)) AS share FROM b_mean JOIN b_est USING ({cell}) GROUP BY {cell}),
c_q AS (SELECT *, {_quantile_sql('share')} AS z0, CASE WHEN m2>0 THEN m3/pow(m2,1.5e0) END/(6e0*sqrt(n)) AS a FROM c_s LEFT JOIN c_m USING ({cell})),{ends[0]},{ends[1]},
c_bca AS (SELECT {cell}, n, est, ci_lo, ci_hi FROM c_q JOIN c_lo USING ({cell}) JOIN c_hi USING ({cell}))"""
