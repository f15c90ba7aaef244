"""Live-session operators on the stored log (batch twins of the stream operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.operators.skew import running
from evalgrid.plans.registry import query
from evalgrid.plans.roles import DAY, HOUR, event_log, sql, table
from evalgrid.streaming import live as L

STEP, WIDE, GAP = 6 * HOUR, 4, 36 * HOUR  # windows of a day every six hours, silent for a day and a half

CHAIN = """
nx AS (SELECT a.participant, a.t, min(b.t) AS nx FROM k a JOIN k b ON b.participant=a.participant AND b.t>=a.t+{gap} GROUP BY 1,2),
ch AS (SELECT participant, min(t) AS t FROM k GROUP BY 1 UNION ALL SELECT ch.participant, nx.nx FROM ch JOIN nx ON nx.participant=ch.participant AND nx.t=ch.t)
"""


def recursive(body: str, *views: str) -> str:
    return sql(body, *views).replace("WITH ", "WITH RECURSIVE ", 1)


def _choices(spark, sf):
    """Choices of a participant, numbered from 1."""
    s = event_log(spark, sf).where("event = 'select'").select("participant", "zone", "seq", "t_us").withColumn("slot", F.floor(F.col("seq") / 100_000))
    return running(s, ["participant"], "slot", ["seq"], count="n").drop("slot")


CHOICES = "s AS (SELECT participant, zone, seq, t_us, row_number() OVER (PARTITION BY participant ORDER BY seq) AS n FROM ev WHERE event='select')"


@query("q_l1_dwell", recursive(f"""
WITH w AS (SELECT participant, (t_us//{STEP}-k+{WIDE})*{STEP} AS t, CASE WHEN event<>'page' THEN zone END AS zone FROM ev, range({WIDE}) r(k)),
c AS (SELECT participant, t, count(*) AS n, count(*) FILTER (WHERE zone=0) AS z0, count(*) FILTER (WHERE zone=1) AS z1, count(*) FILTER (WHERE zone=2) AS z2 FROM w GROUP BY 1,2),
k AS (SELECT participant, t, CASE WHEN z0=greatest(z0,z1,z2) THEN 0 WHEN z1=greatest(z0,z1,z2) THEN 1 ELSE 2 END AS zone FROM c WHERE n>=2 AND greatest(z0,z1,z2)>=0.6*n),
{CHAIN.format(gap=GAP)} SELECT k.participant, k.t, k.zone FROM k JOIN ch ON ch.participant=k.participant AND ch.t=k.t""", "ev"))
def dwell(spark, sf):
    seen = event_log(spark, sf).select("participant", F.timestamp_micros("t_us").alias("ts"), F.when(F.col("event") != "page", F.col("zone")).alias("zone"))
    c = L.dwell_candidates(seen, ["participant"], "ts", "zone", 3, f"{STEP * WIDE // HOUR} hours", f"{STEP // HOUR} hours", 0.6, 2)
    return L.refractory(c, ["participant"], "t", GAP, 7 * DAY)


@query("q_l3_confirm", sql(f"""
WITH {CHOICES} SELECT participant, seq, CASE WHEN n%2=1 THEN 'ask' WHEN zone=0 THEN 'select' ELSE 'cancel' END AS step,
 CASE WHEN n%2=1 THEN zone ELSE lag(zone) OVER (PARTITION BY participant ORDER BY n) END AS item FROM s""", "ev"))
def confirm(spark, sf):
    return L.two_step(_choices(spark, sf), ["participant"], "n", "zone").select("participant", "seq", "step", "item")


@query("q_l4_timer", sql(f"""
WITH {CHOICES}, d AS (SELECT *, t_us-min(t_us) OVER (PARTITION BY participant) AS since FROM s),
r AS (SELECT *, since//{DAY} AS turns FROM d)
SELECT participant, seq, CAST(turns%3 AS INTEGER) AS page, turns>0 AND since-turns*{DAY}<{2*HOUR} AS locked,
 coalesce(turns<>lag(turns) OVER (PARTITION BY participant ORDER BY n), false) AS cancelled FROM r""", "ev"))
def timer(spark, sf):
    return L.timed_pages(_choices(spark, sf), ["participant"], "t_us", "n", DAY, 3, 2 * HOUR).select("participant", "seq", "page", "locked", "cancelled")


@query("q_l5_user", sql(f"""
WITH {CHOICES}, r AS (SELECT *, coalesce(sum(CASE WHEN zone=2 THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS turns FROM s),
i AS (SELECT *, (turns%3)*2+zone AS number FROM r)
SELECT participant, seq, CAST((turns+(zone=2)::INT)%3 AS INTEGER) AS page, CASE WHEN zone=2 THEN 'page' WHEN number<5 THEN 'item' ELSE 'blank' END AS choice,
 CASE WHEN zone<>2 AND number<5 THEN CAST(number AS INTEGER) END AS item FROM i""", "ev"))
def user(spark, sf):
    return L.user_pages(_choices(spark, sf), ["participant"], "n", "zone", 2, 2, 5).select("participant", "seq", "page", "choice", "item")


@query("q_l6_alerts", recursive(f"""
WITH s AS (SELECT participant, seq, t_us//1000 AS t, median(frame_ms) OVER (PARTITION BY participant ORDER BY seq ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS med FROM ev),
k AS (SELECT participant, t, arg_min(med, seq) AS median_ms FROM s WHERE seq>=40 AND med>40.0 GROUP BY 1,2),
{CHAIN.format(gap=24*3600*1000+1)} SELECT k.participant, k.t, k.median_ms FROM k JOIN ch ON ch.participant=k.participant AND ch.t=k.t""", "ev"))
def alerts(spark, sf):
    log = event_log(spark, sf).withColumn("t", F.floor(F.col("t_us") / 1000))
    return L.rate_alerts_batch(log, ["participant"], "t", "seq", "frame_ms", limit=40.0, every=24 * 3600 * 1000)


@query("q_l2_repeat", sql("""
WITH s AS (SELECT participant, zone, seq, row_number() OVER (PARTITION BY participant ORDER BY seq) AS n FROM ev WHERE event='select'),
f AS (SELECT *, CASE WHEN zone IS DISTINCT FROM lag(zone) OVER (PARTITION BY participant ORDER BY n) THEN 1 ELSE 0 END AS nw FROM s),
r AS (SELECT *, sum(nw) OVER (PARTITION BY participant ORDER BY n) AS run FROM f),
c AS (SELECT participant, run, min(n) AS first, count(*) AS len FROM r GROUP BY 1,2),
p AS (SELECT *, lag(len) OVER (PARTITION BY participant ORDER BY run) AS before FROM c)
SELECT r.participant, seq, CASE WHEN (n-first)%2=1 THEN 'select' WHEN n=first AND coalesce(before%2=1,false) THEN 'disagreed' ELSE 'first of two' END AS verdict FROM r JOIN p ON p.participant=r.participant AND p.run=r.run""", "ev"))
def repeat(spark, sf):
    return L.repeat_confirm(_choices(spark, sf), ["participant"], "n", "zone").select("participant", "seq", "verdict")


@query("q_l7_trials", sql("""
SELECT participant, trial, count(*) FILTER (WHERE event='select') AS selections, count(*) FILTER (WHERE event='reject') AS rejects, max(CASE WHEN event='trial_end' THEN t_us END) AS closed_at,
 max(CASE WHEN event='trial_end' THEN item END) AS item, bool_or(event='trial_end' AND coalesce(item=cue_item,false)) AS correct FROM ev GROUP BY 1,2 HAVING count(*) FILTER (WHERE event='trial_end')>0""", "ev"))
def trials(spark, sf):
    return L.trials_batch(event_log(spark, sf), "participant")


@query("q_l8_windows", f"""
SELECT (epoch_us(ts)//{DAY})*{DAY} AS w_start, event_type, count(*) AS n FROM events GROUP BY 1,2""")
def windows(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return L.windowed_counts(e, "ts", ["event_type"], "1 day").withColumn("w_start", F.unix_micros("w_start"))


@query("q_l8_dedupe", f"""
SELECT DISTINCT user_id, event_type, epoch_us(ts)//{DAY} AS day FROM events""")
def dedupe(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY).alias("day"))
    return L.first_seen(e, "ts", ["user_id", "event_type", "day"])


# Repeat guard behind a page timer (turns and pauses) and behind pages that the user turns.
GUARD = """e AS (SELECT *, sum(ended::INT) OVER (PARTITION BY participant ORDER BY n) AS part FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY participant, part ORDER BY n) AS nth FROM e WHERE counts),
f AS (SELECT *, CASE WHEN zone IS DISTINCT FROM lag(zone) OVER (PARTITION BY participant, part ORDER BY nth) THEN 1 ELSE 0 END AS nw FROM m),
q AS (SELECT *, sum(nw) OVER (PARTITION BY participant, part ORDER BY nth) AS run FROM f),
c AS (SELECT participant, part, run, min(nth) AS first, count(*) AS len FROM q GROUP BY 1,2,3),
p AS (SELECT *, lag(len) OVER (PARTITION BY participant, part ORDER BY run) AS before FROM c)
SELECT q.participant, seq, page, CASE WHEN (nth-first)%2=1 THEN 'select' WHEN nth=first AND coalesce(before%2=1,false) THEN 'disagreed' ELSE 'first of two' END AS verdict
FROM q JOIN p ON p.participant=q.participant AND p.part=q.part AND p.run=q.run"""


@query("q_l4_guarded_timer", sql(f"""
WITH {CHOICES}, d AS (SELECT *, t_us-min(t_us) OVER (PARTITION BY participant) AS since FROM s), r AS (SELECT *, since//{DAY} AS turns FROM d),
g AS (SELECT *, CAST(turns%3 AS INTEGER) AS page, NOT (turns>0 AND since-turns*{DAY}<{2*HOUR}) AS counts, coalesce(turns<>lag(turns) OVER (PARTITION BY participant ORDER BY n), false) AS ended FROM r),
{GUARD}""", "ev"))
def guarded_timer(spark, sf):
    d = L.timed_pages(_choices(spark, sf), ["participant"], "t_us", "n", DAY, 3, 2 * HOUR)
    return L.repeat_within(d, ["participant"], "n", "zone", F.col("cancelled"), ~F.col("locked")).select("participant", "seq", "page", "verdict")


@query("q_l5_guarded_user", sql(f"""
WITH {CHOICES}, r AS (SELECT *, coalesce(sum(CASE WHEN zone=2 THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS turns FROM s),
g AS (SELECT *, CAST((turns+(zone=2)::INT)%3 AS INTEGER) AS page, zone=2 AS ended, zone<>2 AND (turns%3)*2+zone<5 AS counts FROM r),
{GUARD}""", "ev"))
def guarded_user(spark, sf):
    d = L.user_pages(_choices(spark, sf), ["participant"], "n", "zone", 2, 2, 5)
    return L.repeat_within(d, ["participant"], "n", "zone", F.col("choice") == "page", F.col("choice") == "item").select("participant", "seq", "page", "verdict")
