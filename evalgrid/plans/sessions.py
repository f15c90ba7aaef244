"""Event-log queries: reachability, condition tables, clustered intervals, hypotheses, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.functions.scores import hypothesis_verdict, same_item
from evalgrid.operators import trials as T
from evalgrid.operators.claims import as_claims, check
from evalgrid.operators.resample import stratified_ci
from evalgrid.operators.skew import attach
from evalgrid.plans.classification import r6, rounded
from evalgrid.plans.registry import query
from evalgrid.plans.roles import KEYS, bootstrap_sql, event_log, sql, table
from evalgrid.session import cut_lineage

CELL = ["pattern", "guard", "calib"]
REPS = 5000

_REACH = """
st AS (SELECT participant, trial, arg_min(cue_zone, seq) FILTER (WHERE cue_zone IS NOT NULL) AS cue_zone_at_start,
  arg_min(cue_zone IS NOT NULL, seq) AS first_on FROM ev WHERE event<>'trial_end' GROUP BY 1,2),
rc AS (SELECT participant, count(cue_zone)>0 AS cue_recorded FROM ev GROUP BY 1),
re AS (SELECT st.*, cue_recorded, NOT cue_recorded OR cue_zone_at_start IS NOT NULL AS reachable FROM st JOIN rc USING (participant)),
sel AS (SELECT ev.*, coalesce(item=cue_item,false) AS correct FROM ev LEFT JOIN re USING (participant, trial) WHERE event IN ('select','reject') AND coalesce(reachable,true)),
te AS (SELECT ev.*, TRY_CAST(detail AS DOUBLE) AS raw_ms, TRY_CAST(detail AS DOUBLE)/1000 AS seconds_raw, greatest(TRY_CAST(detail AS DOUBLE)-8e2,0e0) AS s0, NOT coalesce(item=cue_item,false) AS wrong
  FROM ev LEFT JOIN re USING (participant, trial) WHERE event='trial_end' AND coalesce(reachable,true)),
tr AS (SELECT *, CASE WHEN raw_ms IS NOT NULL THEN s0 END AS ms, CASE WHEN raw_ms IS NOT NULL THEN s0/1000 END AS seconds FROM te)"""


def _facts(spark, sf):
    log = cut_lineage(event_log(spark, sf))  # trial numbers are derived once, then read four times
    reach = T.reachability(log, KEYS, "participant")
    return T.keep_reachable(T.selections(log), reach, KEYS), T.keep_reachable(T.trial_ends(log), reach, KEYS)


@query("q_g1_trial_start", sql(f"""WITH {_REACH}
SELECT participant, trial, cue_zone_at_start, CASE WHEN first_on THEN cue_zone_at_start END AS cue_zone_strict FROM st""", "ev"))
def trial_start(spark, sf):
    log = event_log(spark, sf)
    strict = T.trial_starts(log, KEYS, strict=True).withColumnRenamed("cue_zone_at_start", "cue_zone_strict")
    return T.trial_starts(log, KEYS).join(strict, KEYS)


@query("q_g2_reachability", sql(f"""WITH {_REACH}
SELECT participant, count(*) AS trials, CAST(sum(CASE WHEN reachable THEN 0 ELSE 1 END) AS BIGINT) AS excluded, any_value(cue_recorded) AS cue_recorded FROM re GROUP BY 1""", "ev"))
def reachability(spark, sf):
    return T.exclusion_report(T.reachability(event_log(spark, sf), KEYS, "participant"), "participant")


@query("q_b19_duration", sql(f"""WITH {_REACH}
SELECT participant, trial, round(seconds_raw,6) AS seconds_raw, round(seconds,6) AS seconds, wrong FROM tr""", "ev"))
def duration(spark, sf):
    _, t = _facts(spark, sf)
    return rounded(t.select("participant", "trial", "seconds_raw", "seconds", "wrong"), "seconds_raw", "seconds")


@query("q_b19_duration_fallback", sql("""
SELECT participant, trial, round(frame_ms/1000,6) AS seconds_raw, round(greatest(frame_ms/1000-8e-1,0e0),6) AS seconds FROM ev WHERE event='trial_end'""", "ev"))
def duration_fallback(spark, sf):
    log = event_log(spark, sf).withColumn("detail", F.lit(None).cast("string"))
    return rounded(T.trial_ends(log).select("participant", "trial", "seconds_raw", "seconds"), "seconds_raw", "seconds")


@query("q_d27_cells", sql(f"""WITH {_REACH},
ep AS (SELECT pattern, guard, calib, participant, count(*) n, sum(CASE WHEN correct THEN 1 ELSE 0 END) c, avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) v FROM sel GROUP BY 1,2,3,4),
tp AS (SELECT pattern, guard, calib, participant, count(*) n, sum(CASE WHEN wrong THEN 1 ELSE 0 END) w, avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END) v FROM tr GROUP BY 1,2,3,4),
units AS (SELECT pattern, guard, calib, 'acc' AS of_, participant AS unit, v FROM ep UNION ALL SELECT pattern, guard, calib, 'wrong', participant, v FROM tp),
{bootstrap_sql('units', 'pattern, guard, calib, of_', REPS)},
ci AS (SELECT pattern, guard, calib, max(CASE WHEN of_='acc' THEN ci_lo END) AS acc_ci_lo, max(CASE WHEN of_='acc' THEN ci_hi END) AS acc_ci_hi,
  max(CASE WHEN of_='wrong' THEN ci_lo END) AS wrong_ci_lo, max(CASE WHEN of_='wrong' THEN ci_hi END) AS wrong_ci_hi FROM b_ci GROUP BY 1,2,3),
e AS (SELECT pattern, guard, calib, sum(n) AS sn, sum(c)/sum(n) AS acc FROM ep GROUP BY 1,2,3),
t AS (SELECT pattern, guard, calib, count(DISTINCT participant) AS participants, count(*) AS trials, avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END) AS wr, avg(ms)/1000 AS s, avg(raw_ms)/1000 AS sr FROM tr GROUP BY 1,2,3)
SELECT pattern, guard, calib, participants, trials, round(acc,6) AS per_selection_accuracy, round(acc_ci_lo,6) AS acc_ci_lo, round(acc_ci_hi,6) AS acc_ci_hi,
 round(wr,6) AS wrong_item_rate, round(wrong_ci_lo,6) AS wrong_ci_lo, round(wrong_ci_hi,6) AS wrong_ci_hi, round(s,6) AS seconds_per_trial, round(sr,6) AS seconds_incl_reading,
 round(CAST(sn AS DOUBLE)/trials,6) AS selections_per_trial FROM t LEFT JOIN e USING (pattern, guard, calib) LEFT JOIN ci USING (pattern, guard, calib)""", "ev"))
def cells(spark, sf):
    e, t = _facts(spark, sf)
    c = T.condition_cells(e, t, CELL, "participant", REPS)
    return rounded(c, *[n for n in c.columns if n not in (*CELL, "participants", "trials")])


@query("q_d28_site_zone", sql(f"""WITH {_REACH}
SELECT 'site' AS by_, calib, site AS value, count(*) AS n, round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END),6) AS acc FROM sel GROUP BY ALL
UNION ALL SELECT 'zone', calib, cue_zone, count(*), round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END),6) FROM sel WHERE cue_zone IS NOT NULL GROUP BY ALL""", "ev"))
def site_zone(spark, sf):
    e, _ = _facts(spark, sf)
    by = F.array(F.struct(F.lit("site").alias("by_"), F.col("site").alias("value")), F.struct(F.lit("zone").alias("by_"), F.col("cue_zone").alias("value")))
    long = e.select("calib", "correct", F.inline(by)).where(F.col("value").isNotNull())
    return long.groupBy("by_", "calib", "value").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("correct").cast("double")), "acc"))


@query("q_d29_block_range", sql(f"""WITH {_REACH},
bl AS (SELECT pattern, guard, block, avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END) AS w, avg(seconds) AS s FROM tr GROUP BY 1,2,3)
SELECT 'wrong' AS measure, pattern, coalesce(guard,'either') AS guard, round(min(w),6) AS low, round(max(w),6) AS high, count(*) AS blocks FROM bl GROUP BY GROUPING SETS ((pattern, guard),(pattern))
UNION ALL SELECT 'seconds', pattern, coalesce(guard,'either'), round(min(s),6), round(max(s),6), count(*) FROM bl GROUP BY GROUPING SETS ((pattern, guard),(pattern))""", "ev"))
def block_range(spark, sf):
    _, t = _facts(spark, sf)
    parts = [T.block_range(t, m).withColumn("measure", F.lit(m)) for m in ("wrong", "seconds")]
    return rounded(parts[0].unionByName(parts[1]), "low", "high")


@query("q_d30_counts", sql("""
SELECT pattern, calib, count(*) FILTER (WHERE event='page') AS page_changes, count(*) FILTER (WHERE event='trial_end') AS trials,
 count(*) FILTER (WHERE event IN ('select','reject')) AS selections, count(*) FILTER (WHERE event IN ('select','reject') AND cue_zone IS NULL) AS off_screen FROM ev GROUP BY 1,2""", "ev"))
def event_counts(spark, sf):
    sel = F.col("event").isin("select", "reject")
    return event_log(spark, sf).groupBy("pattern", "calib").agg(
        F.count_if(F.col("event") == "page").alias("page_changes"), F.count_if(F.col("event") == "trial_end").alias("trials"),
        F.count_if(sel).alias("selections"), F.count_if(sel & F.col("cue_zone").isNull()).alias("off_screen"),
    )


@query("q_d31_throughput", sql("""
WITH o AS (SELECT participant, trial, any_value(pattern) AS pattern, any_value(guard) AS guard, count(*) FILTER (WHERE event='select') AS selections,
  max(CASE WHEN event='trial_end' THEN frame_ms END)/1e3 AS seconds, bool_or(event='trial_end' AND NOT coalesce(item=cue_item,false)) AS wrong,
  bool_or(event='trial_end' AND detail='skipped') AS abandoned, any_value(cue_item)=4 AND any_value(pattern)='direct' AS unsayable, count(*) FILTER (WHERE event='trial_end') AS closed FROM ev GROUP BY 1,2),
a AS (SELECT pattern, guard, CASE WHEN pattern='scan' THEN 3 ELSE 2 END AS zones, count(*) AS messages, avg(CASE WHEN unsayable THEN 0e0 ELSE 1e0 END) AS coverage,
  avg(selections) FILTER (WHERE NOT unsayable) AS sm, avg(seconds) FILTER (WHERE NOT unsayable) AS tm, avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END) FILTER (WHERE NOT unsayable) AS wr,
  avg(CASE WHEN abandoned THEN 1e0 ELSE 0e0 END) FILTER (WHERE NOT unsayable) AS ar FROM o WHERE closed>0 GROUP BY 1,2,3),
q AS (SELECT *, (1-wr)*coverage AS ok, least(greatest(1-wr,1e-9),1-1e-9) AS p FROM a)
SELECT pattern, guard, zones, messages, round(coverage,6) AS coverage, round(sm,6) AS selections_mean, round(tm,6) AS seconds_mean, round(wr,6) AS wrong_rate, round(ar,6) AS abandoned_rate,
 round(tm/greatest(1e-9,ok),6) AS seconds_per_correct, round(tm/greatest(1e-9,1-wr),6) AS seconds_per_correct_if_sayable, round(60*ok/greatest(1e-9,tm),6) AS correct_per_minute,
 round(log2(zones)+p*log2(p)+(1-p)*log2((1-p)/(zones-1)),6) AS bits FROM q""", "ev"))
def throughput(spark, sf):
    end = F.col("event") == "trial_end"
    o = event_log(spark, sf).groupBy(*KEYS).agg(
        F.first("pattern").alias("pattern"), F.first("guard").alias("guard"), F.count_if(F.col("event") == "select").alias("selections"),
        (F.max(F.when(end, F.col("frame_ms"))) / 1000).alias("seconds"), F.bool_or(end & ~same_item(F.col("item"), F.col("cue_item"))).alias("wrong"),
        F.bool_or(end & (F.col("detail") == "skipped")).alias("abandoned"), ((F.first("cue_item") == 4) & (F.first("pattern") == "direct")).alias("unsayable"), F.count_if(end).alias("closed"),
    ).where("closed > 0").withColumn("zones", F.when(F.col("pattern") == "scan", 3).otherwise(2))
    t = T.throughput(o, ["pattern", "guard"], "zones")
    return rounded(t, *[c for c in t.columns if c not in ("pattern", "guard", "zones", "messages")])


@query("q_d32_threshold", sql("""
WITH s AS (SELECT site, pattern, CAST(floor(frame_ms/50) AS BIGINT) AS swept, avg(CASE WHEN cue_item=item THEN 1e0 ELSE 0e0 END) AS rate FROM ev GROUP BY 1,2,3)
SELECT site, pattern, min(CASE WHEN rate<=0.05e0 THEN swept END) AS threshold FROM s GROUP BY 1,2""", "ev"))
def threshold(spark, sf):
    s = event_log(spark, sf).groupBy("site", "pattern", F.floor(F.col("frame_ms") / 50).alias("swept")).agg(
        F.avg(same_item(F.col("item"), F.col("cue_item")).cast("double")).alias("rate"))
    return T.design_threshold(s, ["site", "pattern"], "swept", "rate")


PHASES = ["dwell", "select", "reject", "page", "trial_end"]


@query("q_d35_phase", sql("""
SELECT event AS phase, CAST(list_position(['dwell','select','reject','page','trial_end'], event) AS BIGINT) AS phase_no, count(*) AS n, round(avg(frame_ms),6) AS frame_ms, round(avg(zone),6) AS zone FROM ev GROUP BY 1,2""", "ev"))
def phase(spark, sf):
    d = event_log(spark, sf).withColumnRenamed("event", "phase").withColumn("zone", F.col("zone").cast("double"))
    return rounded(T.phase_means(d, "phase", PHASES, ["frame_ms", "zone"]), "frame_ms", "zone")


@query("q_g13_frame_ms", sql("""
SELECT participant, round(quantile_cont(frame_ms,0.5),6) AS median_ms FROM ev WHERE frame_ms<500 GROUP BY 1""", "ev"))
def frame_ms(spark, sf):
    return rounded(T.frame_time(event_log(spark, sf), ["participant"]), "median_ms")


_E1 = f"""{_REACH},
cp AS (SELECT calib, participant, count(*) AS m, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS c, avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) AS v FROM sel GROUP BY 1,2),
units AS (SELECT calib, participant AS unit, v FROM cp),
{bootstrap_sql('units', 'calib', REPS)},
po AS (SELECT calib, CAST(sum(m) AS BIGINT) AS n, sum(c)/sum(m) AS estimate, count(*) AS clusters FROM cp GROUP BY 1)"""


@query("q_e1_cluster_ci", sql(f"""WITH {_E1}
SELECT po.calib, po.n, clusters, round(estimate,6) AS estimate, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM po LEFT JOIN b_ci USING (calib)""", "ev"))
def cluster_ci(spark, sf):
    e, _ = _facts(spark, sf)
    return rounded(T.clustered_accuracy(e, ["calib"], "participant", "correct", REPS), "estimate", "ci_lo", "ci_hi")


@query("q_e9_stratified", sql(f"""WITH {_REACH},
units AS (SELECT calib, site, participant AS unit, avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) AS v FROM sel GROUP BY 1,2,3),
{bootstrap_sql('units', 'calib, site', REPS, 7)},
sx AS (SELECT calib, rep, sum(b_est.n*m)/sum(b_est.n) AS m FROM b_mean JOIN b_est USING (calib, site) GROUP BY 1,2),
ci AS (SELECT calib, quantile_cont(m,0.025) AS ci_lo, quantile_cont(m,0.975) AS ci_hi FROM sx GROUP BY 1)
SELECT calib, e.n, round(e.est,6) AS estimate, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM (SELECT calib, count(*) AS n, avg(v) AS est FROM units GROUP BY 1) e LEFT JOIN ci USING (calib)""", "ev"))
def stratified(spark, sf):
    e, _ = _facts(spark, sf)
    per = e.groupBy("calib", "site", "participant").agg(F.avg(F.col("correct").cast("double")).alias("v"))
    return rounded(stratified_ci(per, ["calib"], "site", "participant", "v", REPS, 7), "estimate", "ci_lo", "ci_hi")


@query("q_e7_verdict", sql(f"""WITH {_E1}
SELECT CASE calib WHEN 'free' THEN 'H1a' ELSE 'H1b' END AS hypothesis, round(estimate,6) AS estimate, round(ci_lo,6) AS ci_lo, ci_lo>=0.75e0 AS supported, ci_lo>=0.15e0 AS above_low_bar FROM po LEFT JOIN b_ci USING (calib)""", "ev"))
def verdicts(spark, sf):
    e, _ = _facts(spark, sf)
    c = T.clustered_accuracy(e, ["calib"], "participant", "correct", REPS)
    return c.select(
        F.when(F.col("calib") == "free", "H1a").otherwise("H1b").alias("hypothesis"), r6(F.col("estimate"), "estimate"), r6(F.col("ci_lo"), "ci_lo"),
        hypothesis_verdict(F.col("ci_lo")).alias("supported"), hypothesis_verdict(F.col("ci_lo"), 0.15).alias("above_low_bar"),
    )


# The pre-registered contrasts a - b.
CONTRASTS = [("direct/double", "direct/none"), ("scan/double", "scan/none"), ("scan/double", "direct/double"), ("scan/none", "direct/none")]


def _pair_sql(side, source, flag, where, pairs):
    vals = ",".join(f"('{a}','{b}')" for a, b in pairs)
    return f"""{_REACH},
rt AS (SELECT {side} AS side, participant, avg(CASE WHEN {flag} THEN 1e0 ELSE 0e0 END) AS v FROM {source} WHERE {where} GROUP BY 1,2),
units AS (SELECT p.a, p.b, x.participant AS unit, x.v-y.v AS v FROM (VALUES {vals}) p(a,b) JOIN rt x ON x.side=p.a JOIN rt y ON y.side=p.b AND y.participant=x.participant),
{bootstrap_sql('units', 'a, b', REPS)}
SELECT a, b, n, round(est,6) AS estimate, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM b_est LEFT JOIN b_ci USING (a, b)"""


def _pairs(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


@query("q_e5_by_cluster", sql("WITH " + _pair_sql("pattern||'/'||guard", "tr", "wrong", "calib='free'", CONTRASTS), "ev"))
def by_cluster(spark, sf):
    _, t = _facts(spark, sf)
    side = F.concat_ws("/", "pattern", "guard")
    return rounded(T.paired_rates(t.where("calib = 'free'"), side, _pairs(spark, CONTRASTS), "participant", "wrong", REPS), "estimate", "ci_lo", "ci_hi")


@query("q_e5_calibration", sql("WITH " + _pair_sql("calib", "sel", "correct", "true", [("calibrated", "free")]), "ev"))
def calibration_effect(spark, sf):
    e, _ = _facts(spark, sf)
    return rounded(T.paired_rates(e, F.col("calib"), _pairs(spark, [("calibrated", "free")]), "participant", "correct", REPS), "estimate", "ci_lo", "ci_hi")


@query("q_e6_matched", sql("WITH " + _pair_sql("pattern||'/'||guard", "sel", "correct", "cue_zone IN (0,1)", CONTRASTS[2:]), "ev"))
def matched(spark, sf):
    e, _ = _facts(spark, sf)
    side = F.concat_ws("/", "pattern", "guard")
    return rounded(T.paired_rates(e.where(F.col("cue_zone").isin(0, 1)), side, _pairs(spark, CONTRASTS[2:]), "participant", "correct", REPS), "estimate", "ci_lo", "ci_hi")


@query("q_e8_observed_predicted", sql(f"""WITH {_REACH},
o AS (SELECT pattern, guard, calib, avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END) AS observed FROM tr GROUP BY 1,2,3),
p AS (SELECT pattern, guard, avg(CASE WHEN correct THEN 0e0 ELSE 1e0 END) AS predicted FROM sel GROUP BY 1,2)
SELECT pattern, guard, calib, round(observed,6) AS observed, round(predicted,6) AS predicted, round(observed-predicted,6) AS difference, abs(observed-predicted)<=0.1e0 AS within_band FROM o JOIN p USING (pattern, guard)""", "ev"))
def observed_predicted(spark, sf):
    e, t = _facts(spark, sf)
    o = t.groupBy(*CELL).agg(F.avg(F.col("wrong").cast("double")).alias("observed"))
    p = e.groupBy("pattern", "guard").agg(F.avg((~F.col("correct")).cast("double")).alias("predicted"))
    return rounded(T.observed_vs_predicted(o, p, ["pattern", "guard"]), "observed", "predicted", "difference")


@query("q_m1_claims", sql(f"""WITH {_REACH},
g AS (SELECT pattern||'.'||guard||'.'||calib AS cell, count(*) AS n, round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END),3) AS acc FROM sel GROUP BY 1),
got AS (SELECT cell||'.n' AS claim_id, CAST(n AS DOUBLE) AS got FROM g UNION ALL SELECT cell||'.acc', acc FROM g),
al AS (SELECT pattern, count(*) AS n, avg(CASE WHEN item=cue_item THEN 1e0 ELSE 0e0 END) AS acc FROM ev WHERE event IN ('select','reject') GROUP BY 1),
claims AS (SELECT pattern||'.'||gg||'.free.acc' AS claim_id, round(acc,3) AS expected, 0.02e0 AS tol FROM al, (VALUES ('none'),('double'),('confirm')) v(gg)
  UNION ALL SELECT pattern||'.none.free.n', CAST(n AS DOUBLE), 0e0 FROM al)
SELECT claim_id, expected, tol, got, CASE WHEN expected IS NULL THEN 'unclaimed' WHEN got IS NULL THEN 'missing' WHEN abs(got-expected)<=tol+1e-12 THEN 'ok' ELSE 'fail' END AS verdict FROM claims FULL OUTER JOIN got USING (claim_id)""", "ev"))
def claims(spark, sf):
    e, _ = _facts(spark, sf)
    got = as_claims(e.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 3).alias("acc")), CELL, ["n", "acc"])
    every = T.selections(event_log(spark, sf)).groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 3).alias("acc"))
    stated = [F.struct(F.concat_ws(".", "pattern", F.lit(g), F.lit("free.acc")).alias("claim_id"), F.col("acc").alias("expected"), F.lit(0.02).alias("tol")) for g in ("none", "double", "confirm")]
    stated.append(F.struct(F.concat_ws(".", "pattern", F.lit("none.free.n")).alias("claim_id"), F.col("n").alias("expected"), F.lit(0.0).alias("tol")))
    return check(every.select(F.inline(F.array(*stated))), got)


@query("q_m2_rollup", sql(f"""WITH {_REACH},
t AS (SELECT CAST(site AS VARCHAR) AS who, coalesce(item=cue_item,false) AS ok, coalesce(detail='skipped',false) AS sk, cue_zone_at_start IS NOT NULL AS on_ FROM ev LEFT JOIN st USING (participant, trial) WHERE event='trial_end'),
tt AS (SELECT * FROM t UNION ALL SELECT 'pooled', ok, sk, on_ FROM t),
a AS (SELECT who, count(*) AS attempted, count(*) FILTER (WHERE sk) AS skipped, count(*) FILTER (WHERE NOT sk AND NOT on_) AS excluded, count(*) FILTER (WHERE NOT sk AND on_) AS analysed,
  count(*) FILTER (WHERE NOT sk AND on_ AND ok) AS trial_hits, count(*) FILTER (WHERE NOT sk AND ok) AS unexcluded_hits FROM tt GROUP BY 1),
s0 AS (SELECT CAST(e.site AS VARCHAR) AS who, coalesce(e.item=e.cue_item,false) AS correct FROM ev e JOIN (SELECT participant, trial FROM ev WHERE event='trial_end') c USING (participant, trial) JOIN st USING (participant, trial) WHERE e.event IN ('select','reject') AND cue_zone_at_start IS NOT NULL),
s1 AS (SELECT * FROM s0 UNION ALL SELECT 'pooled', correct FROM s0),
s AS (SELECT who, count(*) AS selections, count(*) FILTER (WHERE correct) AS selection_hits FROM s1 GROUP BY 1),
f0 AS (SELECT CAST(site AS VARCHAR) AS who, frame_ms FROM ev WHERE frame_ms<500),
f AS (SELECT who, round(quantile_cont(frame_ms,0.5),6) AS median_ms FROM (SELECT * FROM f0 UNION ALL SELECT 'pooled', frame_ms FROM f0) GROUP BY 1)
SELECT * FROM a LEFT JOIN s USING (who) LEFT JOIN f USING (who)""", "ev"))
def rollup(spark, sf):
    return rounded(T.operator_table(event_log(spark, sf), KEYS, "site"), "median_ms")


@query("q_m2_by_side", sql(f"""WITH {_REACH}
SELECT cue_zone_at_start AS side, count(*) FILTER (WHERE coalesce(item=cue_item,false)) AS hits, count(*) AS trials FROM ev JOIN st USING (participant, trial)
WHERE event='trial_end' AND NOT coalesce(detail='skipped',false) AND cue_zone_at_start IS NOT NULL GROUP BY 1""", "ev"))
def by_side(spark, sf):
    log = event_log(spark, sf)
    ends = log.where("event = 'trial_end' AND NOT coalesce(detail = 'skipped', false)").join(T.trial_starts(log, KEYS), KEYS)
    return ends.where(F.col("cue_zone_at_start").isNotNull()).groupBy(F.col("cue_zone_at_start").alias("side")).agg(
        F.count_if(same_item(F.col("item"), F.col("cue_item"))).alias("hits"), F.count(F.lit(1)).alias("trials"))


@query("q_a12_last_wins", """
SELECT conv_id, role, turn, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn=1""")
def last_wins(spark, sf):
    from evalgrid.sources.jsonl import last_record

    c = table(spark, sf, "conversations").withColumn("digest", F.md5("text"))
    return last_record(c.select("conv_id", "role", "turn", "digest"), ["conv_id", "role"], "turn")


@query("q_c8_lookup", """
SELECT n_name AS nation, r_name AS region, count(*) AS customers, round(avg(c_acctbal),6) AS acctbal FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2""")
def lookup(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    per = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count(F.lit(1)).alias("customers"))
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    j = attach(per, names, ["c_nationkey"], ["c_nationkey"], how="inner")
    return j.select("nation", "region", "customers", r6(F.col("s") / F.col("customers"), "acctbal"))
