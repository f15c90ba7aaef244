"""Sources and sinks through files: a given table is written in a source's format and scanned back.

The files go to a new folder in the shared one (see `session.new_folder`), so every executor sees them.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid.plans.registry import query
from evalgrid.plans.roles import table
from evalgrid.session import new_folder
from evalgrid.sources import features, jsonl, logs, sinks


def _events(spark, sf):
    """Events in parts: several files, so that a scan meets more than one."""
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").repartition(4, "event_id")


# ---- A1: two header generations in one folder; the older one has no guard and no cue_zone


@query("q_a1_event_logs", """
WITH l AS (SELECT event_id%2=0 AS cue_recorded, event_id AS t_ms, event_type AS event, CAST(user_id%3 AS INTEGER) AS zone, CASE WHEN event_id%2=0 THEN 'double' ELSE 'none' END AS condition_guard,
  CASE WHEN event_id%2=0 AND user_id%5>0 THEN CAST(user_id%4 AS DOUBLE) END AS cue_zone, value AS frame_ms FROM events)
SELECT cue_recorded, event, condition_guard, zone, count(*) AS n, CAST(sum(t_ms) AS BIGINT) AS t_sum, count(cue_zone) AS cues, CAST(coalesce(sum(cue_zone),0) AS DOUBLE) AS cue_sum, round(avg(frame_ms),6) AS frame_ms FROM l GROUP BY ALL""")
def event_logs(spark, sf):
    e, folder = _events(spark, sf), new_folder(spark)
    old = [F.col("event_id").alias("t_ms"), F.col("event_type").alias("event"), (F.col("user_id") % 3).alias("zone"), F.col("value").alias("frame_ms")]
    new = [F.col("value").alias("frame_ms"), F.lit("double").alias("condition_guard"), F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 4).alias("cue_zone"), *old[:3]]
    for rows, columns in ((e.where("event_id % 2 = 1"), old), (e.where("event_id % 2 = 0"), new)):
        rows.select(*columns).write.mode("append").option("header", True).csv(folder)
    d = logs.read_event_logs(spark, folder, glob="*.csv")
    return d.groupBy("cue_recorded", "event", "condition_guard", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t_ms").alias("t_sum"), F.count("cue_zone").alias("cues"), F.coalesce(F.sum("cue_zone"), F.lit(0.0)).alias("cue_sum"), F.round(F.avg("frame_ms"), 6).alias("frame_ms"))


# ---- A4: every tenth line is only half written, some are blank


@query("q_a4_tolerant_jsonl", """
SELECT event_id, CASE WHEN event_id%10>0 THEN user_id END AS user_id, CASE WHEN event_id%10>0 THEN value END AS value, event_id%10=0 AS dropped FROM events""")
def tolerant_jsonl(spark, sf):
    folder = new_folder(spark)
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    cut = F.when(F.col("event_id") % 10 == 0, F.regexp_extract(line, '^.*"event_type":', 0)).otherwise(line)
    blank = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("  "), cut)).otherwise(F.array(cut))
    _events(spark, sf).select(F.explode(blank).alias("value")).write.text(folder)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    good, bad = jsonl.read_jsonl(spark, folder, schema)
    lost = bad.select(F.regexp_extract("line", '"event_id":([0-9]+)', 1).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("dropped"))
    return good.select("event_id", "user_id", "value", F.lit(False).alias("dropped")).union(lost)


# ---- A5: nested sensor rows, two of them in some milliseconds


@query("q_a5_sensor_samples", """
WITH s AS (SELECT user_id%20 AS who, event_id/3e3 AS tt, CAST(round(event_id/3e0) AS BIGINT) AS t_ms, CASE WHEN event_id%5>0 AND event_id%7>0 THEN value/500 END AS l, CASE WHEN event_id%3>0 THEN value/400 END AS r FROM events),
m AS (SELECT who, t_ms, tt, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE (l+r)/2 END AS x FROM s),
f AS (SELECT who, t_ms, arg_min(coalesce(x,-1), tt) AS x FROM m GROUP BY 1,2)
SELECT who, t_ms, round(nullif(x,-1),9) AS tx, round(nullif(x,-1)/2,9) AS ty, CASE WHEN x=-1 THEN 0 ELSE 1 END AS tvalid FROM f""")
def sensor_samples(spark, sf):
    folder, i = new_folder(spark), F.col("event_id")

    def point(by: int):
        x = F.col("value") / by
        return F.array(x, x / 2)

    e = _events(spark, sf).select(
        (F.col("user_id") % 20).alias("who"), (i / 3000).alias("true_time"), F.when(i % 7 > 0, point(500)).alias("left_gaze_point_on_display_area"), point(400).alias("right_gaze_point_on_display_area"),
        (i % 5 > 0).cast("int").alias("left_pupil_validity"), (i % 3 > 0).cast("int").alias("right_pupil_validity"))
    e.write.json(folder)
    raw = spark.read.schema(T.StructType([T.StructField("who", T.LongType()), *jsonl.SENSOR_SCHEMA.fields])).json(folder)
    s = jsonl.sensor_samples(raw, ["who"])
    return s.select("who", "t_ms", F.round("tx", 9).alias("tx"), F.round("ty", 9).alias("ty"), "tvalid")


# ---- A7: rows of values between runs of blanks


@query("q_a7_text_rows", """SELECT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS line, l_quantity AS qty, l_extendedprice AS price, l_returnflag AS flag FROM lineitem""")
def text_rows(spark, sf):
    folder, d = new_folder(spark), table(spark, sf, "lineitem")
    values = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
    gap = F.when(F.col("l_linenumber") % 2 == 0, "   ").otherwise(" \t")
    d.select(F.concat(F.lit(" "), F.array_join(F.array(*[F.col(c).cast("string") for c in values]), "|")).alias("v"), gap.alias("g")).select(F.replace("v", F.lit("|"), F.col("g")).alias("value")).write.text(folder)
    return features.read_columns(spark, folder, "k bigint, line int, qty double, price double, flag string").drop("path")


# ---- A8: a dimension file with headings, notes and rows that do not parse


@query("q_a8_characteristics", """
SELECT 'P_' || c_custkey AS participant, CASE WHEN c_custkey%2=0 THEN 'Laptop' ELSE 'PC' END AS setup, CAST(1000+c_nationkey AS INTEGER) AS screen_w_px, 800 AS screen_h_px FROM customer WHERE c_custkey%9>0""")
def characteristics(spark, sf):
    folder, c = new_folder(spark), table(spark, sf, "customer")
    wide = F.when(F.col("c_custkey") % 9 == 0, F.lit("n/a")).otherwise((1000 + F.col("c_nationkey")).cast("string"))
    row = F.concat_ws(",", F.concat(F.lit("P_"), F.col("c_custkey")), F.lit("f"), F.lit("30"), F.when(F.col("c_custkey") % 2 == 0, " Laptop ").otherwise("PC"), wide, F.lit(" 800 "))
    junk = F.when(F.col("c_custkey") % 50 == 0, F.array(F.lit("Participant,Sex,Age,Setup,Width,Height"), row, F.lit("# note, with, commas"))).otherwise(F.array(row))
    c.select(F.explode(junk).alias("value")).write.text(folder)
    return logs.read_characteristics(spark, folder)


# ---- A9: annotation records to sets of categories, through a second source's numbering


@query("q_a9_positive_sets", """
WITH a AS (SELECT DISTINCT l_orderkey AS image_id, l_partkey%12 AS c FROM lineitem)
SELECT image_id, count(*) AS n, string_agg(CAST(100+c AS VARCHAR), ',' ORDER BY c) AS pos FROM a WHERE c<8 GROUP BY 1""")
def positive_sets(spark, sf):
    folder = new_folder(spark)
    table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 12).alias("category_id"), F.lit(0.5).alias("area")).write.json(folder)
    mapping = spark.range(8).select(F.col("id").alias("category_id"), (100 + F.col("id")).alias("target_id"))
    p = jsonl.positive_sets(spark.read.schema("image_id bigint, category_id bigint, area double").json(folder), mapping)
    return p.select("image_id", F.size("pos").cast("bigint").alias("n"), F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"))


# ---- A11: a run that stopped half way is finished by a second one, then some subjects are replaced


@query("q_a11_resumed", """
SELECT o_orderkey AS k, CAST(o_orderkey%10 AS INTEGER) AS subject, CASE WHEN o_orderkey%10=3 THEN -o_totalprice ELSE o_totalprice*2 END AS v FROM orders""")
def resumed(spark, sf):
    out, by_subject = new_folder(spark), new_folder(spark)
    work = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 10).cast("int").alias("subject"), F.col("o_totalprice").alias("p"))

    def compute(rows):
        return rows.select("k", "subject", (F.col("p") * 2).alias("v"))

    sinks.append_pending(work.where("k % 3 = 0"), out, ["k"], compute)
    sinks.append_pending(work, out, ["k"], compute)
    sinks.append_pending(work, out, ["k"], compute)  # nothing is left to do
    sinks.replace_subjects(spark.read.parquet(out), by_subject, "subject")
    sinks.replace_subjects(work.where("subject = 3").select("k", "subject", (-F.col("p")).alias("v")), by_subject, "subject")
    return spark.read.parquet(by_subject).select("k", F.col("subject").cast("int").alias("subject"), "v")


# ---- A13: one table in every format


@query("q_a13_formats", """SELECT f AS fmt, s_suppkey, s_name, s_acctbal FROM supplier, (SELECT unnest(['parquet','csv','json']) AS f)""")
def formats(spark, sf):
    s, out = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), None
    for fmt in ("parquet", "csv", "json"):
        path = new_folder(spark)
        sinks.write_table(s, path, fmt)
        r = spark.read.schema(s.schema).option("header", True).format(fmt).load(path).select(F.lit(fmt).alias("fmt"), *s.columns)
        out = r if out is None else out.union(r)
    return out
