"""Audit queries: ratings, human precision, agreement, blinded sheet and key, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.operators import audit as A
from evalgrid.operators.ranking import common_units, first_mentions
from evalgrid.operators.sampling import pending, sample_units
from evalgrid.operators.skew import attach, top_per_key
from evalgrid.plans.classification import rounded
from evalgrid.plans.ranking import _RANKED
from evalgrid.plans.registry import query
from evalgrid.plans.roles import event_log, frame_stream, ranked_lists, reference_stream, sql, table
from evalgrid.session import cut_lineage
from evalgrid.plans.text import JACCARD_SQL, jaccard_ranking

RATED = """
lb AS (SELECT l.doc_id AS item_uid, d.source AS scene, d.lang AS method, d.n_chars, l.quality, l.toxic,
  CASE WHEN n_chars%11=0 THEN '  ' WHEN quality=1 THEN ' y ' ELSE 'n' END AS d_raw, CASE WHEN n_chars%13=0 THEN '' WHEN toxic=0 THEN 'Y ' ELSE 'n ' END AS e_raw FROM labels l JOIN documents d USING (doc_id)),
rt AS (SELECT *, nullif(upper(trim(d_raw)),'') AS D, CASE WHEN quality=1 OR n_chars%5=0 THEN nullif(upper(trim(e_raw)),'') END AS E FROM lb),
r2 AS (SELECT *, CASE WHEN n_chars%7=0 THEN CASE D WHEN 'Y' THEN 'N' WHEN 'N' THEN 'Y' END ELSE D END AS D2, CASE WHEN n_chars%3=0 THEN 'N' ELSE E END AS E2 FROM rt)"""


def ratings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    r = d.join(table(spark, sf, "labels"), "doc_id")
    n = F.col("n_chars")
    d_raw = F.when(n % 11 == 0, "  ").when(F.col("quality") == 1, " y ").otherwise("n")
    e_raw = F.when(n % 13 == 0, "").when(F.col("toxic") == 0, "Y ").otherwise("n ")
    r = r.select(
        F.col("doc_id").alias("item_uid"), F.col("source").alias("scene"), F.col("lang").alias("method"), "n_chars",
        A.clean_rating(d_raw).alias("D"), F.when((F.col("quality") == 1) | (n % 5 == 0), A.clean_rating(e_raw)).alias("E"),
    )
    flip = F.when(F.col("D") == "Y", "N").when(F.col("D") == "N", "Y")
    return r.withColumn("D2", F.when(n % 7 == 0, flip).otherwise(F.col("D"))).withColumn("E2", F.when(n % 3 == 0, "N").otherwise(F.col("E")))


@query("q_a10_ratings", f"WITH {RATED} SELECT item_uid, scene, D, E FROM rt")
def rating_scan(spark, sf):
    return ratings(spark, sf).select("item_uid", "scene", "D", "E")


_RATERS = """a AS (SELECT item_uid, D, E FROM rt WHERE item_uid%5<>1),
b AS (SELECT item_uid, D2 AS D, E2 AS E FROM r2 WHERE item_uid%7<>2), c AS (SELECT item_uid, D, CASE WHEN item_uid%4=0 THEN 'N' ELSE E END AS E FROM rt WHERE item_uid%3<>0),
pr AS (SELECT '1 vs 2' AS pair, a.D AS d1, b.D AS d2, a.E AS e1, b.E AS e2 FROM a JOIN b USING (item_uid) UNION ALL SELECT '1 vs 3', a.D, c.D, a.E, c.E FROM a JOIN c USING (item_uid)),
lg AS (SELECT pair, 'D' AS "column", d1 AS x, d2 AS y FROM pr UNION ALL SELECT pair, 'E', e1, e2 FROM pr),
ok AS (SELECT * FROM lg WHERE x IS NOT NULL AND y IS NOT NULL),
po AS (SELECT pair, "column", count(*) AS n, count(*) FILTER (WHERE x=y)/count(*) AS po FROM ok GROUP BY 1,2),
mx AS (SELECT pair, "column", x AS label, count(*) AS k FROM ok GROUP BY 1,2,3), my AS (SELECT pair, "column", y AS label, count(*) AS k FROM ok GROUP BY 1,2,3),
pe AS (SELECT pair, "column", sum(CAST(mx.k AS DOUBLE)*my.k) AS s FROM mx JOIN my USING (pair, "column", label) GROUP BY 1,2)"""


@query("q_c13_raters", f"""WITH {RATED}, {_RATERS}
SELECT pair, "column", n, round(po,6) AS raw_agreement, round(CASE WHEN coalesce(s,0)/(CAST(n AS DOUBLE)*n)<1 THEN (po-coalesce(s,0)/(CAST(n AS DOUBLE)*n))/(1-coalesce(s,0)/(CAST(n AS DOUBLE)*n)) END,6) AS kappa FROM po LEFT JOIN pe USING (pair, "column")""")
def raters(spark, sf):
    r, i = ratings(spark, sf), F.col("item_uid")
    first = r.where(i % 5 != 1).select("item_uid", "D", "E")
    second = r.where(i % 7 != 2).select("item_uid", F.col("D2").alias("D"), F.col("E2").alias("E"))
    third = r.where(i % 3 != 0).select("item_uid", "D", F.when(i % 4 == 0, "N").otherwise(F.col("E")).alias("E"))
    return rounded(A.rater_agreement([first, second, third], "item_uid", ["D", "E"]), "raw_agreement", "kappa")


def _key(spark, sf):
    k = ratings(spark, sf).select("item_uid", "method", "scene")
    return top_per_key(k, ["method", "scene"], [F.col("item_uid")], 6)


_KEYED = """ky AS (SELECT * FROM (SELECT item_uid, method, scene, row_number() OVER (PARTITION BY method, scene ORDER BY item_uid) AS rank FROM rt) WHERE rank<=6),
hk AS (SELECT ky.*, coalesce(D='Y',false) AS p, coalesce(D='Y' AND E='Y',false) AS u FROM ky LEFT JOIN rt USING (item_uid)),
hm AS (SELECT hk.method, hk.scene, k, count(*) FILTER (WHERE p)/k AS hp, count(*) FILTER (WHERE u)/k AS us, CASE WHEN bool_or(p) THEN 1e0 ELSE 0e0 END AS hh, CASE WHEN bool_or(u) THEN 1e0 ELSE 0e0 END AS uh FROM hk, (VALUES (3),(6)) v(k) WHERE rank<=k GROUP BY 1,2,3)"""
# method and scene of a key row are its own columns, the ratings carry the same ones
_KEYED = _KEYED.replace("ky LEFT JOIN rt USING (item_uid)", "ky LEFT JOIN (SELECT item_uid, D, E FROM rt) USING (item_uid)")


@query("q_d20_human_at_k", f"""WITH {RATED}, {_KEYED}
SELECT method, k, count(*) AS scenes, round(avg(hp),6) AS human_precision, round(avg(us),6) AS useful, round(avg(hh),6) AS human_hit, round(avg(uh),6) AS useful_hit FROM hm GROUP BY 1,2""")
def human_at_k(spark, sf):
    m = A.human_metrics(A.rated_items(_key(spark, sf), ratings(spark, sf)), "scene")
    names = ["human_precision", "useful", "human_hit", "useful_hit"]
    return rounded(m.groupBy("method", "k").agg(F.count(F.lit(1)).alias("scenes"), *[F.avg(c).alias(c) for c in names]), *names)


@query("q_d23_kappa", f"""WITH {RATED},
pr_ AS (SELECT 'D' AS col_, D AS x, D2 AS y FROM r2 WHERE D IS NOT NULL AND D2 IS NOT NULL UNION ALL SELECT 'E', E, E2 FROM r2 WHERE E IS NOT NULL AND E2 IS NOT NULL),
s AS (SELECT col_, count(*) AS n, avg(CASE WHEN x=y THEN 1e0 ELSE 0e0 END) AS po, (count(*) FILTER (WHERE x='Y')*(count(*) FILTER (WHERE y='Y')) + count(*) FILTER (WHERE x='N')*(count(*) FILTER (WHERE y='N')))/(CAST(count(*) AS DOUBLE)*count(*)) AS pe FROM pr_ GROUP BY 1)
SELECT col_ AS rating, n, round(po,6) AS raw_agreement, round(CASE WHEN pe<1 THEN (po-pe)/(1-pe) END,6) AS kappa FROM s""")
def kappa(spark, sf):
    both = F.array(*[F.struct(F.lit(c).alias("rating"), F.col(c).alias("x"), F.col(f"{c}2").alias("y")) for c in ("D", "E")])
    return rounded(A.cohens_kappa(ratings(spark, sf).select(F.inline(both)), ["rating"], "x", "y"), "raw_agreement", "kappa")


@query("q_d24_changes", f"""WITH {RATED},
g AS (SELECT coalesce(method,'ALL') AS method, count(*) AS items, count(*) FILTER (WHERE D IS DISTINCT FROM D2) AS in_photo_changed, count(*) FILTER (WHERE D='Y' AND D2='Y') AS useful_compared,
 count(*) FILTER (WHERE D='Y' AND D2='Y' AND E IS DISTINCT FROM E2) AS useful_changed FROM r2 GROUP BY ROLLUP (method))
SELECT *, round(100*in_photo_changed/greatest(items,1),6) AS in_photo_changed_pct FROM g""")
def changes(spark, sf):
    r = ratings(spark, sf).select("method", F.col("D").alias("D_p"), F.col("E").alias("E_p"), F.col("D2").alias("D_o"), F.col("E2").alias("E_o"))
    return rounded(A.review_changes(r), "in_photo_changed_pct")


@query("q_d25_vs_labels", f"""WITH {RATED},
au AS (SELECT source AS scene, lang AS method, lower('Item '||doc_id%40) AS k, arg_min(CASE n_chars%3 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' ELSE 'unverifiable' END, doc_id) AS status FROM documents GROUP BY 1,2,3),
j AS (SELECT rt.method, status, coalesce(D='Y',false) AS p, coalesce(D='Y' AND E='Y',false) AS u FROM rt LEFT JOIN au ON au.scene=rt.scene AND au.method=rt.method AND au.k=lower('Item '||rt.item_uid%40))
SELECT method, count(*) AS items, count(*) FILTER (WHERE status IN ('correct','wrong')) AS label_verdict, round(avg(CASE WHEN p=(status='correct') THEN 1e0 ELSE 0e0 END) FILTER (WHERE status IN ('correct','wrong')),6) AS agreement,
 count(*) FILTER (WHERE status='correct' AND NOT p) AS label_correct_human_n, count(*) FILTER (WHERE status='wrong' AND p) AS label_wrong_human_y, count(*) FILTER (WHERE status='unverifiable') AS unverifiable_items,
 round(avg(CASE WHEN p THEN 1e0 ELSE 0e0 END) FILTER (WHERE status='unverifiable'),6) AS unverifiable_in_photo, round(avg(CASE WHEN u THEN 1e0 ELSE 0e0 END) FILTER (WHERE status='unverifiable'),6) AS unverifiable_useful FROM j GROUP BY 1""")
def vs_labels(spark, sf):
    d = table(spark, sf, "documents")
    key = F.lower(F.concat(F.lit("Item "), (F.col("doc_id") % 40).cast("string")))
    status = F.when(F.col("n_chars") % 3 == 0, "correct").when(F.col("n_chars") % 3 == 1, "wrong").otherwise("unverifiable")
    auto = A.first_status(d.select(F.col("source").alias("scene"), F.col("lang").alias("method"), key.alias("k"), status.alias("status"), "doc_id"), ["scene", "method", "k"], "doc_id")
    r = ratings(spark, sf).withColumn("doc_id", F.col("item_uid")).withColumn("k", key)
    rated = A.rated_items(r.select("item_uid", "method", "scene", "k"), r)
    j = attach(rated, auto, ["scene", "method", "k"], ["item_uid"])
    return rounded(A.labels_vs_human(j), "agreement", "unverifiable_in_photo", "unverifiable_useful")


_AUDIT = f"""{_RANKED},
sm AS (SELECT unit FROM (SELECT DISTINCT unit FROM rk) ORDER BY md5('0:'||unit), unit LIMIT 50),
en AS (SELECT * FROM (SELECT rk.*, trim(regexp_replace(regexp_replace(lower(item),'[^\\p{{L}}\\p{{N}} ]','','g'),' +',' ','g')) AS item_norm FROM rk WHERE unit IN (SELECT unit FROM sm) AND rank<=6) WHERE item_norm<>''),
sh AS (SELECT 'U'||lpad(CAST(row_number() OVER (ORDER BY md5('0:'||unit||':'||item_norm), unit, item_norm)-1 AS VARCHAR),4,'0') AS item_uid, unit, item_norm FROM (SELECT DISTINCT unit, item_norm FROM en))"""


def _entries(spark, sf):
    lists = ranked_lists(spark, sf)  # not written: the first two passes read few columns, the last keeps the sample only
    units = cut_lineage(sample_units(common_units(lists), "unit", 50))
    ranked = first_mentions(lists.join(units, "unit", "left_semi"), ["unit", "method"], "place", "category", ["item"])
    return cut_lineage(A.audit_entries(ranked))  # read by sheet, codes and key


@query("q_k1_sheet", sql(f"WITH {_AUDIT} SELECT * FROM sh", "rl", "rv"))
def sheet(spark, sf):
    return A.audit_sheet(_entries(spark, sf), "unit")


@query("q_k2_key", sql(f"""WITH {_AUDIT},
cd AS (SELECT method, 'M'||row_number() OVER (ORDER BY md5('0:'||method), method) AS method_code FROM (SELECT DISTINCT method FROM en))
SELECT item_uid, unit, item, method_code, rank FROM en JOIN sh USING (unit, item_norm) JOIN cd USING (method)""", "rl", "rv"))
def key(spark, sf):
    e = _entries(spark, sf)
    k = A.audit_key(e, A.audit_sheet(e, "unit"), A.method_codes(e), "unit")
    return k.withColumn("rank", F.col("rank").cast("bigint"))


@query("q_c2_unblind", sql(f"""WITH {_AUDIT} SELECT method, item_uid, rank FROM en JOIN sh USING (unit, item_norm)""", "rl", "rv"))
def unblinded(spark, sf):
    e = _entries(spark, sf)
    codes = A.method_codes(e)
    u = A.unblind(A.audit_key(e, A.audit_sheet(e, "unit"), codes, "unit"), codes)
    return u.select("method", "item_uid", F.col("rank").cast("bigint").alias("rank"))


@query("q_k3_progress", f"""WITH {RATED},
u AS (SELECT scene, count(*) FILTER (WHERE D IS NULL) AS e FROM rt GROUP BY 1),
a AS (SELECT count(*) AS items, count(*) FILTER (WHERE D IN ('Y','N')) AS d_filled, count(*) FILTER (WHERE D='Y') AS d_yes, count(*) FILTER (WHERE D='Y' AND E IN ('Y','N')) AS e_filled,
 count(*) FILTER (WHERE D IS NULL) AS d_empty, count(*) FILTER (WHERE D='N' AND E IS NOT NULL) AS e_without_d FROM rt)
SELECT items, d_filled, d_yes, e_filled, d_filled-d_yes+e_filled AS rows_finished, round((d_filled-d_yes+e_filled)/items,6) AS share_complete, d_empty, d_yes-e_filled AS e_missing, e_without_d,
 (SELECT count(*) FROM u WHERE e=0) AS units_done FROM a""")
def progress(spark, sf):
    return rounded(A.rating_progress(ratings(spark, sf), "scene"), "share_complete")


@query("q_k4_generations", f"""WITH {JACCARD_SQL},
b AS (SELECT item_id AS item, text AS utterance FROM benchmark), t1 AS (SELECT case_id, item FROM jr WHERE rank=1),
c AS (SELECT conv_id*1000+turn AS case_id, conv_id%40 AS gold FROM conversations)
SELECT c.case_id, gold, md5(r.utterance) AS reference, t1.item, md5(m.utterance) AS mapped_to, t1.item=gold AS auto_correct FROM c JOIN t1 USING (case_id) LEFT JOIN b r ON r.item=gold LEFT JOIN b m ON m.item=t1.item""")
def generations(spark, sf):
    top1 = jaccard_ranking(spark, sf, 1)
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), (F.col("conv_id") % 40).alias("gold"), "text")
    bank = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("utterance"))
    g = A.generation_sheet(c, top1, bank)
    return g.select("case_id", "gold", F.md5("reference").alias("reference"), "item", F.md5("mapped_to").alias("mapped_to"), "auto_correct")


@query("q_i1_union", sql("""
SELECT kind, count(*) AS n, count(tx) AS tx, count(px) AS px, CAST(sum(tvalid) AS BIGINT) AS valid FROM
 (SELECT 'ref' AS kind, tx, NULL AS px, tvalid FROM rs UNION ALL SELECT 'frame', NULL, px, 1 FROM fr) GROUP BY 1""", "rs", "fr"))
def union(spark, sf):
    r = reference_stream(spark, sf).withColumn("kind", F.lit("ref"))
    f = frame_stream(spark, sf).withColumn("kind", F.lit("frame"))
    u = r.unionByName(f, allowMissingColumns=True).withColumn("tvalid", F.coalesce("tvalid", F.lit(1)))
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("tx").alias("tx"), F.count("px").alias("px"), F.sum("tvalid").alias("valid"))


@query("q_i3_difference", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("q_i4_distinct", r"SELECT DISTINCT p_brand AS brand, trim(regexp_replace(regexp_replace(lower(p_name),'[^\p{L}\p{N} ]','','g'),' +',' ','g')) AS item FROM part")
def distinct(spark, sf):
    from evalgrid.functions.text import norm_item

    return table(spark, sf, "part").select(F.col("p_brand").alias("brand"), norm_item(F.col("p_name")).alias("item")).dropDuplicates()


@query("q_c9_resume", sql("""
SELECT m.method, u.unit FROM (SELECT DISTINCT unit FROM rl) u CROSS JOIN (VALUES ('line'),('price'),('qty')) m(method)
WHERE NOT EXISTS (SELECT 1 FROM rl WHERE rl.method=m.method AND rl.unit=u.unit)""", "rl"))
def resume(spark, sf):
    lists = ranked_lists(spark, sf)
    work = lists.select("unit").distinct().select("unit", F.explode(F.array(F.lit("line"), F.lit("price"), F.lit("qty"))).alias("method"))
    return pending(work, lists, ["method", "unit"])


@query("q_c10_grid", sql("""
SELECT s.site, p.pattern, g.guard, c.calib, count(ev.participant) AS n FROM (SELECT DISTINCT site FROM ev) s CROSS JOIN (VALUES ('direct'),('scan')) p(pattern) CROSS JOIN (VALUES ('none'),('double')) g(guard)
 CROSS JOIN (VALUES ('free'),('calibrated')) c(calib) LEFT JOIN ev ON ev.site=s.site AND ev.pattern=p.pattern AND ev.guard=g.guard AND ev.calib=c.calib AND event='trial_end' GROUP BY 1,2,3,4""", "ev"))
def grid(spark, sf):
    log = event_log(spark, sf)

    def axis(name, values):
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)

    cells = log.select("site").distinct().select("*", axis("pattern", ["direct", "scan"])).select("*", axis("guard", ["none", "double"])).select("*", axis("calib", ["free", "calibrated"]))
    n = log.where("event = 'trial_end'").groupBy("site", "pattern", "guard", "calib").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["site", "pattern", "guard", "calib"], "left").fillna({"n": 0})
