"""Ranked-list queries: metrics at K, summaries, paired differences, popularity, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.functions.scores import extended_labels
from evalgrid.functions.text import norm_item
from evalgrid.operators import ranking as R
from evalgrid.operators.resample import bootstrap_ci, metric_intervals, paired_differences
from evalgrid.operators.retrieval import cosine_top_k, rescore
from evalgrid.plans.classification import rounded
from evalgrid.plans.registry import query
from evalgrid.plans.roles import CATEGORIES, GROUPS, bootstrap_sql, predictions, ranked_lists, sql, table, unit_truth
from evalgrid.session import cut_lineage

METHODS = ["line", "price", "qty"]
VOCABULARY = [0, 1, 2, 3, 4, 5]  # "hammer" is no vocabulary entry
GROUP_IDS = [[CATEGORIES.index(n) for n in g] for g in GROUPS]
ROW_REPS = 5000

_RANKED = """
cu AS (SELECT unit FROM (SELECT DISTINCT method, unit FROM rl) GROUP BY unit HAVING count(*)=3),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method,unit,category ORDER BY pos) AS rn FROM rl WHERE unit IN (SELECT unit FROM cu)) WHERE category IS NULL OR rn=1),
ra AS (SELECT method, unit, item, category, row_number() OVER (PARTITION BY method, unit ORDER BY pos) AS rank FROM kp),
rk AS (SELECT * FROM ra WHERE rank<=12),
it AS (SELECT rk.*, room, seconds, list_intersect(pos,[0,1,2,3,4,5]) AS rel, CASE WHEN category IS NULL THEN NULL WHEN category IN (1,4) THEN [1,4] WHEN category IN (2,3) THEN [2,3] ELSE [category] END AS grp,
  coalesce(list_contains(pos,category),false) AS right_, coalesce(list_contains(neg,category),false) AND NOT list_contains(pos,category) AS wrong_,
  coalesce(list_contains(pos_l,category),false) AS right1, coalesce(list_contains(neg_l,category),false) AND NOT list_contains(pos_l,category) AS wrong1, pos FROM rk JOIN rv USING (unit)),
jd AS (SELECT *, right_ OR coalesce(list_has_any(grp,pos),false) AS len_, coalesce(list_contains(rel,category),false) AS isrel, coalesce(list_intersect(rel,grp),CAST([] AS INT[])) AS covers FROM it),
ks AS (SELECT * FROM (VALUES (3),(6),(12)) k(k)),
a0 AS (SELECT method, unit, k, any_value(room) AS room, any_value(seconds) AS seconds, any_value(len(rel)) AS nrel,
  count(*) FILTER (WHERE rank<=k AND right_) AS correct, count(*) FILTER (WHERE rank<=k AND wrong_) AS wrong, count(*) FILTER (WHERE rank<=k AND len_) AS lc, count(*) FILTER (WHERE rank<=k AND wrong_ AND NOT len_) AS lw,
  count(*) FILTER (WHERE rank<=k AND right1) AS c1, count(*) FILTER (WHERE rank<=k AND wrong1) AS w1, count(*) FILTER (WHERE rank<=k AND isrel) AS nr,
  len(list_distinct(flatten(list(covers) FILTER (WHERE rank<=k)))) AS reach FROM jd, ks GROUP BY 1,2,3),
me AS (SELECT *, CASE WHEN correct+wrong>0 THEN correct/(correct+wrong) END AS precision_, CASE WHEN lc+lw>0 THEN lc/(lc+lw) END AS precision_lenient, (correct+wrong)/k AS verifiable,
  CASE WHEN c1+w1>0 THEN c1/(c1+w1) END AS precision_single, (c1+w1)/k AS verifiable_single, CASE WHEN nrel>0 THEN nr/nrel END AS recall, CASE WHEN nrel>0 THEN reach/nrel END AS recall_lenient,
  CASE WHEN correct>0 THEN 1e0 ELSE 0e0 END AS hit, CASE WHEN lc>0 THEN 1e0 ELSE 0e0 END AS hit_lenient FROM a0)"""
_MEANS = ", ".join(f"round(avg({'precision_' if c == 'precision' else c}),6) AS {'precision' if c == 'precision' else c}" for c in R.METRICS)


def _common(spark, sf):
    lists = cut_lineage(ranked_lists(spark, sf))  # stands for a stored output table; read three times
    return lists.join(R.common_units(lists), "unit", "left_semi")


def _ranked(spark, sf, lists=None):
    return R.first_mentions(_common(spark, sf) if lists is None else lists, ["unit", "method"], "place", "category", ["item"])


def _items(spark, sf, lists=None):
    return R.judged(_ranked(spark, sf, lists), unit_truth(spark, sf), "unit", GROUP_IDS, VOCABULARY)


def _metrics(spark, sf, lists=None):
    return cut_lineage(R.rank_metrics(_items(spark, sf, lists), ["method", "unit"], ["room", "seconds"]))


@query("q_d18_rank_at_k", sql(f"""WITH {_RANKED}
SELECT method, room, k, count(*) AS units, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(wrong) AS BIGINT) AS wrong, {_MEANS} FROM me GROUP BY 1,2,3""", "rl", "rv"))
def rank_at_k(spark, sf):
    m = _metrics(spark, sf).groupBy("method", "room", "k").agg(
        F.count(F.lit(1)).alias("units"), F.sum("correct").alias("correct"), F.sum("wrong").alias("wrong"), *[F.avg(c).alias(c) for c in R.METRICS])
    return rounded(m, *R.METRICS)


@query("q_d19_summary", sql(f"""WITH {_RANKED},
ln AS (SELECT method, avg(n) AS mean_items, count(*) FILTER (WHERE n<3) AS short_lists FROM (SELECT method, unit, count(*) AS n FROM ra GROUP BY 1,2) GROUP BY 1),
sc AS (SELECT method, quantile_cont(seconds,0.5) AS s FROM (SELECT DISTINCT method, unit, seconds FROM me) GROUP BY 1)
SELECT me.method, k, count(*) AS units, round(sum(correct)/sum(correct+wrong),6) AS pooled_precision, {_MEANS}, count(precision_) AS precision_n, count(recall) AS recall_n,
 round(any_value(mean_items),6) AS mean_items, any_value(short_lists) AS short_lists, round(any_value(s),6) AS median_seconds FROM me JOIN ln ON ln.method=me.method JOIN sc ON sc.method=me.method GROUP BY 1,2""", "rl", "rv"))
def summary(spark, sf):
    lists = _common(spark, sf)
    s = R.method_summary(_metrics(spark, sf, lists), R.list_lengths(lists, ["method", "unit"], "category"), ["method"], "unit")
    return rounded(s, "pooled_precision", *R.METRICS, "mean_items", "median_seconds")


@query("q_c5_common", sql("""
SELECT unit FROM (SELECT DISTINCT method, unit FROM rl) GROUP BY unit HAVING count(*)=3""", "rl"))
def common(spark, sf):
    return R.common_units(ranked_lists(spark, sf))


@query("q_g12_dedupe", sql(f"""WITH {_RANKED}
SELECT method, rank, category, count(*) AS n FROM rk GROUP BY 1,2,3""", "rl", "rv"))
def dedupe(spark, sf):
    r = _ranked(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))
    return r.groupBy("method", "rank", "category").agg(F.count(F.lit(1)).alias("n"))


@query("q_g3_redensify", sql(f"""WITH {_RANKED},
rr AS (SELECT method, item, row_number() OVER (PARTITION BY method, unit ORDER BY rank) AS rank FROM rk WHERE split_part(item,' ',1) NOT IN ('old','new'))
SELECT method, rank, item, count(*) AS n FROM rr GROUP BY 1,2,3""", "rl", "rv"))
def redensify(spark, sf):
    r = R.redensify(_ranked(spark, sf), ["method", "unit"], ~F.split_part("item", F.lit(" "), F.lit(1)).isin("old", "new"))
    return r.groupBy("method", F.col("rank").cast("bigint").alias("rank"), "item").agg(F.count(F.lit(1)).alias("n"))


def _long(spark, sf):
    m = _metrics(spark, sf)
    pick = F.array(
        F.struct(F.lit("hit@3").alias("metric"), F.when(F.col("k") == 3, F.col("hit")).alias("v")),
        F.struct(F.lit("precision@3").alias("metric"), F.when(F.col("k") == 3, F.col("precision")).alias("v")),
        F.struct(F.lit("recall@6").alias("metric"), F.when(F.col("k") == 6, F.col("recall")).alias("v")),
    )
    return m.select("method", "unit", F.inline(pick)).where(F.col("v").isNotNull())


_LONG = """lo AS (SELECT method, unit, 'hit@3' AS metric, hit AS v FROM me WHERE k=3 UNION ALL SELECT method, unit, 'precision@3', precision_ FROM me WHERE k=3 AND precision_ IS NOT NULL
 UNION ALL SELECT method, unit, 'recall@6', recall FROM me WHERE k=6 AND recall IS NOT NULL)"""
PAIRS = [("line", "price"), ("line", "qty"), ("price", "qty")]
_PAIR_VALUES = ",".join(f"('{a}','{b}')" for a, b in PAIRS)


@query("q_e2_row_ci", sql(f"""WITH {_RANKED}, {_LONG}, units AS (SELECT method, metric, unit, v FROM lo),
{bootstrap_sql('units', 'method, metric', ROW_REPS)}
SELECT method, metric, n, round(est,6) AS estimate, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM b_est LEFT JOIN b_ci USING (method, metric)""", "rl", "rv"))
def row_ci(spark, sf):
    return rounded(bootstrap_ci(_long(spark, sf), ["method", "metric"], "unit", "v", ROW_REPS), "estimate", "ci_lo", "ci_hi")


@query("q_c6_pairs", sql(f"""WITH {_RANKED}, {_LONG}
SELECT p.a, p.b, x.metric, count(*) AS n, round(avg(x.v-y.v),6) AS mean_diff, round(min(x.v-y.v),6) AS min_diff, round(max(x.v-y.v),6) AS max_diff
FROM (VALUES {_PAIR_VALUES}) p(a,b) JOIN lo x ON x.method=p.a JOIN lo y ON y.method=p.b AND y.unit=x.unit AND y.metric=x.metric GROUP BY 1,2,3""", "rl", "rv"))
def pairs(spark, sf):
    d = paired_differences(_long(spark, sf), spark.createDataFrame(PAIRS, "a string, b string"), "unit", ["metric"], "method", "v")
    d = d.groupBy("a", "b", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.min("diff").alias("min_diff"), F.max("diff").alias("max_diff"))
    return rounded(d, "mean_diff", "min_diff", "max_diff")


@query("q_e4_paired", sql(f"""WITH {_RANKED}, {_LONG},
units AS (SELECT p.a, p.b, x.metric, x.unit, x.v-y.v AS v FROM (VALUES {_PAIR_VALUES}) p(a,b) JOIN lo x ON x.method=p.a JOIN lo y ON y.method=p.b AND y.unit=x.unit AND y.metric=x.metric),
{bootstrap_sql('units', 'a, b, metric', ROW_REPS)}
SELECT a, b, metric, n, round(est,6) AS estimate, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi FROM b_est LEFT JOIN b_ci USING (a, b, metric)""", "rl", "rv"))
def paired(spark, sf):
    d = paired_differences(_long(spark, sf), spark.createDataFrame(PAIRS, "a string, b string"), "unit", ["metric"], "method", "v")
    return rounded(bootstrap_ci(d, ["a", "b", "metric"], "unit", "diff", ROW_REPS), "estimate", "ci_lo", "ci_hi")


_GOLD = """gd AS (SELECT o_orderkey AS unit, CAST(o_custkey%7 AS INT) AS gold, o_orderstatus AS condition, CAST(o_custkey%7<>(o_custkey+3)%7 AND o_orderpriority<>'5-LOW' AS BOOLEAN) AS recoverable, o_orderpriority AS room FROM orders),
gr AS (SELECT rk.method, rk.unit, any_value(condition) AS condition, any_value(room) AS room, any_value(recoverable) AS recoverable, min(CASE WHEN category=gold THEN rank END) AS rank FROM rk JOIN gd USING (unit) GROUP BY 1,2),
gt AS (SELECT *, CASE WHEN rank<=1 THEN 1e0 ELSE 0e0 END AS top1, CASE WHEN rank<=3 THEN 1e0 ELSE 0e0 END AS top3, CASE WHEN rank<=5 THEN 1e0 ELSE 0e0 END AS top5 FROM gr)"""


def _gold(spark, sf):
    o = table(spark, sf, "orders")
    c = F.col("o_custkey")
    gold = o.select(
        F.col("o_orderkey").alias("unit"), (c % 7).cast("int").alias("gold"), F.col("o_orderstatus").alias("condition"),
        ((c % 7 != (c + 3) % 7) & (F.col("o_orderpriority") != "5-LOW")).alias("recoverable"), F.col("o_orderpriority").alias("room"),
    )
    return R.gold_rank(_ranked(spark, sf), gold, ["method", "unit"], "unit")


TOPS = ["top1", "top3", "top5"]


@query("q_d21_topn", sql(f"""WITH {_RANKED}, {_GOLD},
units AS (SELECT method, condition, unit, metric, v FROM gt UNPIVOT (v FOR metric IN (top1, top3, top5))),
{bootstrap_sql('units', 'method, condition, metric', ROW_REPS)},
ci AS (SELECT method, condition, {', '.join(f"round(max(CASE WHEN metric='{m}' THEN ci_{e} END),6) AS {m}_{e}" for m in TOPS for e in ('lo', 'hi'))} FROM b_ci GROUP BY 1,2),
su AS (SELECT method, condition, count(*) AS n, count(rank) AS found, round(avg(rank),6) AS mean_rank, round(avg(top1),6) AS top1, round(avg(top3),6) AS top3, round(avg(top5),6) AS top5 FROM gt GROUP BY 1,2)
SELECT su.*, {', '.join(f'{m}_{e}' for m in TOPS for e in ('lo', 'hi'))} FROM su LEFT JOIN ci ON ci.method=su.method AND ci.condition=su.condition""", "rl", "rv"))
def topn(spark, sf):
    per = cut_lineage(_gold(spark, sf).select("method", "condition", "unit", "rank", *TOPS))
    g = per.groupBy("method", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.count("rank").alias("found"), F.avg("rank").alias("mean_rank"), *[F.avg(f"top{i}").alias(f"top{i}") for i in (1, 3, 5)])
    ci = metric_intervals(per, ["method", "condition"], "unit", TOPS, ROW_REPS)
    return rounded(g.join(ci, ["method", "condition"], "left"), "mean_rank", *TOPS, *[f"{m}_{e}" for m in TOPS for e in ("lo", "hi")])


@query("q_d22_grouping_sets", sql(f"""WITH {_RANKED}, {_GOLD}
SELECT method, condition, recoverable, room, CAST(GROUPING_ID(condition, recoverable, room) AS BIGINT) AS level, count(*) AS n, round(avg(top1),6) AS top1, round(avg(top3),6) AS top3
FROM gt GROUP BY GROUPING SETS ((method, condition),(method, recoverable),(method, room),(method))""", "rl", "rv"))
def grouping_sets(spark, sf):
    m, c, r, o = (F.col(x) for x in ("method", "condition", "recoverable", "room"))
    g = _gold(spark, sf).groupingSets([[m, c], [m, r], [m, o], [m]], m, c, r, o).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg("top1").alias("top1"), F.avg("top3").alias("top3"))
    return rounded(g, "top1", "top3")


@query("q_d26_top15", sql(f"""WITH {_RANKED},
c AS (SELECT method, room, trim(regexp_replace(regexp_replace(lower(item),'[^\\p{{L}}\\p{{N}} ]','','g'),' +',' ','g')) AS it, count(*) AS n FROM it WHERE category IS NULL GROUP BY 1,2,3),
t AS (SELECT *, row_number() OVER (PARTITION BY method, room ORDER BY n DESC, it) AS rn FROM c)
SELECT method, room, string_agg(it||' ('||n||')', ', ' ORDER BY rn) AS top FROM t WHERE rn<=15 GROUP BY 1,2""", "rl", "rv"))
def top15(spark, sf):
    un = _items(spark, sf).where(F.col("category").isNull()).withColumn("it", norm_item(F.col("item")))
    return R.top_values(un, ["method", "room"], "it")


@query("q_j1_loo_popular", sql("""
WITH mem AS (SELECT unit, unnest(list_intersect(pos,[0,1,2,3,4,5])) AS category FROM rv),
nm AS (SELECT * FROM (VALUES (0,'anvil'),(1,'bolt'),(2,'gear'),(3,'plate'),(4,'ring'),(5,'widget')) v(category,name)),
tot AS (SELECT nm.category, name, count(unit) AS n FROM nm LEFT JOIN mem USING (category) GROUP BY 1,2),
s AS (SELECT rv.unit, t.category, name, n-CASE WHEN m.unit IS NULL THEN 0 ELSE 1 END AS score FROM rv CROSS JOIN tot t LEFT JOIN mem m ON m.unit=rv.unit AND m.category=t.category),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, name) AS rank FROM s)
SELECT unit, category, score, rank FROM r WHERE rank<=12""", "rv"))
def loo_popular(spark, sf):
    rv = unit_truth(spark, sf)
    members = rv.select("unit", F.explode(F.array_intersect("pos", F.array(*[F.lit(v) for v in VOCABULARY]))).alias("category"))
    names = spark.createDataFrame([(i, CATEGORIES[i]) for i in VOCABULARY], "category int, name string")
    out = R.loo_popularity(members, rv, names)
    return out.select("unit", "category", "score", F.col("rank").cast("bigint").alias("rank"))


@query("q_j9_rank_curve", sql(f"""WITH {_RANKED},
pr_ AS (SELECT unit, unnest(list_intersect(pos,[0,1,2,3,4,5])) AS category FROM rv WHERE unit IN (SELECT unit FROM cu)),
nm AS (SELECT * FROM (VALUES (0,'anvil'),(1,'bolt'),(2,'gear'),(3,'plate'),(4,'ring'),(5,'widget')) v(category,name)),
od AS (SELECT category, row_number() OVER (ORDER BY n DESC, name) AS fixed_rank FROM (SELECT nm.category, name, count(unit) AS n FROM nm LEFT JOIN pr_ USING (category) GROUP BY 1,2)),
c AS (SELECT m.method, p.unit, p.category, coalesce(r.rank,999) AS rank, fixed_rank FROM pr_ p CROSS JOIN (VALUES ('line'),('price'),('qty')) m(method) LEFT JOIN rk r ON r.unit=p.unit AND r.method=m.method AND r.category=p.category JOIN od ON od.category=p.category)
SELECT method, category, fixed_rank, count(*) AS n, round(avg(CASE WHEN rank<=3 THEN 1e0 ELSE 0e0 END),6) AS top3, round(avg(CASE WHEN rank<=6 THEN 1e0 ELSE 0e0 END),6) AS top6,
 round(avg(CASE WHEN rank<=12 THEN 1e0 ELSE 0e0 END),6) AS top12, count(*) FILTER (WHERE rank=999) AS never FROM c GROUP BY 1,2,3""", "rl", "rv"))
def rank_curve(spark, sf):
    lists = _common(spark, sf)
    units = lists.select("unit").distinct()
    present = unit_truth(spark, sf).join(units, "unit", "left_semi").select("unit", F.explode(F.array_intersect("pos", F.array(*[F.lit(v) for v in VOCABULARY]))).alias("category"))
    names = spark.createDataFrame([(i, CATEGORIES[i]) for i in VOCABULARY], "category int, name string")
    c = R.rank_curve(_ranked(spark, sf, lists), present, R.popularity_order(present, names), METHODS)
    tops = [F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}") for k in R.KS]
    g = c.groupBy("method", "category", F.col("fixed_rank").cast("bigint").alias("fixed_rank")).agg(F.count(F.lit(1)).alias("n"), *tops, F.count_if(F.col("rank") == R.NEVER).alias("never"))
    return rounded(g, "top3", "top6", "top12")


# Zones of each grid read by the interface model.
GRID_ZONES = {"1x2": 2, "1x3": 3, "2x2": 4, "3x3": 9, "4x4": 16}


@query("q_j10_params", sql("""
WITH g AS (SELECT grid, n_zones, subject, avg(CASE WHEN zt=zp THEN 1e0 ELSE 0e0 END) AS acc FROM pz GROUP BY 1,2,3)
SELECT CAST(n_zones AS INT) AS zones, round(avg(acc),6) AS accuracy FROM g WHERE grid IN ('1x2','1x3','2x2','3x3','4x4') GROUP BY 1""", "pz"))
def params(spark, sf):
    from evalgrid.operators import classify as C

    per = C.group_accuracy(C.zone_answers(predictions(spark, sf)), ["grid"], "subject")
    zones = F.create_map(*[F.lit(x) for kv in GRID_ZONES.items() for x in kv])
    acc = C.macro_accuracy(per, ["grid"]).where(F.col("grid").isin(list(GRID_ZONES)))
    return rounded(acc.select(F.element_at(zones, F.col("grid")).alias("zones"), F.col("acc_mean").alias("accuracy")), "accuracy")


@query("q_b25_labels", """
WITH o AS (SELECT o_orderkey AS unit, [CAST(o_custkey%7 AS INT)] AS pos, [CAST((o_custkey+1)%7 AS INT),CAST((o_custkey+5)%7 AS INT)] AS neg,
 [CAST((o_orderkey*3)%7 AS INT),CAST((o_orderkey+1)%7 AS INT)] AS other, [0,1,2,3,4] AS pos_ok, [2,3,4,5,6] AS neg_ok, o_orderstatus<>'P' AS known FROM orders),
x AS (SELECT unit, list_sort(list_distinct(list_concat(pos, [e FOR e IN other IF list_contains(pos_ok,e) AND NOT list_contains(neg,e)]))) AS px,
 list_sort(list_distinct([e FOR e IN list_concat(neg, CASE WHEN known THEN [f FOR f IN neg_ok IF NOT list_contains(other,f)] ELSE [] END) IF NOT list_contains(pos,e) AND NOT list_contains(other,e)])) AS nx FROM o)
SELECT unit, array_to_string(px,',') AS pos_x, array_to_string(nx,',') AS neg_x FROM x""")
def labels(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    def ids(*xs):
        return F.array(*[x.cast("int") for x in xs])
    pos_x, neg_x = extended_labels(
        ids(c % 7), ids((c + 1) % 7, (c + 5) % 7), ids((k * 3) % 7, (k + 1) % 7), F.array(*[F.lit(i) for i in range(5)]), F.array(*[F.lit(i) for i in range(2, 7)]), F.col("o_orderstatus") != "P")
    return table(spark, sf, "orders").select(k.alias("unit"), F.array_join(pos_x.cast("array<string>"), ",").alias("pos_x"), F.array_join(neg_x.cast("array<string>"), ",").alias("neg_x"))


_COS = """
el AS (SELECT vec_id, label, generate_subscripts(embedding,1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
ce AS (SELECT label AS item, p, avg(x) AS c FROM el GROUP BY 1,2),
cn AS (SELECT item, sqrt(sum(c*c)) AS n FROM ce GROUP BY 1),
un AS (SELECT vec_id, sqrt(sum(x*x)) AS n FROM el GROUP BY 1),
cs AS (SELECT el.vec_id AS unit, ce.item, round(sum(x*c)/any_value(un.n)/any_value(cn.n),6) AS score FROM el JOIN ce USING (p) JOIN un ON un.vec_id=el.vec_id JOIN cn ON cn.item=ce.item GROUP BY 1,2)"""


def label_bank(spark, sf):
    """One mean vector per label: the category bank of the retrieval role."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("item"), F.posexplode("embedding").alias("p", "x"))
    m = e.groupBy("item", "p").agg(F.avg(F.col("x").cast("double")).alias("c"))
    return m.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("p", "c"))).alias("v")).select("item", F.transform("v", lambda s: s["c"]).alias("vec"))


def _units(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit"), F.col("embedding").cast("array<double>").alias("vec"))


@query("q_j3_cosine_topk", sql(f"""WITH {_COS},
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, item) AS rank FROM cs) SELECT unit, CAST(item AS BIGINT) AS item, score, rank FROM r WHERE rank<=12"""))
def cosine(spark, sf):
    top = cosine_top_k(_units(spark, sf), label_bank(spark, sf))
    return top.select("unit", "item", "score", F.col("rank").cast("bigint").alias("rank"))


@query("q_j5_rescore", sql(f"""WITH {_COS},
nb AS (SELECT item, avg(score) AS base FROM cs GROUP BY 1),
s AS (SELECT unit, cs.item, round(score-base,6) AS score FROM cs JOIN nb USING (item)),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, item) AS rank FROM s) SELECT unit, CAST(item AS BIGINT) AS item, score, rank FROM r WHERE rank<=12"""))
def pmi(spark, sf):
    bank = label_bank(spark, sf)
    scores = cosine_top_k(_units(spark, sf), bank, k=None)
    neutral = scores.groupBy("item").agg(F.avg("score").alias("score"))
    top = rescore(scores, neutral)
    return top.select("unit", "item", "score", F.col("rank").cast("bigint").alias("rank"))
