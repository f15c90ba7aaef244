"""Text queries: clean-up, phrase splitting, category matching, overlap retrieval, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalgrid.functions import text as X
from evalgrid.functions.scores import first_class
from evalgrid.operators import sampling as S
from evalgrid.operators.matching import match_categories, surface_table
from evalgrid.operators.retrieval import error_pools, jaccard_top_k, noise_cases, overlap_top_k
from evalgrid.plans.classification import rounded
from evalgrid.plans.ranking import _RANKED, _items
from evalgrid.plans.registry import query
from evalgrid.plans.roles import sql, table, unit_truth


@query("q_b7_canon", r"""
SELECT p_partkey, lower(trim(replace(regexp_replace(replace(p_name,' ','_')||'_('||p_type||')','_?\(.*?\)','','g'),'_',' '))) AS name FROM part""")
def canon(spark, sf):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_("), F.col("p_type"), F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", X.canon(raw).alias("name"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(text),'[^\p{L}\p{N} ]','','g'),' +',' ','g'))"


@query("q_b8_norm", f"SELECT doc_id, md5({_NORM}) AS digest, CAST(length({_NORM}) AS INT) AS n FROM documents")
def norm(spark, sf):
    n = X.norm_item(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).alias("n"))


# The catalogue of the matching role. Names are not all single words, one category
# has the name of another as synonym, and one alias names an unknown category.
CATALOGUE = [
    (0, "anvil", []), (1, "bolt", ["fastener"]), (2, "gear", ["cog_wheel"]), (3, "plate_(dish)", ["old plate"]), (4, "ring", []),
    (5, "widget", []), (6, "hammer", ["rod"]), (7, "red_ring", []), (8, "cold_bolt", ["bolt"]),
]
CATALOGUE_ALIASES = [("gizmo", "widget"), ("gizmos", "widget"), ("steel", "ingot")]


@query("q_b10_match", r"""
WITH ph AS (SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN p_name WHEN 1 THEN 'Two '||p_name||'s' WHEN 2 THEN 'the '||p_name||' of steel' ELSE 'A box for '||p_name||'es' END AS phrase FROM part),
sf AS (SELECT * FROM (VALUES ('anvil',0),('bolt',1),('gear',2),('plate',3),('ring',4),('widget',5),('hammer',6),('red ring',7),('cold bolt',8),('fastener',1),('cog wheel',2),('old plate',3),('rod',6),('gizmo',5),('gizmos',5)) s(surface,category)),
r AS (SELECT DISTINCT phrase, list_filter(string_split_regex(regexp_replace(lower(phrase),'[^a-z]',' ','g'),' +'), lambda x: x<>'') AS raw FROM ph),
c AS (SELECT phrase, raw, list_min(list_filter(range(2,len(raw)+1), lambda i: raw[i] IN ('of','for','on','with','in','at','from','near'))) AS cut FROM r),
w AS (SELECT phrase, array_to_string(list_filter(raw, lambda x: x NOT IN ('a','an','the')),' ') AS whole,
  list_filter(CASE WHEN cut IS NULL THEN raw ELSE raw[1:cut-1] END, lambda x: x NOT IN ('a','an','the','some','of','with','on','in','and','or','for','to','at','by')) AS words FROM c),
sx AS (SELECT * FROM (VALUES (0,'',''),(1,'ies','y'),(2,'ves','f'),(3,'ves','fe'),(4,'oes','o'),(5,'ches','ch'),(6,'shes','sh'),(7,'sses','ss'),(8,'xes','x'),(9,'es',''),(10,'s','')) s(j,suf,rep)),
t AS (SELECT phrase, words, unnest(range(1,len(words)+1)) AS i FROM w),
cd AS (SELECT phrase, 0 AS i, 0 AS j, whole AS surface FROM w UNION ALL
  SELECT phrase, i, j, array_to_string(list_concat(words[i:len(words)-1], [left(words[-1], length(words[-1])-length(suf))||rep]),' ') FROM t, sx WHERE suf='' OR (ends_with(words[-1],suf) AND length(words[-1])>length(suf)+1)),
m AS (SELECT phrase, arg_min(category,(i,j)) AS category FROM cd JOIN sf USING (surface) GROUP BY 1)
SELECT p_partkey, ph.phrase, category FROM ph LEFT JOIN m ON m.phrase=ph.phrase""")
def match(spark, sf):
    n = F.col("p_name")
    phrase = (
        F.when(F.col("p_partkey") % 4 == 0, n).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Two "), n, F.lit("s")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("the "), n, F.lit(" of steel"))).otherwise(F.concat(F.lit("A box for "), n, F.lit("es")))
    )
    p = table(spark, sf, "part").select("p_partkey", phrase.alias("phrase"))
    cats = spark.createDataFrame(CATALOGUE, "id int, name string, synonyms array<string>")
    surfaces = surface_table(cats, spark.createDataFrame(CATALOGUE_ALIASES, "surface string, name string"))
    return p.join(match_categories(p, surfaces, "phrase"), "phrase").select("p_partkey", "phrase", "category")


# RE2 has no lookahead: nouns in -ing lose their g first, the -ing words left are verbs
_ING = [w for w in X.ING_NOUNS if w.split(" ")[0].endswith("ing")]
_PROTECT = r"\b(" + "|".join(sorted({w[:-1] for w in _ING if " " not in w}, key=len, reverse=True)) + r")g\b"
_TWO = [w for w in _ING if " " in w]


def _protected(c: str) -> str:
    for w in _TWO:
        a, b = w.split(" ")
        c = rf"regexp_replace({c},'\b{a} {b}\b','{a[:-1]}~ {b}','g')"
    return rf"regexp_replace({c},'{_PROTECT}','\1~','g')"


# RE2 knows only ASCII word boundaries: letters and digits beyond ASCII become Z, which lower-cased text
# does not hold and which the clean-up of a phrase drops as it drops them
_WORDY = r"regexp_replace(regexp_replace(lower(text),'[^\x00-\x7F\p{L}\p{N}]',' ','g'),'[^\x00-\x7F]','Z','g')"

_PHRASES = rf"""
WITH c AS (SELECT conv_id, turn, {_protected(_WORDY)} AS t FROM conversations),
s AS (SELECT conv_id, turn, string_split_regex(t, '[,;.:!?\n]|\b(?:{"|".join(X.BREAK_WORDS)})\b|\b[a-z]+ing\b') AS parts FROM c),
u AS (SELECT conv_id, turn, unnest(parts) AS p, generate_subscripts(parts,1) AS i FROM s),
k AS (SELECT conv_id, turn, i, trim(regexp_replace(trim(regexp_replace(replace(p,'~','g'),'[^a-z\s-]',' ','g'),E' \t\r\n'), '^(?:(?:{"|".join(X.LEAD_WORDS)}|\d+)\s+)+',''),E' \t\r\n') AS ph FROM u),
f AS (SELECT conv_id, turn, ph, min(i) AS i FROM k WHERE length(ph)>=2 AND len(string_split_regex(ph,'\s+'))<=4 AND ph NOT IN ({",".join(repr(w) for w in X.PHRASE_STOP)}) GROUP BY 1,2,3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS rn FROM f),
g AS (SELECT conv_id, turn, string_agg(ph,'|' ORDER BY rn) AS items FROM r WHERE rn<=12 GROUP BY 1,2)
SELECT c.conv_id, c.turn, coalesce(items,'') AS items FROM c LEFT JOIN g USING (conv_id, turn)"""


@query("q_b11_phrases", _PHRASES)
def phrases(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.phrase_items(F.col("text")), "|").alias("items"))


@query("q_b12_list", r"""
WITH u AS (SELECT doc_id, unnest(string_split_regex(text,'[,;\n]')) AS p, generate_subscripts(string_split_regex(text,'[,;\n]'),1) AS i FROM documents),
k AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p,'^\s*(?:\d+[.)]|[-*•])\s*',''),'^\s+|\s+$','','g'),'^\.+|\.+$','','g'),'^\s+|\s+$','','g') AS t FROM u),
f AS (SELECT doc_id, lower(t) AS l, min(i) AS i, arg_min(t,i) AS t FROM k WHERE t<>'' AND length(t)<=40 GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f),
g AS (SELECT doc_id, string_agg(t,'|' ORDER BY rn) AS items FROM r WHERE rn<=12 GROUP BY 1)
SELECT d.doc_id, coalesce(items,'') AS items FROM documents d LEFT JOIN g USING (doc_id)""")
def lists(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.list_items(F.col("text")), "|").alias("items"))


@query("q_b13_strip", r"""
WITH d AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id%2=0 THEN upper(source)||' '||lang||': ' ELSE '' END||text,'^\s+|\s+$','','g') AS t, source||' '||lang||':' AS p FROM documents)
SELECT doc_id, md5(CASE WHEN starts_with(lower(t),lower(p)) THEN regexp_replace(substring(t,CAST(length(p) AS INT)+1),'^\s+|\s+$','','g') ELSE t END) AS digest FROM d""")
def strip_prompt(spark, sf):
    d = table(spark, sf, "documents")
    echo = F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("source"), F.lit(" "), F.col("lang"), F.lit(": "))).otherwise(F.lit(""))
    return d.select("doc_id", F.md5(X.strip_prompt(F.concat(echo, F.col("text")), F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit(":")))).alias("digest"))


@query("q_b23_template", """
SELECT p_partkey, CASE p_size%3 WHEN 0 THEN 'I want '||split_part(p_name,' ',1)||'.' WHEN 1 THEN 'I want '||split_part(p_name,' ',1)||' and '||split_part(p_name,' ',2)||'.'
 ELSE 'I want '||split_part(p_name,' ',1)||', '||split_part(p_name,' ',2)||' and '||lower(p_type)||'.' END AS sentence FROM part""")
def template(spark, sf):
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    return table(spark, sf, "part").select("p_partkey", X.want_sentence(F.slice(words, F.lit(1), F.col("p_size") % 3 + 1)).alias("sentence"))


NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
_NOUN_SQL = "['anvil','bolt','gear','gizmo','plate','ring','rod','widget']"


@query("q_j2_overlap", f"""
WITH bo AS (SELECT DISTINCT n_nationkey AS item, {_NOUN_SQL}[(n_nationkey*n_regionkey+j*3)%8+1] AS object FROM nation, range(3) r(j) WHERE j<=n_nationkey%3),
sh AS (SELECT DISTINCT c_custkey AS case_id, {_NOUN_SQL}[(c_custkey*5+j*(c_nationkey+1))%8+1] AS object FROM customer, range(3) r(j) WHERE j<=c_custkey%3),
fq AS (SELECT object, count(*)-1 AS f FROM bo GROUP BY 1), pp AS (SELECT item, sum(f) AS pop FROM bo JOIN fq USING (object) GROUP BY 1),
ov AS (SELECT case_id, item, count(*) AS overlap FROM sh JOIN bo USING (object) GROUP BY 1,2),
al AS (SELECT c_custkey AS case_id, p.item, coalesce(overlap,0) AS overlap, pop FROM customer CROSS JOIN pp p LEFT JOIN ov ON ov.case_id=c_custkey AND ov.item=p.item),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overlap DESC, pop DESC, item) AS rank FROM al)
SELECT case_id, CAST(item AS INT) AS item, overlap, CAST(pop AS BIGINT) AS pop, rank FROM r WHERE rank<=10""")
def overlap(spark, sf):
    nouns = F.array(*[F.lit(n) for n in NOUNS])
    j = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")
    bank = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", j).where("j <= n_nationkey % 3")
    bank = bank.select(F.col("n_nationkey").alias("item"), F.get(nouns, ((F.col("n_nationkey") * F.col("n_regionkey") + F.col("j") * 3) % 8).cast("int")).alias("object"))
    c = table(spark, sf, "customer")
    shown = c.select("c_custkey", "c_nationkey", j).where("j <= c_custkey % 3")
    shown = shown.select(F.col("c_custkey").alias("case_id"), F.get(nouns, ((F.col("c_custkey") * 5 + F.col("j") * (F.col("c_nationkey") + 1)) % 8).cast("int")).alias("object"))
    top = overlap_top_k(shown, bank, c.select(F.col("c_custkey").alias("case_id")))
    return top.select("case_id", "item", "overlap", "pop", F.col("rank").cast("bigint").alias("rank"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({}),'[a-z]+'), lambda x: x NOT IN ({})))"
_STOP_SQL = ",".join(f"'{w}'" for w in X.TOKEN_STOP)
JACCARD_SQL = f"""
ct AS (SELECT conv_id*1000+turn AS case_id, unnest({_TOK.format('text', _STOP_SQL)}) AS token FROM conversations),
bs AS (SELECT item_id AS item, unnest(string_split(text,'. ')) AS s, generate_subscripts(string_split(text,'. '),1) AS text_no FROM benchmark),
bt AS (SELECT item, text_no, unnest({_TOK.format('s', _STOP_SQL)}) AS token FROM bs),
nc AS (SELECT case_id, count(*) AS nc FROM ct GROUP BY 1), nb AS (SELECT item, text_no, count(*) AS nb FROM bt GROUP BY 1,2),
cm AS (SELECT case_id, item, text_no, count(*) AS c FROM ct JOIN bt USING (token) GROUP BY 1,2,3),
js AS (SELECT case_id, item, max(c/greatest(nc+nb-c,1)) AS score FROM cm JOIN nb USING (item, text_no) JOIN nc USING (case_id) GROUP BY 1,2),
al AS (SELECT c.conv_id*1000+c.turn AS case_id, b.item_id AS item, coalesce(score,0) AS score FROM conversations c CROSS JOIN benchmark b LEFT JOIN js ON js.case_id=c.conv_id*1000+c.turn AND js.item=b.item_id),
jr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item) AS rank FROM al)"""


def jaccard_ranking(spark, sf, k):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.posexplode(F.split("text", r"\. ")).alias("text_no", "s"))
    case_tokens = c.select("case_id", F.explode(X.word_set(F.col("text"))).alias("token"))
    bank_tokens = b.select("item", "text_no", F.explode(X.word_set(F.col("s"))).alias("token"))
    return jaccard_top_k(case_tokens, bank_tokens, c.select("case_id"), b.select("item").distinct(), k)


@query("q_j4_jaccard", f"WITH {JACCARD_SQL} SELECT case_id, item, round(score,6) AS score, rank FROM jr WHERE rank<=10")
def jaccard(spark, sf):
    j = jaccard_ranking(spark, sf, 10)
    return rounded(j.select("case_id", "item", "score", F.col("rank").cast("bigint").alias("rank")), "score")


@query("q_j6_picks", r"""
WITH u AS (SELECT page_id, unnest(regexp_extract_all(html,'\d+')) AS s, generate_subscripts(regexp_extract_all(html,'\d+'),1) AS i FROM pages),
n AS (SELECT page_id, TRY_CAST(s AS BIGINT)-1 AS k, min(i) AS i FROM u GROUP BY 1,2),
g AS (SELECT page_id, string_agg(CAST(k AS VARCHAR),',' ORDER BY i) AS picks FROM n WHERE k>=0 AND k<60 GROUP BY 1)
SELECT p.page_id, coalesce(picks,'') AS picks FROM pages p LEFT JOIN g USING (page_id)""")
def picks(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(X.ranked_picks(F.col("html"), 60).cast("array<string>"), ",").alias("picks"))


FALLBACK = ["bed", "stove"]
_POOLS = f"""{_RANKED},
pn AS (SELECT room, item, bool_or(wrong_) AS w, bool_or(rank<=3) AS s FROM it GROUP BY 1,2),
p0 AS (SELECT room, list_sort(list(item) FILTER (WHERE w)) AS wp, list_sort(list(item) FILTER (WHERE s)) AS sp FROM pn GROUP BY 1),
p1 AS (SELECT room, coalesce(wp,['bed','stove']) AS wrong_pool, coalesce(sp,wp,['bed','stove']) AS screen_pool FROM p0)"""


def _pools(spark, sf):
    return error_pools(_items(spark, sf), ["room"], "item", FALLBACK)


@query("q_j8_pools", sql(f"""WITH {_POOLS}, n AS (SELECT room, 'wrong' AS pool, unnest(wrong_pool) AS item FROM p1 UNION ALL SELECT room, 'screen', unnest(screen_pool) FROM p1)
SELECT room, pool, row_number() OVER (PARTITION BY room, pool ORDER BY item)-1 AS place, item FROM n""", "rl", "rv"))
def pools(spark, sf):
    return _pools(spark, sf)


ROOMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("q_j7_noise", sql(f"""WITH {_POOLS},
bk AS (SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN [p_name] ELSE [split_part(p_name,' ',2), p_name] END AS objects,
  ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][c_custkey%5+1] AS room FROM customer JOIN part ON p_partkey=c_custkey),
cs AS (SELECT bk.id, objects, condition, CASE condition WHEN 'wrong_label' THEN wrong_pool WHEN 'wrong_pick' THEN screen_pool END AS pool FROM bk JOIN p1 USING (room), (VALUES ('clean'),('partial'),('wrong_label'),('wrong_pick')) v(condition)),
fr_ AS (SELECT *, list_sort(list_distinct(list_filter(pool, lambda x: NOT list_contains(objects,x)))) AS free FROM cs),
pk AS (SELECT *, CAST(('0x'||substring(md5('0:'||id||':'||condition),1,8)) AS BIGINT) % greatest(len(free),1) AS pick FROM fr_)
SELECT id||':'||condition AS case_id, array_to_string(CASE WHEN condition='partial' THEN objects[1:1] WHEN condition LIKE 'wrong%' AND len(free)>0 THEN list_concat(objects[1:len(objects)-1],[free[pick+1]]) ELSE objects END,'|') AS objects_shown,
 CAST(CASE WHEN condition LIKE 'wrong%' AND len(free)>0 THEN len(objects)-1 END AS INT) AS swapped_index, condition IN ('clean','partial') OR len(objects)>1 AS recoverable FROM pk""", "rl", "rv"))
def noise(spark, sf):
    name = F.col("p_name")
    bank = table(spark, sf, "customer").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(name)).otherwise(F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), name)).alias("objects"),
        F.get(F.array(*[F.lit(r) for r in ROOMS]), (F.col("c_custkey") % 5).cast("int")).alias("room"),
    )
    cases = noise_cases(bank, _pools(spark, sf), ["room"], "item")
    return cases.select("case_id", F.array_join("objects_shown", "|").alias("objects_shown"), "swapped_index", "recoverable")


@query("q_h3_stratified", """
SELECT doc_id, source, draw FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:'||doc_id), doc_id) AS draw FROM documents) WHERE draw<=10""")
def stratified(spark, sf):
    s = S.stratified(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 10)
    return s.withColumn("draw", F.col("draw").cast("bigint"))


@query("q_h4_roundrobin", """
SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 70""")
def round_robin(spark, sf):
    s = S.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 70)
    return s.withColumn("turn", F.col("turn").cast("bigint"))


@query("q_h2_ordered", """
SELECT 'P_'||user_id AS participant, count(*) AS n, min(user_id) AS number FROM events GROUP BY 1 ORDER BY number""")
def ordered(spark, sf):
    p = table(spark, sf, "events").select(F.concat(F.lit("P_"), F.col("user_id").cast("string")).alias("participant"))
    g = p.groupBy("participant").agg(F.count(F.lit(1)).alias("n")).withColumn("number", S.natural_number(F.col("participant")))
    return g.orderBy("number")


# Classes of the first-match role in priority order.
CLASSES = [("bathroom", [0, 6]), ("bedroom", [1]), ("kitchen", [2, 3]), ("living room", [4])]


@query("q_b24_first_match", sql("""
SELECT unit, CASE WHEN list_has_any(pos,[0,6]) THEN 'bathroom' WHEN list_has_any(pos,[1]) THEN 'bedroom' WHEN list_has_any(pos,[2,3]) THEN 'kitchen' WHEN list_has_any(pos,[4]) THEN 'living room' END AS class,
 len(list_intersect(list_concat(pos,neg),[0,1,2,3,4,5]))>=3 AS eligible FROM rv""", "rv"))
def first_match(spark, sf):
    hits = F.size(F.array_intersect(F.array_union("pos", "neg"), F.array(*[F.lit(i) for i in range(6)])))
    return unit_truth(spark, sf).select("unit", first_class(F.col("pos"), CLASSES).alias("class"), (hits >= 3).alias("eligible"))
