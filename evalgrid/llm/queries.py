"""The corpus queries: each operator over its whole table, with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import arc, decontaminate, hamming, langid, lm, mixing, outliers, packing, periodic, quality, simhash, toxicity, whitening
from evalgrid.llm.common import bucket_of, documents, words
from evalgrid.session import new_folder

Build = Callable[[SparkSession, str], DataFrame]


def op1_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    chain = toxicity.learn_chain(docs, labels, ~held_out)
    scored = toxicity.toxicity(docs, chain, [F.col("doc_id"), held_out.alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), bucket_of(F.col("doc_id"), 10) == 0, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = arc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_shrunk_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = quality.with_statistics(docs, [F.col("doc_id")])
    model = quality.learn(stats, labels, bucket_of(F.col("doc_id"), 5) != 0)
    scored = quality.score(stats.withColumn("held_out", bucket_of(F.col("doc_id"), 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir))


def op8_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = vectors.select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(codes, F.coalesce(F.col("id") % 100 == 0, F.lit(False)), 10)


def op9_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))


def _planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the crc32 of the id ends in 0, the words from a place on repeat their first
    few. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = F.coalesce(h % 10 == 0, F.lit(False))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), planted.alias("planted"), F.when(planted, words(F.col("text"))).alias("w"))
    n, rest = F.size("w"), F.size("w") - F.col("a")
    cut = cut.select("doc_id", "text", "w", "g", "planted", (F.col("g") % n).alias("a"))
    cut = cut.select("doc_id", "text", "w", "planted", "a", (1 + F.floor(rest / (3 + F.col("g") % 8))).alias("p"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    stretched = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int")))
    return cut.select("doc_id", F.when(F.col("planted") & (n > 0), F.array_join(stretched, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_planted_periods(documents(spark, sf_dir)), [F.col("doc_id")])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    cut = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("m")["length"], F.col("m")["period"]
    start = (-F.col("m")["col2"]).alias("start")
    return cut.select("doc_id", "n_runs", start, length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), [F.col("doc_id")])
    named = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named, (F.col("n_hit") > 0).alias("contaminated"))


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", [F.col("vec_id")])


def queries() -> dict[str, Build]:
    own = [op1_covering_simhash, op2_crf_toxicity, op3_attention_lm, op4_systematic_mix, op5_arc_to_warc]
    own += [op6_shrunk_discriminant, op7_robust_outliers, op8_multi_index_search, op9_tier_packing, op10_fused_language]
    own += [op11_periodic_runs, op12_prefix_decontamination, op13_exact_whitening]
    return {f.__name__: f for f in own}


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE('a' || source, 'b') AS source_key, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY size, h, doc_id) AS place FROM sized),
s1 AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
s2 AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source_key) - 1) % 3) + 1] AS DOUBLE) AS weight, 2 * CAST(source_size AS DOUBLE) AS most FROM s1),
s3 AS (SELECT *, 1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, sum(weight) OVER () AS all_weight,
       COALESCE(sum(most) OVER w, 0) AS most_before, COALESCE(sum(weight) OVER w, 0) AS weight_before FROM s2
       WINDOW w AS (ORDER BY most / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, most / weight <= (budget - most_before) / (all_weight - weight_before) AS stops FROM s3),
s5 AS (SELECT *, (budget - sum(CASE WHEN stops THEN most ELSE 0e0 END) OVER ()) AS free, sum(CASE WHEN stops THEN 0e0 ELSE weight END) OVER () AS over FROM s4),
targets AS (SELECT source_key, source_size, CASE WHEN stops THEN most ELSE weight * free / over END AS target FROM s5),
draws AS (SELECT source_key, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate, CAST(d AS INTEGER) AS draw,
          CAST(CAST('0x' || substr(md5('42|' || CAST(d AS VARCHAR) || '|' || source_key), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u
          FROM targets, range(32) t(d)),
tried AS (SELECT p.source_key, draw, abs(sum(size * CAST(floor(u + place * rate) - floor(u + (place - 1) * rate) AS BIGINT)) - any_value(target)) AS off
          FROM placed p JOIN draws USING (source_key) GROUP BY 1, 2),
best AS (SELECT source_key, draw FROM tried QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY off, draw) = 1)
SELECT doc_id, source, size, source_size, target, CAST(floor(u + place * rate) - floor(u + (place - 1) * rate) AS BIGINT) AS copies,
       size * CAST(floor(u + place * rate) - floor(u + (place - 1) * rate) AS BIGINT) AS taken
FROM placed JOIN draws USING (source_key) JOIN best USING (source_key, draw)
"""


OP5_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha256(COALESCE(html, '')) AS payload_digest,
                  CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to FROM o
"""

OP8_SQL = """
WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, CAST(hamming(q.bits, r.bits) AS INTEGER) AS distance FROM c q, c r WHERE q.vec_id % 100 = 0)
SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10
"""


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
found AS (SELECT r, i, size, item FROM (SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM places, (SELECT DISTINCT size FROM windows) WHERE i + size - 1 <= len(w))
          JOIN windows USING (size, win)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_systematic_mix": OP4_SQL, "op5_arc_to_warc": OP5_SQL, "op8_multi_index_search": OP8_SQL, "op12_prefix_decontamination": OP12_SQL}
