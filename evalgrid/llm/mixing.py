"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects target / size copies. Documents are laid in order of size, the
expected copies are summed up from one random offset, and a document is emitted once for each
whole number its own stretch of that sum crosses: between 0 and 2 times, never more. Because
neighbours are alike in size, what one document takes too much the next gives back; of `DRAWS`
offsets the one whose words come nearest to the target is used.

Places in the order are found without sorting a source in one task: rows are dealt by range over
(source, size, hash of the id), each range counts its rows, and ranges are added up per source.

Defined results: null text has size 0; null source is a source of its own, the last; documents of
size 0 take nothing; equal rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import keyed_rows, null_last, row_key, word_count
from evalgrid.session import cut_lineage

WEIGHTS = [3, 1, 2]
SHARE = 1.5
MOST = 2
DRAWS = 32


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds `target` to one row per source (source_key, source_size): shares by weight, none above
    MOST times its size. Sources are limited once by level = size limit / weight, in that order, so
    one running sum finds the sources that stop and the common level of the others.

    All sources meet in one task: meant for up to 10^6 distinct sources (more: not measured)."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy("source_key"))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (place - 1) % len(WEIGHTS) + 1))
    w = w.withColumn("most", MOST * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    left = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(order), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    w = w.withColumn("stops", F.col("most") / F.col("weight") <= left / rest)
    free = SHARE * F.sum("source_size").over(whole) - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(whole)
    over = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(whole)
    return w.withColumn("target", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * free / over)).select("source_key", "source_size", "target")


def _offset(seed: int, draw: Column | int) -> Column:
    """The draw's offset of a source in [0, 1), from the first 32 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.lit(draw).cast("string"), F.lit("|"), F.col("source_key")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def _copies(offset: Column) -> Column:
    """Whole numbers crossed by the stretch from place - 1 to place."""
    at = lambda place: F.floor(offset + place * F.col("rate"))
    return (at(F.col("place")) - at(F.col("place") - 1)).cast("long")


def _placed(sized: DataFrame) -> DataFrame:
    """Adds `place` (from 1) of each row in its source, in order of (size, hash, id). The ranges are
    written, so their numbers are facts and not recomputed."""
    order = ["size", "order_hash", "doc_id", *[c for c in sized.columns if c.startswith("_k")]]
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(sized.repartitionByRange(parts, "source_key", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("source_key", "part").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_key", "part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source_key", "part").orderBy(*order))
    return dealt.join(before, ["source_key", "part"]).withColumn("place", F.col("before") + inner).drop("before", "part", "order_hash")


def sampled(docs: DataFrame, keep: list[Column] | None = None, seed: int = 42, draws: int = DRAWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per document, and `keep` columns."""
    keep = keep or []
    sized = docs.select("doc_id", "source", null_last(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order_hash"), *keep)
    placed = _placed(sized)
    totals = placed.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(totals))
    rated = placed.join(targets, "source_key").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = cut_lineage(rated)
    tried = rated.groupBy("source_key").agg(F.max("target").alias("target"), *[F.sum(F.col("size") * _copies(_offset(seed, d))).alias(f"t{d}") for d in range(draws)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{d}") - F.col("target")).alias("off"), F.lit(d).alias("draw")) for d in range(draws)]))["draw"]
    chosen = tried.select("source_key", best.alias("draw"))
    out = rated.join(chosen, "source_key").withColumn("copies", _copies(_offset(seed, F.col("draw"))))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("source_key", "place", "rate", "draw")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row as often as it is taken, all columns as they came. Copies of
    equal rows are summed and dealt out from one of them."""
    wanted = sampled(docs, row_key(docs)).groupBy("_k1", "_k2").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    one = keyed_rows(docs).join(wanted, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return one.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_row.*")
