"""Blinded audit: sheet and key, human precision, agreement, progress of the raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.draws import md5_rank
from evalgrid.functions.scores import rate
from evalgrid.functions.text import norm_item
from evalgrid.operators.skew import top_per_key

# Generic place words left out in the sensitivity table, cut-offs of the audit.
GENERIC = [
    "area", "object", "room", "bathroom", "bedroom", "kitchen", "living room", "dining room",
    "restaurant", "furniture", "group of people", "hotel room", "sitting room", "scene", "space",
]
AUDIT_KS = [3, 6]


def clean_rating(c: Column) -> Column:
    """Trimmed upper-case answer, null when empty."""
    return F.nullif(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def audit_entries(ranked: DataFrame, depth: int = 6) -> DataFrame:
    """Top `depth` items of the sampled units' lists, with their normalised form; empty ones drop out."""
    top = ranked.where(F.col("rank") <= depth)
    return top.withColumn("item_norm", norm_item(F.col("item"))).where(F.col("item_norm") != "")


def audit_sheet(entries: DataFrame, unit: str, seed: int = 0) -> DataFrame:
    """Distinct (unit, item) in a seeded shuffle with uids U0000, ...; no method column.

    The window runs over the sampled units' items only (units x methods x depth rows).
    """
    uniq = entries.select(unit, "item_norm").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(md5_rank(seed, F.col(unit), F.col("item_norm")), unit, "item_norm")
    return uniq.select(F.concat(F.lit("U"), F.lpad((F.row_number().over(order) - 1).cast("string"), 4, "0")).alias("item_uid"), unit, "item_norm")


def method_codes(methods: DataFrame, seed: int = 0) -> DataFrame:
    """(method, method_code): codes M1, ... in hash order of the method names."""
    order = Window.partitionBy(F.lit(0)).orderBy(md5_rank(seed, F.col("method")), "method")
    return methods.select("method").distinct().select("method", F.concat(F.lit("M"), F.row_number().over(order).cast("string")).alias("method_code"))


def audit_key(entries: DataFrame, sheet: DataFrame, codes: DataFrame, unit: str) -> DataFrame:
    """Private table: which method named which sheet item at which rank, under its code."""
    return entries.join(sheet, [unit, "item_norm"]).join(codes, "method").select("item_uid", unit, "item", "method_code", "rank")


def unblind(key: DataFrame, codes: DataFrame) -> DataFrame:
    """Code -> method; an unknown code fails the job instead of dropping rows."""
    j = key.join(codes, "method_code", "left")
    known = F.when(F.col("method").isNotNull(), F.col("method")).otherwise(F.raise_error(F.concat(F.lit("unknown method code "), F.col("method_code"))).cast("string"))
    return j.withColumn("method", known)


def rated_items(key: DataFrame, ratings: DataFrame) -> DataFrame:
    """Key rows with their ratings: in_photo = D is Y, useful = both are Y."""
    j = key.join(ratings.select("item_uid", "D", "E"), "item_uid", "left")
    yes_d, yes_e = (F.coalesce(F.col(c) == "Y", F.lit(False)) for c in ("D", "E"))
    return j.withColumn("in_photo", yes_d).withColumn("useful", yes_d & yes_e)


def drop_generic(rated: DataFrame, unit: str) -> DataFrame:
    """Without generic place words; ranks close up. Only the deepest cut-off's ranks are needed."""
    kept = rated.where(~F.lower("item").isin(GENERIC)).withColumnRenamed("rank", "_old")
    return top_per_key(kept, ["method", unit], [F.col("_old")], max(AUDIT_KS))


def human_metrics(rated: DataFrame, unit: str, ks: Sequence[int] = AUDIT_KS) -> DataFrame:
    """Per (method, unit, k): human precision and usefulness over K (short lists are penalised)
    and whether anything was in the photo / useful."""
    cut = F.array(*[F.lit(k) for k in ks])
    top = rated.select("method", unit, "in_photo", "useful", "rank", F.explode(cut).alias("k")).where(F.col("rank") <= F.col("k"))
    g = top.groupBy("method", unit, "k").agg(F.count_if("in_photo").alias("_p"), F.count_if("useful").alias("_u"))
    return g.select(
        "method", unit, "k", (F.col("_p") / F.col("k")).alias("human_precision"), (F.col("_u") / F.col("k")).alias("useful"),
        (F.col("_p") > 0).cast("double").alias("human_hit"), (F.col("_u") > 0).cast("double").alias("useful_hit"),
    )


def join_raters(raters: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """One row per pair (first rater, another) and item that both rated: pair ("1 vs i"), key, and
    each column once per side with suffixes _1 and _2. Raters are tables of their own."""
    first = raters[0].select(key, *[F.col(c).alias(f"{c}_1") for c in columns])
    out = None
    for i, other in enumerate(raters[1:], start=2):
        pair = first.join(other.select(key, *[F.col(c).alias(f"{c}_2") for c in columns]), key).withColumn("pair", F.lit(f"1 vs {i}"))
        out = pair if out is None else out.unionByName(pair)
    if out is None:
        raise ValueError("two raters at least")
    return out.select("pair", key, *[f"{c}_{s}" for c in columns for s in (1, 2)])


def rater_agreement(raters: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """(pair, column, n, raw_agreement, kappa) of the first rater with each other one."""
    both = join_raters(raters, key, columns)
    long = both.select("pair", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_1").alias("x"), F.col(f"{c}_2").alias("y")) for c in columns])))
    return cohens_kappa(long, ["pair", "column"], "x", "y")


def cohens_kappa(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Raw agreement and kappa over pairs without nulls; null kappa where chance agreement is 1.

    Everything follows from the contingency table, which has one row per label pair.
    """
    table = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    side = F.array(
        F.struct(F.col("_x").alias("label"), F.col("_c").alias("nx"), F.lit(0).cast("bigint").alias("ny")),
        F.struct(F.col("_y").alias("label"), F.lit(0).cast("bigint").alias("nx"), F.col("_c").alias("ny")),
    )
    margin = table.select(*keys, F.inline(side)).groupBy(*keys, "label").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"))
    chance = margin.groupBy(*keys).agg((F.sum(F.col("nx").cast("double") * F.col("ny"))).alias("_xy"))
    same = table.groupBy(*keys).agg(F.sum("_c").alias("n"), F.coalesce(F.sum(F.when(F.col("_x") == F.col("_y"), F.col("_c"))), F.lit(0)).alias("_same"))
    j = same.join(chance, list(keys))
    po = F.col("_same") / F.col("n")
    pe = F.col("_xy") / (F.col("n").cast("double") * F.col("n"))
    return j.select(*keys, "n", po.alias("raw_agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def review_changes(both: DataFrame) -> DataFrame:
    """Per method and ALL: in-photo answers changed between passes, and usefulness changed where
    both passes said Y. Columns D_p, E_p, D_o, E_o."""
    d_changed = ~F.col("D_p").eqNullSafe(F.col("D_o"))
    both_y = F.coalesce((F.col("D_p") == "Y") & (F.col("D_o") == "Y"), F.lit(False))
    g = both.rollup("method").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(d_changed).alias("in_photo_changed"), F.count_if(both_y).alias("useful_compared"),
        F.count_if(both_y & ~F.col("E_p").eqNullSafe(F.col("E_o"))).alias("useful_changed"), F.grouping("method").alias("_all"),
    )
    pct = 100 * F.col("in_photo_changed") / F.greatest(F.col("items"), F.lit(1))
    return g.withColumn("method", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("method"))).withColumn("in_photo_changed_pct", pct).drop("_all")


def first_status(auto: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One automatic status per key: the first one recorded."""
    return auto.groupBy(*keys).agg(F.min_by("status", seq).alias("status"))


def labels_vs_human(judged: DataFrame) -> DataFrame:
    """Per method: agreement of automatic labels with people, both kinds of disagreement, and what
    people said about unverifiable items. Columns method, status, in_photo, useful."""
    s, p = F.col("status"), F.col("in_photo")
    ver = F.coalesce(s.isin("correct", "wrong"), F.lit(False))
    unv = F.coalesce(s == "unverifiable", F.lit(False))
    agree = ver & (p == (s == "correct"))
    return judged.groupBy("method").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(ver).alias("label_verdict"), rate(F.count_if(agree), F.count_if(ver)).alias("agreement"),
        F.count_if((s == "correct") & ~p).alias("label_correct_human_n"), F.count_if((s == "wrong") & p).alias("label_wrong_human_y"),
        F.count_if(unv).alias("unverifiable_items"), rate(F.count_if(unv & p), F.count_if(unv)).alias("unverifiable_in_photo"),
        rate(F.count_if(unv & F.col("useful")), F.count_if(unv)).alias("unverifiable_useful"),
    )


def rating_progress(rows: DataFrame, unit: str) -> DataFrame:
    """Counts a rater fixes before handing in: filled, finished, missing and contradictory answers,
    units fully answered. Unit counts are taken from per-unit sums."""
    d, e = F.col("D"), F.col("E")
    per = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(d.isin("Y", "N")).alias("d_filled"), F.count_if(d == "Y").alias("d_yes"),
        F.count_if((d == "Y") & e.isin("Y", "N")).alias("e_filled"), F.count_if((d == "N") & e.isNotNull()).alias("e_without_d"), F.count_if(d.isNull()).alias("d_empty"),
    )
    s = per.agg(*[F.sum(c).alias(c) for c in ("items", "d_filled", "d_yes", "e_filled", "e_without_d", "d_empty")], F.count_if(F.col("d_empty") == 0).alias("units_done"))
    finished = F.col("d_filled") - F.col("d_yes") + F.col("e_filled")
    return s.select(
        "items", "d_filled", "d_yes", "e_filled", finished.alias("rows_finished"), rate(finished, F.col("items")).alias("share_complete"), "d_empty",
        (F.col("d_yes") - F.col("e_filled")).alias("e_missing"), "e_without_d", "units_done",
    )


def generation_sheet(texts: DataFrame, top1: DataFrame, bank: DataFrame) -> DataFrame:
    """Generated text beside the reference and the bank item it was mapped to.

    texts: case_id, gold, text; top1: case_id, item (best match); bank: item, utterance.
    """
    ref = texts.join(bank.select(F.col("item").alias("gold"), F.col("utterance").alias("reference")), "gold", "left")
    j = ref.join(top1.select("case_id", "item"), "case_id", "left")
    j = j.join(bank.select("item", F.col("utterance").alias("mapped_to")), "item", "left")
    return j.withColumn("auto_correct", F.coalesce(F.col("item") == F.col("gold"), F.lit(False)))
