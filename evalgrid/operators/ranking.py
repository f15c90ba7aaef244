"""Ranked-list scoring: keep-first dedupe, metrics at K, summaries, popularity, rank curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.scores import lenient, rate, verdict
from evalgrid.operators.skew import attach, quantiles, top_per_key

# List length, cut-offs, rank of an object that is never named.
K_MAX = 12
KS = [3, 6, 12]
NEVER = 999


def common_units(outputs: DataFrame, unit: str = "unit", method: str = "method") -> DataFrame:
    """Units every method covered."""
    pairs = outputs.select(unit, method).distinct()
    total = outputs.select(method).distinct().agg(F.count(F.lit(1))).scalar()
    return pairs.groupBy(unit).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") == total).select(unit)


def first_mentions(lists: DataFrame, keys: Sequence[str], place: str, category: str, carry: Sequence[str], k: int = K_MAX) -> DataFrame:
    """The first k entries of each list after dropping repeats of a category; later ranks close up.

    Items without a category are all kept. One pass over the lists: both rank filters let Spark prune
    early, to k rows per list and category and to k rows per list, so a very long list stays harmless.
    Put the key first that the lists are dealt by: rows are then sorted by it first.
    """
    near = top_per_key(lists.select(*keys, category, place, *carry), [*keys, category], [F.col(place)], k, rank="_nth")
    once = near.where(F.col(category).isNull() | (F.col("_nth") == 1)).drop("_nth")
    return top_per_key(once, keys, [F.col(place)], k)


def list_lengths(lists: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Entries per list after dropping repeats of a category."""
    n = lists.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_c"))
    return n.groupBy(*keys).agg(F.sum(F.when(F.col(category).isNull(), F.col("_c")).otherwise(1)).alias("n_items"))


def group_of(category: Column, groups: Sequence[Sequence[int]]) -> Column:
    """Ids equivalent to a category, itself included."""
    out = F.array(category)
    for g in groups:
        out = F.when(category.isin(list(g)), F.array(*[F.lit(i) for i in g])).otherwise(out)
    return F.when(category.isNotNull(), out)


WORD = 62  # vocabulary entries per bit set


def _bits(vocabulary: Sequence[int]) -> list[dict[int, int]]:
    """Per BIGINT word: category -> its bit."""
    return [{c: 1 << i for i, c in enumerate(vocabulary[at : at + WORD])} for at in range(0, len(vocabulary), WORD)]


def _mask_of(category: Column, masks: dict[int, int]) -> Column:
    known = {c: m for c, m in masks.items() if m}
    if not known:
        return F.lit(0).cast("bigint")
    table = F.create_map(*[x for c, m in known.items() for x in (F.lit(c), F.lit(m).cast("bigint"))])
    return F.when(category.isNotNull(), F.coalesce(F.try_element_at(table, category), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def judged(ranked: DataFrame, truth: DataFrame, unit: str, groups, vocabulary: Sequence[int]) -> DataFrame:
    """Ranked items with status, lenient and single-source status; relevant and covered entries as
    bit sets over the vocabulary, so that the metrics stay plain hash aggregates.

    `truth` has one row per unit: pos, neg (merged sources) and pos_l, neg_l (first source only).
    """
    words = _bits(list(vocabulary))

    def union(w: dict[int, int]) -> Column:
        return F.aggregate("pos", F.lit(0).cast("bigint"), lambda acc, p: acc.bitwiseOR(_mask_of(p, w)))

    rel = [union(w).alias(f"rel{i}") for i, w in enumerate(words)]
    j = ranked.join(truth.select("*", *rel), unit)
    c = F.col("category")
    own, wide = [], []
    for i, w in enumerate(words):
        near = {k: bit for k, bit in w.items()}
        for g in groups:
            both = sum(w.get(x, 0) for x in g)
            near.update({x: both for x in g})
        own.append(_mask_of(c, w).bitwiseAND(F.col(f"rel{i}")).alias(f"own{i}"))
        wide.append(_mask_of(c, near).bitwiseAND(F.col(f"rel{i}")).alias(f"cov{i}"))
    keep = [x for x in j.columns if x not in ("pos", "neg", "pos_l", "neg_l")]
    return j.select(
        *keep, *own, *wide, verdict(c, F.col("pos"), F.col("neg")).alias("status"), lenient(c, group_of(c, groups), F.col("pos")).alias("lenient_ok"),
        verdict(c, F.col("pos_l"), F.col("neg_l")).alias("status_l"),
    )


METRICS = [
    "precision", "precision_lenient", "verifiable", "precision_single", "verifiable_single", "recall", "recall_lenient", "hit", "hit_lenient",
]


def rank_metrics(items: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), ks: Sequence[int] = KS) -> DataFrame:
    """Metrics per list and cut-off: one aggregate, cut-offs as rows.

    precision = correct / verifiable entries (null if none); verifiable = share of K, so short
    lists are penalised; recall over the relevant set (null if empty).
    """
    def n(flag: Column, k: int) -> Column:
        return F.sum((flag & (F.col("rank") <= k)).cast("bigint"))

    s, sl = F.col("status"), F.col("status_l")
    words = range(sum(c.startswith("rel") for c in items.columns))

    def reached(name: str, k: int) -> Column:
        """Vocabulary entries in the union of the first k bit sets."""
        sets = [F.bit_count(F.bit_or(F.when(F.col("rank") <= k, F.col(f"{name}{i}")))) for i in words]
        return F.coalesce(sum(sets[1:], sets[0]), F.lit(0))

    rel = reached("rel", K_MAX)
    rows = []
    for k in ks:
        right, wrong = n(s == "correct", k), n(s == "wrong", k)
        len_right, len_wrong = n(F.col("lenient_ok"), k), n((s == "wrong") & ~F.col("lenient_ok"), k)
        one_right, one_wrong = n(sl == "correct", k), n(sl == "wrong", k)
        rows.append(F.struct(
            F.lit(k).alias("k"), right.alias("correct"), wrong.alias("wrong"), rate(right, right + wrong).alias("precision"),
            rate(len_right, len_right + len_wrong).alias("precision_lenient"), ((right + wrong) / k).alias("verifiable"),
            rate(one_right, one_right + one_wrong).alias("precision_single"), ((one_right + one_wrong) / k).alias("verifiable_single"),
            rate(reached("own", k), rel).alias("recall"), rate(reached("cov", k), rel).alias("recall_lenient"),
            (right > 0).cast("double").alias("hit"), (len_right > 0).cast("double").alias("hit_lenient"),
        ))
    # carried columns depend on the unit: as grouping keys they keep the aggregate free of sorting
    g = items.groupBy(*keys, *carry).agg(F.array(*rows).alias("rows"))
    return g.select(*keys, *carry, F.inline("rows"))


def method_summary(metrics: DataFrame, lengths: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Per method and cut-off: null-skipping means with their n, pooled precision, list lengths,
    median seconds."""
    m = metrics.groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("units"), rate(F.sum("correct"), F.sum("correct") + F.sum("wrong")).alias("pooled_precision"),
        *[F.avg(c).alias(c) for c in METRICS], *[F.count(c).alias(f"{c}_n") for c in ("precision", "recall")],
    )
    ln = lengths.groupBy(*keys).agg(F.avg(F.col("n_items").cast("double")).alias("mean_items"), F.count_if(F.col("n_items") < 3).alias("short_lists"))
    first_k = metrics.groupBy(*keys, unit).agg(F.first("seconds").alias("seconds"))
    sec = quantiles(first_k, keys, "seconds", {"median_seconds": 0.5})
    return m.join(ln, list(keys)).join(sec, list(keys))


def gold_rank(ranked: DataFrame, gold: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Rank of the gold entry per list (null if absent) with top-1 / 3 / 5 flags."""
    j = ranked.join(gold, unit)
    rest = [c for c in gold.columns if c not in (unit, "gold")]
    g = j.groupBy(*keys).agg(F.min(F.when(F.col("category") == F.col("gold"), F.col("rank"))).alias("rank"), *[F.first(c).alias(c) for c in rest])
    tops = [F.coalesce(F.col("rank") <= n, F.lit(False)).cast("double").alias(f"top{n}") for n in (1, 3, 5)]
    return g.select("*", *tops)


def redensify(ranked: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    """Drop entries and close the ranks up, in the old order; lists are at most K_MAX long."""
    kept = ranked.where(keep).withColumnRenamed("rank", "_old")
    return top_per_key(kept, keys, [F.col("_old")], K_MAX).drop("_old")


def popularity_order(members: DataFrame, names: DataFrame) -> DataFrame:
    """Every vocabulary entry with its unit count and place by (-count, name).

    The window runs over the vocabulary only.
    """
    total = members.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    full = names.join(total, "category", "left").fillna({"n": 0})
    return full.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "name")))


def loo_popularity(members: DataFrame, units: DataFrame, names: DataFrame, unit: str = "unit", k: int = K_MAX) -> DataFrame:
    """Most frequent entries over the *other* units, k per unit, by (-count, name).

    Leaving a unit out lowers only its own m entries by one, so its list lies within the first
    k + m places of the overall order: no unit is crossed with the vocabulary.
    """
    order = popularity_order(members, names)
    # units meet their entries in one aggregate, and the vocabulary is the side sent to the tasks: files of
    # units are small enough for Spark to send those instead, through the driver
    asked = units.select(unit, F.lit(None).cast("int").alias("category"), F.lit(1).alias("_asked"))
    both = asked.unionByName(members.select(unit, "category", F.lit(0).alias("_asked")))
    u = both.groupBy(unit).agg(F.collect_set("category").alias("own"), F.sum("_asked").alias("_asked")).where("_asked > 0")
    known = F.when(F.col(unit).isNotNull(), F.col("own")).otherwise(F.array().cast("array<int>"))
    u = u.select(unit, known.alias("own"), F.explode(F.sequence(F.lit(1), F.col("_asked").cast("int"))).alias("_row")).drop("_row")
    cand = u.select("*", F.explode(F.sequence(F.lit(1), F.size("own") + k)).alias("place")).join(F.broadcast(order), "place")
    score = F.col("n") - F.array_contains("own", F.col("category")).cast("int")
    return top_per_key(cand.select(unit, "category", "name", score.alias("score")), [unit], [F.desc("score"), F.col("name")], k)


def rank_curve(ranked: DataFrame, present: DataFrame, order: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Rank of each present object in each method's list (NEVER if not named) and its place in
    the fixed, frequency-ordered list."""
    want = present.select("unit", "category", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    named = ranked.where(F.col("category").isNotNull()).select("unit", "method", "category", "rank")
    covered = ranked.select("unit", "method").distinct()
    j = want.join(covered, ["unit", "method"], "left_semi").join(named, ["unit", "method", "category"], "left")
    j = attach(j, order.select("category", F.col("place").alias("fixed_rank")), ["category"], ["unit", "method"])
    return j.select("unit", "method", "category", F.coalesce("rank", F.lit(NEVER)).alias("rank"), "fixed_rank")


def top_values(df: DataFrame, keys: Sequence[str], value: str, k: int = 15) -> DataFrame:
    """The k most frequent values per key as one text "name (n), ...", ties by name."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = top_per_key(counts, keys, [F.desc("n"), F.col(value)], k)
    listed = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.col(value), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))))
    return top.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s["t"]), ", ").alias("top"))
