"""Quality rules: text statistics, and robust multivariate outliers per language and source.

Only DataFrame functions are used. Statistics come from one pass over the texts, inside each row.
The minimum-covariance-determinant estimate works on the few numbers per document: concentration
steps, each a partial aggregate of sums and products per group, with the half-sample limit read
off a histogram of distances, so a group of any size meets in no task.

Defined results: a null or empty text has no words and fails the base rules; null language or
source is a group of its own; groups below `MIN_GROUP` documents are judged by the estimate of all
documents of their language, and by that of the whole table if the language has fewer too; ties at
a limit count as inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import SPACES, keyed_rows, null_last, row_key, words
from evalgrid.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MIN_GROUP = 60
HALF = 0.75  # share of a group that the estimate concentrates on
STEPS = 4
SLICES = 16  # parts in which a group's rows meet its estimate
# 0.75-quantile of the chi-squared distribution with 5 degrees of freedom: makes distances comparable.
CHI_HALF = 6.6257
# Squared distance beyond which a document is an outlier (about six standard deviations).
CUTOFF = 36.0
# The transformed statistics and the standard deviation below which a spread is not believed:
# most clean documents have no symbol or repeat at all, so their covariance alone would be singular.
FEATURES = {"x0": 1.2, "x1": 0.05, "x2": 0.1, "x3": 0.3, "x4": 0.07}
NAMES = list(FEATURES)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _shifted(h: Column, by: int) -> Column:
    """Combine each element with the one `by` places on; shorter by `by`."""
    n = F.greatest(F.size(h) - by, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, by + 1, n), lambda a, b: F.xxhash64(a, b))


def _covered(w: Column) -> Column:
    """Words in 8-word windows that occur twice or more. Windows are compared as text; sorted with
    their places, equal ones are neighbours, and the places found are joined as intervals."""
    n = F.size(w) - WINDOW + 1
    at = F.sequence(F.lit(1), n)
    placed = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("struct<g:string,i:int>")), F.slice(placed, 1, n - 1))
    after = F.concat(F.slice(placed, 2, n - 1), F.array(F.lit(None).cast("struct<g:string,i:int>")))
    triples = F.arrays_zip(placed.alias("t"), before.alias("b"), after.alias("a"))
    again = F.filter(triples, lambda x: (x["t"]["g"] == x["b"]["g"]) | (x["t"]["g"] == x["a"]["g"]))
    places = F.array_sort(F.transform(again, lambda x: x["t"]["i"]))
    seen = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
    )
    return seen["n"]


def document_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep` and the base statistics of each document, with `base_failed`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    first = docs.select(
        *keep,
        words(F.col("text")).alias("_w"),
        lines.alias("_l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    kept = [c for c in first.columns if c not in ("_w", "_l")]
    hashed = first.select(*kept, "_w", "_l", _shifted(F.transform("_w", lambda x: F.xxhash64(x)), 1).alias("_h"))
    hashed = hashed.select(*kept, "_w", "_l", _shifted(F.col("_h"), 2).alias("_h"))
    hashed = hashed.select(*kept, "_w", "_l", _shifted(F.col("_h"), 4).alias("_h"))
    # A text without equal window hashes has no equal windows; the others are counted on the text.
    flagged = hashed.select(*kept, "_w", "_l", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_again"))
    counted = flagged.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), _covered(F.col("_w"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")).alias("x0"),
        F.log((F.col("word_chars") + 1) / n).alias("x1"),
        F.sqrt(F.col("n_symbols") / n).alias("x2"),
        F.log1p(F.col("n_dup_lines").cast("double")).alias("x3"),
        (F.col("n_repeat_words") / n).alias("x4"),
    ]


def _limit(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per key the lowest bin up to which `share` of the rows lie, from counts of bins."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    return run.where(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _start(sample: DataFrame) -> DataFrame:
    """Median and median absolute deviation of each statistic per group, as first estimate."""
    grid = 1024.0
    long = sample.select("fit", "slice", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("v")) for i, c in enumerate(NAMES)])).alias("s")).select("fit", "slice", "s.*")
    mid = _limit(long.select("fit", "f", F.round(F.col("v") * grid).cast("long").alias("bin")), ["fit", "f"], 0.5).select("fit", "f", (F.col("bin") / grid).alias("m"))
    off = long.join(_spread(mid), ["fit", "slice", "f"]).select("fit", "f", F.round(F.abs(F.col("v") - F.col("m")) * grid).cast("long").alias("bin"))
    mad = _limit(off, ["fit", "f"], 0.5).select("fit", "f", (1.4826 * F.col("bin") / grid).alias("d"))
    both = mid.join(mad, ["fit", "f"])
    pick = lambda c, i: F.max(F.when(F.col("f") == i, F.col(c)))
    floor = list(FEATURES.values())
    cols = [pick("m", i).alias(f"m{i}") for i in range(len(NAMES))]
    cols += [(pick("d", i) * pick("d", i) + floor[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i in range(len(NAMES)) for j in range(i + 1)]
    return both.groupBy("fit").agg(*cols)


def _with_cholesky(estimates: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor of each covariance, entry by entry."""
    out, p = estimates, len(NAMES)
    for j in range(p):
        for i in range(j, p):
            rest = reduce(lambda a, b: a - b, [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.col(f"c{i}_{j}"))
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.select("fit", *[f"m{i}" for i in range(p)], *[f"l{i}_{j}" for i in range(p) for j in range(i + 1)])


def _spread(per_group: DataFrame) -> DataFrame:
    """One row per group -> one per group and slice, so that a group of any share of the rows is
    joined in SLICES parts."""
    return per_group.withColumn("slice", F.explode(F.array(*[F.lit(i) for i in range(SLICES)])))


def _distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Joins each row with its group's estimate and adds the squared Mahalanobis distance d2."""
    kept = rows.columns
    out = rows.join(_spread(factors), ["fit", "slice"], "left")
    for i in range(len(NAMES)):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}_{k}") * F.col(f"z{k}") for k in range(i)], F.col(NAMES[i]) - F.col(f"m{i}"))
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    return out.select(*kept, reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(NAMES))]).alias("d2"))


def _bin() -> Column:
    return F.floor(64 * F.log(F.greatest(F.col("d2"), F.lit(1e-9)))).cast("long")


def _concentrate(sample: DataFrame, factors: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of the share of a group nearest to its estimate."""
    near = _distance(sample, factors).withColumn("bin", _bin())
    limit = _limit(near, ["fit"], HALF).withColumnRenamed("bin", "upto")
    inside = near.join(_spread(limit), ["fit", "slice"]).where(F.col("bin") <= F.col("upto"))
    p, floor = len(NAMES), list(FEATURES.values())
    sums = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(NAMES)]
    sums += [F.covar_pop(NAMES[i], NAMES[j]).alias(f"v{i}_{j}") for i in range(p) for j in range(i + 1)]
    got = inside.groupBy("fit").agg(*sums)
    cov = [(F.col(f"v{i}_{j}") + (floor[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]
    return got.select("fit", *[f"m{i}" for i in range(p)], *cov)


def _fit_groups(rows: DataFrame, min_group: int) -> DataFrame:
    """For each group the estimate it is judged by (`fit`) and those that its rows feed (`feeds`): its
    own, or if it is small that of its language, or if that is small too that of all documents."""
    sizes = rows.where(~F.col("base_failed")).groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("n"))
    own, lang, every = F.concat_ws("\x00", F.lit("g"), "lang_key", "source_key"), F.concat_ws("\x00", F.lit("l"), "lang_key"), F.lit("all")
    in_lang = Window.partitionBy("lang_key")
    sizes = sizes.withColumn("n_lang", F.sum("n").over(in_lang)).withColumn("smallest", F.min("n").over(in_lang))
    large, spoken = F.col("n") >= min_group, F.col("n_lang") >= min_group
    named = cut_lineage(sizes.withColumn("fit", F.when(large, own).when(spoken, lang).otherwise(every)))
    pooled = not named.where(F.col("fit") == "all").isEmpty()
    feeds = [F.when(large, own), F.when(spoken & (F.col("smallest") < min_group), lang), every if pooled else F.lit(None).cast("string")]
    return named.select("lang_key", "source_key", "fit", F.array_compact(F.array(*feeds)).alias("feeds"))


def outlier_verdicts(stats: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """Adds `distance` (squared, null where base rules failed) and `kept` to document statistics.

    `stats`: lang, source, the base statistics and base_failed, with any other columns, which pass
    through. Read several times: give a written table.
    """
    mine = ["lang_key", "source_key", "fit", "feeds", "slice", "d2", *NAMES]
    kept = [c for c in stats.columns if c not in mine]
    rows = stats.select(*kept, null_last(F.col("lang")).alias("lang_key"), null_last(F.col("source")).alias("source_key"), *_transformed())
    rows = rows.join(_fit_groups(rows, min_group), ["lang_key", "source_key"], "left")
    rows = rows.withColumn("slice", F.pmod(F.hash(*NAMES), F.lit(SLICES)))
    sample = cut_lineage(rows.where(~F.col("base_failed")).select(F.explode("feeds").alias("fit"), "slice", *NAMES))
    rows = rows.drop("feeds")
    factors = cut_lineage(_with_cholesky(_start(sample)))
    for _ in range(STEPS):
        factors = cut_lineage(_with_cholesky(_concentrate(sample, factors)))
    # Distances inside the nearest share are scaled to what a normal group would show there.
    scale = _limit(_distance(sample, factors).withColumn("bin", _bin()), ["fit"], HALF).select("fit", (CHI_HALF / F.exp((F.col("bin") + 1) / 64.0)).alias("scale"))
    judged = _distance(rows, factors).join(_spread(cut_lineage(scale)), ["fit", "slice"], "left")
    distance = F.when(~F.col("base_failed"), F.col("d2") * F.least(F.col("scale"), F.lit(1.0)))
    return judged.select(*kept, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"))


def judge(docs: DataFrame, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept for each document."""
    stats = cut_lineage(document_statistics(docs, [F.col("doc_id"), F.col("lang"), F.col("source")]))
    return outlier_verdicts(stats, min_group, cutoff).select("doc_id", *BASE, "base_failed", "kept", "distance")


def drop_outliers(docs: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they came. Rejected rows are found again by a key of
    128 bits, so equal rows share their verdict and ids need not be unique."""
    keys = row_key(docs)
    stats = cut_lineage(document_statistics(docs, [*keys, F.col("lang"), F.col("source")]))
    rejected = outlier_verdicts(stats).where(~F.col("kept")).select("_k1", "_k2").distinct()
    return keyed_rows(docs).join(rejected, ["_k1", "_k2"], "left_anti").select("_row.*")
