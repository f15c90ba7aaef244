"""Grouped cross-validation and calibration.

Linear models are fitted from sufficient statistics: one aggregate per group gives every fold
(total minus own), every feature set (a sub-matrix) and every penalty, without a second pass over
the data. Only p x p matrices are solved in Python, spread over tasks by fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.scores import corr_verdict, correlation, snr_verdict
from evalgrid.functions.zones import NO_ZONE, strip_zone
from evalgrid.operators.skew import attach, join_on, quantiles, ranked, running
from evalgrid.session import cut_lineage

# Smallest usable slope, held-out rows a mapping choice needs, knots of a mapping,
# penalties searched.
MIN_SLOPE = 1e-3
MIN_HELD_OUT = 20
KNOTS = 24
ALPHAS = [10.0 ** e for e in np.linspace(-3, 3, 13)]


# ---- line fits and signal checks -------------------------------------------------------------


def line_fits(df: DataFrame, keys: Sequence[str], pred: str, target: str) -> DataFrame:
    """Both directions of a line fit. a_wrong, b_wrong: target on prediction (diluted by the noise
    of the prediction). a, b: prediction on target, inverted; null where it hardly moves."""
    both = F.col(pred).isNotNull() & F.col(target).isNotNull()
    g = df.where(both).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(pred, target).alias("_c"), F.var_pop(pred).alias("_vp"), F.var_pop(target).alias("_vt"),
        F.avg(pred).alias("_mp"), F.avg(target).alias("_mt"), F.min(pred).alias("raw_lo"), F.max(pred).alias("raw_hi"),
    )
    wrong = F.try_divide("_c", "_vp")
    forward = F.try_divide("_c", "_vt")
    usable = F.abs(forward) > MIN_SLOPE
    a = F.when(usable, 1 / forward)
    return g.select(
        *keys, "n", "raw_lo", "raw_hi", wrong.alias("a_wrong"), (F.col("_mt") - wrong * F.col("_mp")).alias("b_wrong"),
        a.alias("a"), (F.col("_mt") - a * F.col("_mp")).alias("b"),
    )


def signal_to_noise(df: DataFrame, keys: Sequence[str], target: str, value: str) -> DataFrame:
    """Range of the per-target means over the mean per-target scatter, with verdicts."""
    per = df.groupBy(*keys, target).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    snr = per.groupBy(*keys).agg((F.max("_m") - F.min("_m")).alias("signal"), F.avg("_s").alias("noise"))
    snr = snr.withColumn("snr", F.try_divide("signal", "noise"))
    r = df.groupBy(*keys).agg(correlation(value, target).alias("r"))
    j = snr.join(r, list(keys))
    return j.withColumn("snr_verdict", snr_verdict(F.col("snr"))).withColumn("r_verdict", corr_verdict(F.col("r")))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, bands: int = 64) -> DataFrame:
    """Rank of each distinct value (ties share the mean rank): counted per value, placed by bands with
    about as many values each, however far some values lie from the others. Null keys are a key."""
    keys = list(keys)
    tally = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    edges = tally.groupBy(*keys).agg(F.percentile_approx(value, [i / bands for i in range(1, bands)], 1000).alias("_edges"))
    t = join_on(tally, edges, keys).withColumn("_slot", F.size(F.filter("_edges", lambda e: e <= F.col(value))))
    t = running(t.drop("_edges"), keys, "_slot", [value], sums={"_before": "_c"})
    return t.select(*keys, value, (F.col("_before") + (F.col("_c") + 1) / 2).alias(out))


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman: Pearson correlation of average ranks."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.join(average_ranks(d, keys, x, "_rx"), [*keys, x]).join(average_ranks(d, keys, y, "_ry"), [*keys, y])
    return d.groupBy(*keys).agg(correlation("_rx", "_ry").alias("spearman"))


def thirds(df: DataFrame, keys: Sequence[str], by: str, spread_by: Sequence[str]) -> DataFrame:
    """Label rows by exact tertile edges of `by` (edges belong to the lower third)."""
    edges = quantiles(df, keys, by, {"_q1": 1 / 3, "_q2": 2 / 3})
    j = attach(df, edges, keys, spread_by, how="inner")
    third = F.when(F.col(by) <= F.col("_q1"), "smallest").when(F.col(by) <= F.col("_q2"), "middle").otherwise("largest")
    return j.withColumn("third", third).drop("_q1", "_q2")


# ---- linear models from sufficient statistics ------------------------------------------------


def gram(df: DataFrame, fold: str, features: Sequence[str], target: str) -> tuple[DataFrame, list[float]]:
    """Per fold: n and all sums of products of (features, target), centred on the overall means.

    Returns the table (fold, m ARRAY<DOUBLE>: upper triangle of [1, x..., y] products) and the
    means used, p + 1 numbers.
    """
    cols = [*features, target]
    full = df
    for c in cols:
        full = full.where(F.col(c).isNotNull())
    row = full.agg(*[F.avg(c).alias(c) for c in cols]).first()
    means = [float(row[c] or 0.0) for c in cols]
    v: list[Column] = [F.lit(1.0)] + [F.col(c).cast("double") - F.lit(m) for c, m in zip(cols, means)]
    z = full.select(fold, *[x.alias(f"_v{i}") for i, x in enumerate(v)])
    n = len(v)
    sums = [F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")) for i in range(n) for j in range(i, n)]
    return z.groupBy(fold).agg(F.array(*sums).alias("m")), means


def _others(g: DataFrame, fold: str) -> DataFrame:
    """Own statistics and those of all other folds: total minus own, one row per fold."""
    at = g.select(fold, F.posexplode("m").alias("_i", "_s"))
    total = at.groupBy("_i").agg(F.sum("_s").alias("_s"))
    packed = total.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]).alias("t")).scalar()
    return g.select(fold, F.col("m").alias("own"), packed.alias("_t")).select(fold, "own", F.zip_with("_t", "own", lambda t, o: t - o).alias("rest"))


def _square(flat: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = flat
    return m + np.triu(m, 1).T


def _ridge(m: np.ndarray, use: list[int], alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on standardised features (population scale), intercept free; m = [1, x, y] products."""
    n = m[0, 0]
    mean = m[0, 1:-1][use] / n
    ybar = m[0, -1] / n
    s = m[1:-1, 1:-1][np.ix_(use, use)] - n * np.outer(mean, mean)
    c = m[1:-1, -1][use] - n * mean * ybar
    scale = np.sqrt(np.clip(np.diag(s) / n, 0, None))
    scale[scale == 0] = 1.0
    z = s / np.outer(scale, scale) + alpha * np.eye(len(use))
    beta = np.linalg.lstsq(z, c / scale, rcond=None)[0] / scale
    coef = np.zeros(m.shape[0] - 2)
    coef[use] = beta
    return coef, float(ybar - beta @ mean)


def fit_folds(df: DataFrame, fold: str, features: Sequence[str], target: str, sets: Mapping[str, Sequence[str]] | None = None, alpha: float = 0.0) -> DataFrame:
    """(fold, feature_set, coef, intercept) trained on all other folds; coef follows `features`,
    0 where a set leaves one out."""
    sets = dict(sets or {"all": features})
    g, means = gram(df, fold, features, target)
    n = len(features) + 2
    shift = np.array(means[:-1])
    used = {name: [list(features).index(f) for f in fs] for name, fs in sets.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, rest in zip(b[fold], b["rest"]):
                m = _square(np.asarray(rest, float), n)
                if m[0, 0] < 1:
                    continue
                for name, use in used.items():
                    coef, icept = _ridge(m, use, alpha)
                    rows.append((f, name, coef.tolist(), icept - float(coef @ shift) + means[-1]))
            yield pd.DataFrame(rows, columns=[fold, "feature_set", "coef", "intercept"])

    kind = df.schema[fold].dataType.simpleString()
    return _others(g, fold).select(fold, "rest").mapInPandas(solve, f"{fold} {kind}, feature_set string, coef array<double>, intercept double")


def predict(df: DataFrame, fits: DataFrame, fold: str, features: Sequence[str], row_id: str, out: str = "prediction") -> DataFrame:
    """Apply each fold's model to its own rows; a row with a missing feature stays unanswered."""
    j = attach(df, fits, [fold], [row_id], how="inner")
    y = F.col("intercept")
    for i, f in enumerate(features):
        y = y + F.col("coef")[i] * F.col(f)
    return j.withColumn(out, y).drop("coef", "intercept")


def alpha_search(df: DataFrame, fold: str, features: Sequence[str], target: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(alpha, mse) of grouped cross-validation: the held-out error follows from the same sums."""
    g, _ = gram(df, fold, features, target)
    n = len(features) + 2

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for own, rest in zip(b["own"], b["rest"]):
                m, o = _square(np.asarray(rest, float), n), _square(np.asarray(own, float), n)
                for a in alphas:
                    coef, icept = _ridge(m, list(range(len(features))), a)
                    w = np.concatenate([[-icept], -coef, [1.0]])  # residual = w . [1, x, y]
                    rows.append((float(a), float(w @ o @ w), float(o[0, 0])))
            yield pd.DataFrame(rows, columns=["alpha", "sse", "n"])

    s = _others(g, fold).select("own", "rest").mapInPandas(score, "alpha double, sse double, n double")
    return s.groupBy("alpha").agg((F.sum("sse") / F.sum("n")).alias("mse"))


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): no group on both sides, folds balanced by rows, at most min(k, groups).

    Groups are dealt in snake order of their size (largest first, ties by name): 0, 1, .., k - 1,
    k - 1, .., 0 and so on, from their place in one distributed ranking. A null group is a group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked(sizes, [F.desc("_n"), F.col(group)], "_place")
    k = min(k, max(1, placed.count()))
    at, lap = (F.col("_place") - 1) % k, F.floor((F.col("_place") - 1) / k)
    return placed.select(group, F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


# ---- MLlib pipelines -------------------------------------------------------------------------


def ridge_fit(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> PipelineModel:
    """Median impute, standardise, ridge. MLlib halves and averages the squared loss and scales the
    penalty by the label's deviation, hence alpha x deviation / rows."""
    size = df.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[
        Imputer(inputCols=list(features), outputCols=filled, strategy="median", relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="raw_vector"),
        StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True),
        LinearRegression(featuresCol="vector", labelCol=label, regParam=alpha * size["sd"] / size["n"], elasticNetParam=0.0, standardization=False, solver="normal"),
    ]).fit(df)


# ---- monotone calibration --------------------------------------------------------------------


def _pool(x_lo, x_hi, y, w) -> list[list[float]]:
    """Pool adjacent violators over blocks in x order."""
    out: list[list[float]] = []
    for block in zip(x_lo, x_hi, y, w):
        out.append(list(map(float, block)))
        while len(out) > 1 and out[-2][2] >= out[-1][2]:
            _, hi, b, wb = out.pop()
            lo, _, a, wa = out[-1]
            out[-1] = [lo, hi, (a * wa + b * wb) / (wa + wb), wa + wb]
    return out


def isotonic_blocks(df: DataFrame, keys: Sequence[str], x: str, y: str, slot_rows: int = 50_000) -> DataFrame:
    """Monotone least-squares fit per key as blocks (keys, x_lo, x_hi, level, weight).

    Equal x are averaged in an aggregate. Points are numbered per key (running counts over bands of
    about equal size), and every `slot_rows` of them are pooled by one task. The blocks that are left
    are numbered and pooled again, with slots moved by half a slot each time, until two rounds in a row
    pool nothing: no two neighbours fall any more, which is the exact fit, whatever was pooled first.
    No task holds more than a slot, also where the points rise already. Null keys are a key.
    """
    names, cells = list(keys), 64
    value = F.col(x).cast("double")
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*names, value.alias("x_lo")).agg(F.avg(y).alias("level"), F.count(F.lit(1)).cast("double").alias("weight"))
    edges = pts.groupBy(*names).agg(F.percentile_approx("x_lo", [i / cells for i in range(1, cells)], 1000).alias("_edges"))
    banded = join_on(pts, edges, names)
    blocks = cut_lineage(banded.select(*names, F.size(F.filter("_edges", lambda e: e <= F.col("x_lo"))).alias("_band"), "x_lo", F.col("x_lo").alias("x_hi"), "level", "weight"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    columns = blocks.columns

    def pool(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("x_lo")
        out = pd.DataFrame(_pool(r["x_lo"], r["x_hi"], r["level"], r["weight"]), columns=["x_lo", "x_hi", "level", "weight"])
        out["_band"] = r["_band"].to_numpy()[np.searchsorted(r["x_lo"].to_numpy(), out["x_lo"].to_numpy())]
        for i, n in enumerate(names):
            out[n] = group[i]
        return out[columns]

    n, still, half = blocks.count(), 0, 0
    while n and still < 2:
        numbered = running(blocks, names, "_band", ["x_lo"], count="_i")
        numbered = cut_lineage(numbered.withColumn("_slot", F.floor((F.col("_i") + half) / slot_rows)))
        one = numbered.agg(F.max("_i")).first()[0] + half < slot_rows  # every key in one slot: nothing is left for a second round
        blocks = cut_lineage(numbered.groupBy(*names, "_slot").applyInPandas(pool, types))
        left = blocks.count()
        still, n, half = (still + 1 if left == n else 0), left, (slot_rows // 2 if half == 0 else 0)
        if one:
            break
    return blocks.drop("_band")


def _below(x: Column, knots_x: Column) -> Column:
    return F.size(F.filter(knots_x, lambda k: k <= x))


def _on_segment(x: Column, i: Column, knots_x: Column, knots_y: Column) -> Column:
    """Value at x, where i knots lie at or below x."""
    n = F.size(knots_x)
    x0, x1 = F.get(knots_x, i - 1), F.get(knots_x, F.least(i, n - 1))
    y0, y1 = F.get(knots_y, i - 1), F.get(knots_y, F.least(i, n - 1))
    line = F.when(x1 > x0, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(y0)
    return F.when(x.isNull(), None).when(i == 0, F.get(knots_y, F.lit(0))).when(i >= n, F.get(knots_y, n - 1)).otherwise(line)


def add_interpolated(df: DataFrame, x: str, knots_x: str, knots_y: str, out: str) -> DataFrame:
    """Piecewise-linear map through ascending knots, held beyond both ends. The knot is searched
    once per row, in a projection of its own."""
    d = df.withColumn("_i", _below(F.col(x), F.col(knots_x)))
    return d.withColumn(out, _on_segment(F.col(x), F.col("_i"), F.col(knots_x), F.col(knots_y))).drop("_i")


def add_calibrated(df: DataFrame, x: str, out: str) -> DataFrame:
    """Screen position of a raw prediction in [0, 1]: through knots_x / knots_y where the session
    has them, else along a x + b."""
    d = add_interpolated(df, x, "knots_x", "knots_y", "_m")
    y = F.when(F.col("knots_x").isNotNull(), F.col("_m")).otherwise(F.col("a") * F.col(x) + F.col("b"))
    return d.withColumn(out, F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))).drop("_m")


def isotonic_knots(blocks: DataFrame, keys: Sequence[str], knots: int = KNOTS) -> DataFrame:
    """Resample the fit to evenly spaced knots: (keys, knots_x, knots_y).

    A key's blocks are the steps of its fitted curve, packed into two arrays.
    """
    ends = F.array(F.struct(F.col("x_lo").alias("x"), F.col("level").alias("y")), F.struct(F.col("x_hi").alias("x"), F.col("level").alias("y")))
    packed = blocks.select(*keys, F.inline(ends)).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))
    packed = packed.select(*keys, F.transform("p", lambda s: s["x"]).alias("_x"), F.transform("p", lambda s: s["y"]).alias("_y"))
    lo, hi = F.element_at("_x", 1), F.element_at("_x", -1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(knots - 1)), lambda i: lo + (hi - lo) * i / (knots - 1))
    placed = F.transform(grid, lambda g: F.struct(g.alias("g"), _below(g, F.col("_x")).alias("i")))
    packed = packed.withColumn("_g", placed)
    return packed.select(
        *keys, F.transform("_g", lambda s: s["g"]).alias("knots_x"), F.transform("_g", lambda s: _on_segment(s["g"], s["i"], F.col("_x"), F.col("_y"))).alias("knots_y")
    )


def pick_mapping(frames: DataFrame, keys: Sequence[str], pred: str, target: str, held_out: str, zones: int, row_id: str) -> DataFrame:
    """Fit line and monotone map on pass 0, score both on pass 1, keep the monotone map on a tie.

    Fewer than MIN_HELD_OUT + 1 held-out rows leave the line. One row per session.
    """
    fit = frames.where(F.col(held_out) == 0)
    maps = line_fits(fit, keys, pred, target).select(*keys, "a", "b").join(isotonic_knots(isotonic_blocks(fit, keys, pred, target), keys), list(keys))
    maps = cut_lineage(maps)
    test = attach(frames.where(F.col(held_out) == 1), maps, keys, [row_id], how="inner")
    test = add_calibrated(test, pred, "_mono")
    test = add_calibrated(test.drop("knots_x", "knots_y").withColumns({k: F.lit(None).cast("array<double>") for k in ("knots_x", "knots_y")}), pred, "_line")
    truth, mono, line = strip_zone(target, zones), strip_zone("_mono", zones), strip_zone("_line", zones)
    score = test.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("held_out"), F.avg(((line == truth) & (truth != NO_ZONE)).cast("double")).alias("accuracy_line"),
        F.avg(((mono == truth) & (truth != NO_ZONE)).cast("double")).alias("accuracy_monotone"),
    )
    enough = F.coalesce(F.col("held_out") > MIN_HELD_OUT, F.lit(False))
    use_mono = enough & (F.col("accuracy_monotone") >= F.col("accuracy_line"))
    j = maps.join(score, list(keys), "left")
    return j.select(
        *keys, "a", "b", F.when(use_mono, F.col("knots_x")).alias("knots_x"), F.when(use_mono, F.col("knots_y")).alias("knots_y"), "held_out",
        "accuracy_line", "accuracy_monotone", F.when(use_mono, "isotonic").otherwise("linear").alias("mapping"),
        F.when(enough, F.when(use_mono, F.col("accuracy_monotone")).otherwise(F.col("accuracy_line"))).alias("accuracy_held_out"),
    )
