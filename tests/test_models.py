import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from evalgrid.operators import models as M


def rows(n=300, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rnd.gauss(100, 5), rnd.random()
        out.append((f"g{i % 6}", i, a, b, 3 + 0.5 * a - 2 * b + rnd.gauss(0, 0.3)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "g string, id int, a double, b double, y double")


def ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / s
    return beta, y.mean() - beta @ m


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_folds_equal_refits(spark, alpha):
    data = rows()
    d = frame(spark, data)
    fits = {(r["g"], r["feature_set"]): r for r in M.fit_folds(d, "g", ["a", "b"], "y", {"both": ["a", "b"], "b": ["b"]}, alpha).collect()}
    assert len(fits) == 12
    for g in ("g0", "g5"):
        tr = np.array([r[2:] for r in data if r[0] != g])
        coef, icept = ridge(tr[:, :2], tr[:, 2], alpha)
        assert fits[g, "both"]["coef"] == pytest.approx(list(coef)) and fits[g, "both"]["intercept"] == pytest.approx(icept)
        coef, icept = ridge(tr[:, 1:2], tr[:, 2], alpha)
        assert fits[g, "b"]["coef"] == pytest.approx([0.0, *coef]) and fits[g, "b"]["intercept"] == pytest.approx(icept)


def test_predictions_stay_out_of_fold_and_null(spark):
    data = rows() + [("g0", 999, None, 0.5, 1.0)]
    d = frame(spark, data)
    p = {r["id"]: r["prediction"] for r in M.predict(d, M.fit_folds(d, "g", ["a", "b"], "y"), "g", ["a", "b"], "id").collect()}
    tr = np.array([r[2:] for r in data if r[0] != "g0" and r[2] is not None])
    coef, icept = ridge(tr[:, :2], tr[:, 2], 0.0)
    assert p[999] is None and p[0] == pytest.approx(icept + coef @ np.array(data[0][2:4]))


def test_alpha_search_error_is_the_held_out_error(spark):
    data = rows(120)
    d = frame(spark, data)
    got = {round(r["alpha"], 6): r["mse"] for r in M.alpha_search(d, "g", ["a", "b"], "y", [0.1, 100.0]).collect()}
    for alpha, mse in got.items():
        sse = 0.0
        for g in {r[0] for r in data}:
            tr, te = (np.array([r[2:] for r in data if (r[0] == g) == own]) for own in (False, True))
            coef, icept = ridge(tr[:, :2], tr[:, 2], alpha)
            sse += ((te[:, 2] - icept - te[:, :2] @ coef) ** 2).sum()
        assert mse == pytest.approx(sse / len(data))
    assert len(M.ALPHAS) == 13 and got[0.1] < got[100.0]


def test_group_folds(spark):
    sizes = {"big": 50, "mid": 20, "a": 10, "b": 10, "c": 9, "d": 1}
    d = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    for parts in (1, 9):
        folds = {r["g"]: r["fold"] for r in M.group_folds(d.repartition(parts), "g", 3).collect()}
        assert folds == {"big": 0, "mid": 1, "a": 2, "b": 2, "c": 1, "d": 0}
    assert len({r["fold"] for r in M.group_folds(d.where("g in ('a', 'b')"), "g", 10).collect()}) == 2


def test_line_fit_directions(spark):
    rnd = random.Random(3)
    data = []
    for i in range(2000):
        t = rnd.random()
        data.append(("s", t, 0.5 * t + 0.2 + rnd.gauss(0, 0.15)))
    d = spark.createDataFrame(data + [("flat", x / 10, 0.5) for x in range(10)], "s string, target double, pred double")
    f = {r["s"]: r for r in M.line_fits(d, ["s"], "pred", "target").collect()}
    assert f["s"]["a"] == pytest.approx(2.0, rel=0.08) and f["s"]["b"] == pytest.approx(-0.4, abs=0.06)
    assert f["s"]["a_wrong"] < 1.2  # diluted by the noise of the prediction
    assert f["flat"]["a"] is None


def test_signal_to_noise_and_ranks(spark):
    d = spark.createDataFrame([("s", float(t), t + e) for t in (0, 1, 2) for e in (-0.1, 0.1)], "s string, target double, v double")
    r = M.signal_to_noise(d, ["s"], "target", "v").first()
    assert r["snr"] == pytest.approx(2 / (0.1 * 2 ** 0.5)) and r["snr_verdict"] == "workable" and r["r_verdict"] == "usable"
    q = spark.createDataFrame([("k", x, y) for x, y in ((1.0, 10.0), (2.0, 20.0), (2.0, 15.0), (9.0, 400.0))], "k string, x double, y double")
    assert {r["x"]: r["r"] for r in M.average_ranks(q, ["k"], "x", "r").collect()} == {1.0: 1.0, 2.0: 2.5, 9.0: 4.0}
    assert M.rank_correlation(q, ["k"], "x", "y").first()["spearman"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1])


def pava(x, y):
    """Isotonic fit by its min-max formula."""
    order = sorted(zip(x, y))
    ys = [b for _, b in order]
    n = len(ys)
    return [a for a, _ in order], [max(min(np.mean(ys[i:j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


@pytest.mark.parametrize("slot_rows", [4, 5, 17, 1000])
def test_isotonic_in_slots_is_exact(spark, slot_rows):
    rnd = random.Random(9)
    x = [rnd.random() for _ in range(60)]
    y = [v + rnd.gauss(0, 0.3) for v in x]
    d = spark.createDataFrame([("s", *p) for p in zip(x, y)], "s string, x double, y double")
    blocks = M.isotonic_blocks(d, ["s"], "x", "y", slot_rows).collect()
    xs, want = pava(x, y)
    for a, w in zip(xs, want):
        level = next(b["level"] for b in blocks if b["x_lo"] <= a <= b["x_hi"])
        assert level == pytest.approx(w)


def test_isotonic_slots_on_rising_and_falling_keys(spark):
    """A rising key keeps all its points, a falling one is one block, a null key is a key."""
    rows = [("up", float(i), float(i)) for i in range(40)] + [("down", float(i), -float(i)) for i in range(40)] + [(None, 1.0, 2.0), (None, 1.0, 4.0)]
    rows += [("late", float(i), float(i)) for i in range(40)] + [("late", 40.0, -1000.0), ("far", 0.0, 1.0), ("far", 1e12, 0.0)]
    d = spark.createDataFrame(rows, "s string, x double, y double")
    got = {}
    for r in M.isotonic_blocks(d, ["s"], "x", "y", 4).collect():
        got.setdefault(r["s"], []).append((r["x_lo"], r["x_hi"], round(r["level"], 9), r["weight"]))
    assert sorted(got["up"]) == [(float(i), float(i), float(i), 1.0) for i in range(40)]
    assert got["down"] == [(0.0, 39.0, -19.5, 40.0)] and got[None] == [(1.0, 1.0, 3.0, 2.0)] and got["far"] == [(0.0, 1e12, 0.5, 2.0)]
    assert got["late"] == [(0.0, 40.0, round((780 - 1000) / 41, 9), 41.0)]
    assert M.isotonic_blocks(d.limit(0), ["s"], "x", "y").count() == 0


def test_ranks_with_a_far_outlier(spark):
    rows = [("k", float(v)) for v in range(500)] + [("k", 1e12), ("k", 7.0), (None, 3.0)]
    d = spark.createDataFrame(rows, "k string, x double")
    got = {(r["k"], r["x"]): r["r"] for r in M.average_ranks(d, ["k"], "x", "r").collect()}
    assert got["k", 6.0] == 7.0 and got["k", 7.0] == 8.5 and got["k", 8.0] == 10.0 and got["k", 1e12] == 502.0 and got[None, 3.0] == 1.0


def test_interpolation_clamps(spark):
    d = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.25, 0.5, 0.75, 1.0, 5.0, None)], "x double")
    d = d.withColumn("kx", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).withColumn("ky", F.array(F.lit(0.1), F.lit(0.2), F.lit(0.9)))
    got = {r["x"]: r["v"] for r in M.add_interpolated(d, "x", "kx", "ky", "v").collect()}
    assert got.pop(None) is None
    assert got == pytest.approx({x: np.interp(x, [0, 0.5, 1], [0.1, 0.2, 0.9]) for x in got})


def test_mapping_choice(spark):
    rnd = random.Random(2)
    data = []
    for s in ("bent", "few"):
        for p in (0, 1):
            for i in range(150 if s == "bent" or p == 0 else 10):
                t = rnd.random()
                data.append((s, p, i + 1000 * p, t, t ** 5 + rnd.gauss(0, 0.005)))
    d = spark.createDataFrame(data, "s string, p int, id int, target double, pred double")
    m = {r["s"]: r for r in M.pick_mapping(d, ["s"], "pred", "target", "p", 3, "id").collect()}
    assert m["bent"]["mapping"] == "isotonic" and m["bent"]["accuracy_monotone"] > m["bent"]["accuracy_line"] + 0.1
    assert len(m["bent"]["knots_x"]) == 24 and m["bent"]["accuracy_held_out"] == m["bent"]["accuracy_monotone"]
    assert m["few"]["mapping"] == "linear" and m["few"]["accuracy_held_out"] is None and m["few"]["knots_x"] is None


def test_ridge_pipeline_matches_closed_form_and_reloads(spark, tmp_path):
    data = rows(200)
    d = frame(spark, data).withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    model = M.ridge_fit(d, ["a", "b"], "y")
    x = np.array([r[2:4] for r in data])
    x[7, 0] = np.median([v for i, v in enumerate(x[:, 0]) if i != 7])
    y = np.array([r[4] for r in data])
    z = (x - x.mean(0)) / x.std(0, ddof=1)  # MLlib scales by the sample deviation
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert list(model.stages[-1].coefficients) == pytest.approx(list(beta), rel=2e-3)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(d).agg(F.sum("prediction")).first()[0] == pytest.approx(model.transform(d).agg(F.sum("prediction")).first()[0])


def test_registered_boosted_trees_do_the_whole_job(spark, monkeypatch):
    """All iterations, ten grouped folds and three features reach the operator."""
    from evalgrid.operators import boosting as B
    from evalgrid.plans import modelling as P

    seen = {}

    def fit(df, fold, features, label, rules=B.Rules()):
        seen.update(features=list(features), iterations=rules.iterations, dealt=df.select(fold).distinct().count())
        return df.withColumn("prediction", df[label])

    monkeypatch.setattr(B, "cross_predictions", fit)
    P.gbt(spark, "/root/testdata/sf0.001")
    assert seen == {"features": ["qty", "disc", "tax"], "iterations": 300, "dealt": 10}
