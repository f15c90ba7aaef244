import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalgrid.functions.draws import add_hash, poisson_thresholds, poisson_weights
from evalgrid.operators import resample as R


def units(spark, cells):
    return spark.createDataFrame([(c, i, float(v)) for c, vs in cells.items() for i, v in enumerate(vs)], "cell string, unit int, v double")


def test_degenerate_cells(spark):
    d = units(spark, {"same": [0.4] * 10, "one": [0.7]})
    rows = {r["cell"]: r for r in R.bootstrap_ci(d, ["cell"], "unit", "v", 200).collect()}
    assert (rows["same"]["ci_lo"], rows["same"]["ci_hi"]) == (pytest.approx(0.4), pytest.approx(0.4))
    assert rows["one"]["n"] == 1 and rows["one"]["ci_lo"] is None
    b = {r["cell"]: r for r in R.bca_ci(d, ["cell"], "unit", "v", 200).collect()}
    assert (b["same"]["ci_lo"], b["same"]["ci_hi"]) == (pytest.approx(0.4), pytest.approx(0.4))


def test_missing_values_are_dropped(spark):
    d = units(spark, {"a": [1, 2, 3]}).unionByName(spark.createDataFrame([("a", 9, float("nan")), ("a", 8, None)], "cell string, unit int, v double"))
    r = R.bootstrap_ci(d, ["cell"], "unit", "v", 100).first()
    assert r["n"] == 3 and r["estimate"] == 2.0


def test_width_matches_theory_at_every_size(spark):
    rnd = random.Random(7)
    for n in (400, 4000):
        d = units(spark, {"x": [rnd.gauss(5, 2) for _ in range(n)], "rate": [float(rnd.random() < 0.3) for _ in range(n)]})
        for r in R.bootstrap_ci(d, ["cell"], "unit", "v", 2000).collect():
            sd = d.where(F.col("cell") == r["cell"]).agg(F.stddev("v")).first()[0]
            assert r["ci_hi"] - r["ci_lo"] == pytest.approx(2 * 1.96 * sd / n**0.5, rel=0.12)
            assert r["ci_lo"] < r["estimate"] < r["ci_hi"]


def test_replicates_do_not_depend_on_partitioning_or_cells_held(spark, monkeypatch):
    rnd = random.Random(3)
    d = units(spark, {c: [rnd.gauss(0, 1) for _ in range(30)] for c in "abcdefgh"}).union(units(spark, {None: [1, 2, 3]}))
    plain = {(r["cell"], r["_rep"]): (r["s"], r["w"], r["n"]) for r in R.replicate_sums(d, ["cell"], "unit", "v", 700).collect()}
    assert len(plain) == 9 * 700 and not [n for n in dir(R) if "LIMIT" in n]
    monkeypatch.setattr(R, "HELD", 2)
    for parts in (1, 7):
        got = {(r["cell"], r["_rep"]): (r["s"], r["w"], r["n"]) for r in R.replicate_sums(d.repartition(parts), ["cell"], "unit", "v", 700).collect()}
        assert got.keys() == plain.keys() and all(g == pytest.approx(plain[k]) for k, g in got.items())


def test_weights_are_poisson_and_those_of_the_sql_hash(spark):
    w = poisson_weights(5, np.arange(2000)[None], np.arange(-100, 100)[:, None])
    share = np.bincount(w.astype(int).ravel()) / w.size
    assert share[:4] == pytest.approx([math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], abs=2e-3)
    h = add_hash(spark.range(50).withColumn("u", F.col("id") - 9), F.lit(5), F.col("id"), F.col("u"), "h").collect()
    for r in h:
        assert poisson_weights(5, np.array([r["id"]]), np.array([r["u"]]))[0] == sum(r["h"] >= t for t in poisson_thresholds())


def test_coverage(spark):
    rnd = random.Random(11)
    d = units(spark, {f"c{i}": [rnd.gauss(0, 1) for _ in range(60)] for i in range(120)})
    hit = R.bootstrap_ci(d, ["cell"], "unit", "v", 400).where("ci_lo <= 0 AND ci_hi >= 0").count()
    assert 104 <= hit <= 119  # about 95 % of 120


def test_bca_leans_with_the_skew(spark):
    rnd = random.Random(13)
    d = units(spark, {"skewed": [rnd.expovariate(1) for _ in range(40)]})
    plain, bca = R.bootstrap_ci(d, ["cell"], "unit", "v", 4000).first(), R.bca_ci(d, ["cell"], "unit", "v", 4000).first()
    assert bca["ci_lo"] > plain["ci_lo"] and bca["ci_hi"] > plain["ci_hi"]


def test_clusters_count_once(spark):
    rows = [("a", 1, 1.0)] * 1000 + [("b", 1, 0.0)]
    d = spark.createDataFrame(rows, "who string, cell int, v double")
    m = {r["who"]: r["value"] for r in R.cluster_means(d, ["cell"], "who", "v").collect()}
    assert m == {"a": 1.0, "b": 0.0}


def test_pairs_need_both_sides(spark):
    long = spark.createDataFrame([("m1", 1, "hit", 1.0), ("m2", 1, "hit", 0.0), ("m1", 2, "hit", 1.0), ("m1", 3, "hit", 0.5), ("m2", 3, "hit", None)], "method string, unit int, metric string, v double")
    pairs = spark.createDataFrame([("m1", "m2"), ("m2", "m1"), ("m1", "m9")], "a string, b string")
    d = R.paired_differences(long, pairs, "unit", ["metric"], "method", "v")
    assert sorted((r["a"], r["b"], r["unit"], r["diff"]) for r in d.collect()) == [("m1", "m2", 1, 1.0), ("m2", "m1", 1, -1.0)]


def test_strata_keep_their_sizes(spark):
    rows = [("all", s, i, m + 0.01 * (i % 2)) for s, m, n in (("x", 0.0, 10), ("y", 10.0, 30)) for i in range(n)]
    d = spark.createDataFrame(rows, "cell string, site string, unit int, v double")
    d = d.withColumn("unit", F.xxhash64("site", "unit"))
    s = R.stratified_ci(d, ["cell"], "site", "unit", "v", 300).first()
    free = R.bootstrap_ci(d, ["cell"], "unit", "v", 300).first()
    assert s["ci_hi"] - s["ci_lo"] < 0.01 < free["ci_hi"] - free["ci_lo"]  # no between-site variance
    assert s["ci_lo"] <= s["estimate"] <= s["ci_hi"]


def test_thousands_of_parts_of_one_cell_are_added_number_by_number(spark, monkeypatch):
    """Every batch of two rows hands a part on; nothing gathers a cell's parts in a Python group."""
    monkeypatch.setattr(R, "HELD", 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    d = spark.createDataFrame([("hot", i, float(i % 17)) for i in range(6000)] + [("cold", i, 1.0) for i in range(3)], "cell string, u bigint, v double").repartition(8)
    spark.conf.set(key, "2")
    try:
        sums = R.replicate_sums(d, ["cell"], "u", "v", reps=20)
        assert "InPandas" not in sums._jdf.queryExecution().executedPlan().toString().replace("MapInPandas", "")
        got = {(r["cell"], r["_rep"]): (r["s"], r["w"], r["n"]) for r in sums.collect()}
    finally:
        spark.conf.set(key, before)
    w = R.poisson_weights(0, np.arange(20)[None, :], np.arange(6000)[:, None])
    x = np.arange(6000) % 17
    assert len(got) == 40
    for rep in range(20):
        assert got["hot", rep] == (float(x @ w[:, rep]), float(w[:, rep].sum()), 6000)


def test_a_unit_is_drawn_once_for_all_its_cells(spark, monkeypatch):
    """Units come in the order of their names after being written, and a task draws for each once."""
    drawn, draw = [], R.poisson_weights
    monkeypatch.setattr(R, "poisson_weights", lambda seed, rep, slot, room: drawn.append(slot.size) or draw(seed, rep, slot, room))
    rows = pd.DataFrame([(c, u, float(u % 5), 0) for u in range(100) for c in "abcdefghi"], columns=["cell", "_u", "_v", "_seed"])
    parts = pd.concat(R.weighted_sums(iter([rows]), ["cell"], 300, 1000))
    assert sum(drawn) == 100 and sorted(parts["cell"].unique()) == list("abcdefghi") and set(parts["n"]) == {100}
    w = draw(0, np.arange(300)[None, :], np.arange(100)[:, None])
    assert np.allclose(np.concatenate(parts[parts["cell"] == "c"].sort_values("_block")["s"].to_list()), (np.arange(100) % 5) @ w)
    d = spark.createDataFrame([(c, u, 1.0) for c in "abc" for u in range(200)], "cell string, unit int, v double").repartition(7)
    written = R._by_unit(d, ["cell"], "unit", "v").select("unit", F.input_file_name().alias("file")).distinct()
    assert written.count() == 200
