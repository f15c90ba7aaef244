import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.operators import skew as K
from evalgrid.plans import load_all
from evalgrid.plans import roles


def hot_rows(n=900, seed=2):
    """A third of all rows belong to one key."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(20)}"
        rows.append((key, i, rnd.randrange(2000), rnd.choice([None, rnd.randrange(100)])))
    return rows


@pytest.mark.parametrize("slot", [7, 500, 10_000])
def test_running_equals_a_plain_loop(spark, slot):
    rows = hot_rows()
    d = spark.createDataFrame(rows, "key string, id int, t int, v int").repartition(6)
    d = d.withColumn("slot", F.floor(F.col("t") / slot))
    got = K.running(d, ["key"], "slot", ["t", "id"], count="n", sums={"s": "v"}, maxes={"m": "v"}, lasts={"p": "v"}, nexts={"q": "v"})
    got = {r["id"]: (r["n"], r["s"], r["m"], r["p"], r["q"]) for r in got.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(mine):
            before = [x[3] for x in mine[:i] if x[3] is not None]
            after = [x[3] for x in mine[i + 1:] if x[3] is not None]
            want = (i + 1, sum(before), max(before, default=None), before[-1] if before else None, after[0] if after else None)
            assert got[r[1]] == want


@pytest.mark.parametrize("cells", [1, 4, 1024])
def test_quantiles_equal_numpy(spark, cells):
    rnd = random.Random(4)
    data = {"hot": [rnd.choice([0.0, 1.0, 2.5, rnd.random() * 50]) for _ in range(600)], "few": [3.0], "two": [1.0, 4.0], "flat": [2.0] * 30}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    d = spark.createDataFrame(rows, "key string, v double")
    got = {r["key"]: r for r in K.quantiles(d, ["key"], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}, cells).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert [got[k][n] for n in "abcde"] == pytest.approx(list(np.quantile(vs, [0, 0.1, 0.5, 0.95, 1])))
    assert K.quantiles(d, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.quantile(sum(data.values(), []), 0.5))


def test_attach_keeps_every_row_once(spark):
    d = spark.createDataFrame(hot_rows(), "key string, id int, t int, v int")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, x int")
    left, inner = K.attach(d, dim, ["key"], ["id"]), K.attach(d, dim, ["key"], ["id"], how="inner")
    assert left.count() == 900 and left.where("x = 1").count() == 300
    assert inner.count() == d.where("key in ('hot', 'k1')").count()
    spread = d.where("key = 'hot'").groupBy(K.salt(["id"])).count()
    assert spread.count() == K.FAN and spread.agg(F.max("count")).first()[0] < 60  # 300 rows over 16 salts
    with pytest.raises(ValueError):
        K.attach(d, dim, ["key"], ["id"], how="full")


def test_null_keys_and_slots_are_kept(spark):
    rows = [("a", 0, 1, 1.0), ("a", 1, 2, 2.0), (None, 0, 1, 3.0), (None, None, 0, 4.0), ("a", 2, 3, 1e12), (None, 0, 2, None)]
    d = spark.createDataFrame(rows, "key string, slot int, t int, v double")
    got = {(r["key"], r["t"]): (r["n"], r["s"]) for r in K.running(d, ["key"], "slot", ["t"], count="n", sums={"s": "v"}).collect()}
    assert got == {("a", 1): (1, 0), ("a", 2): (2, 1), ("a", 3): (3, 3), (None, 0): (1, 0), (None, 1): (2, 4), (None, 2): (3, 7)}
    q = {r["key"]: r["m"] for r in K.quantiles(d, ["key"], "v", {"m": 0.5}).collect()}
    assert q == {"a": 2.0, None: 3.5}


def test_quantiles_do_not_mind_outliers_or_ties(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    cells = {"far": [1e12, -1e15, *rng.normal(size=900)], "ties": [1.0] * 500 + [2.0] * 3, "few": [5.0, 7.0], "big": list(rng.integers(0, 50, 700).astype(float))}
    d = spark.createDataFrame([(k, float(v)) for k, vs in cells.items() for v in vs], "key string, v double")
    for n in (2, 64):
        for r in K.quantiles(d, ["key"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}, n).collect():
            assert np.allclose([r["a"], r["b"], r["c"], r["d"]], np.quantile(cells[r["key"]], [0, 0.37, 0.5, 1]), rtol=1e-12)


def test_halo_covers_the_lookback(spark):
    d = spark.createDataFrame([("p", t) for t in range(0, 100, 7)], "key string, t int")
    h = K.haloed(d, ["key"], "t", 20, 15).collect()
    assert sum(r["_own"] for r in h) == 15
    for own in (r for r in h if r["_own"]):
        seen = {r["t"] for r in h if r["slot"] == own["slot"]}
        assert {t for t in range(0, 100, 7) if own["t"] - 15 <= t <= own["t"]} <= seen


def result(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["q_d1_zone_accuracy", "q_d27_cells", "q_g7_repair", "q_d18_rank_at_k", "q_h3_stratified"])
def test_results_do_not_depend_on_partitioning(spark, monkeypatch, name):
    build, read = load_all()[name].build, roles.table
    plain = result(build(spark, "/root/testdata/sf0.001"))
    for n in (1, 17):
        def shuffled(s, sf, t, n=n):
            return read(s, sf, t).repartition(n)

        for m in ("roles", "ranking", "sessions", "text", "classification", "alignment"):
            import importlib

            mod = importlib.import_module(f"evalgrid.plans.{m}")
            if hasattr(mod, "table"):
                monkeypatch.setattr(mod, "table", shuffled)
        assert result(build(spark, "/root/testdata/sf0.001")) == plain


def test_no_hinted_broadcast_and_no_nested_loops(spark):
    """Joins stay equi-joins: with automatic broadcasts off no plan needs a nested loop."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q_c3_nearest", "q_c4_window_join", "q_d27_cells", "q_d18_rank_at_k", "q_j2_overlap", "q_j4_jaccard", "q_d10_icc", "q_c6_pairs", "q_f5_ablation"):
            plan = load_all()[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
            assert "BroadcastHashJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scans_are_pruned(spark):
    q = load_all()["q_c3_nearest_within"].build(spark, "/root/testdata/sf0.001")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "EqualTo(event_type,view)" in plan
    d = load_all()["q_h3_stratified"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in d and "WindowGroupLimit" in d
