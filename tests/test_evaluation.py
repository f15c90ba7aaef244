"""Known answers for trials, ranking, retrieval, matching, audit and claims."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.operators import audit as AU
from evalgrid.operators import claims as CL
from evalgrid.operators import classify as C
from evalgrid.operators import matching as MT
from evalgrid.operators import ranking as R
from evalgrid.operators import retrieval as RT
from evalgrid.operators import sampling as S
from evalgrid.operators import trials as T

LOG = "session string, participant string, trial int, seq int, event string, item string, cue_item string, cue_zone double, detail string, frame_ms double"
KEY = ["session", "participant", "trial"]


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_reachability_three_ways(spark):
    d = log(spark, [
        ("s", "p", 1, 1, "dwell", None, "a", None, None, 1.0), ("s", "p", 1, 2, "dwell", None, "a", 2.0, None, 1.0), ("s", "p", 1, 3, "trial_end", "a", "a", 2.0, "1000", 1.0),
        ("s", "p", 2, 4, "dwell", None, "a", None, None, 1.0), ("s", "p", 2, 5, "trial_end", "a", "a", 1.0, "1000", 1.0),
        ("s", "old", 1, 1, "dwell", None, "a", None, None, 1.0), ("s", "old", 1, 2, "trial_end", "a", "a", None, "1000", 1.0),
    ])
    loose = {(r["participant"], r["trial"]): (r["cue_zone_at_start"], r["reachable"]) for r in T.reachability(d, KEY, "participant").collect()}
    assert loose == {("p", 1): (2.0, True), ("p", 2): (None, False), ("old", 1): (None, True)}
    strict = {(r["participant"], r["trial"]): r["reachable"] for r in T.reachability(d, KEY, "participant", strict=True).collect()}
    assert strict == {("p", 1): False, ("p", 2): False, ("old", 1): True}
    kept = T.keep_reachable(T.trial_ends(d), T.reachability(d, KEY, "participant"), KEY)
    assert sorted((r["participant"], r["trial"]) for r in kept.collect()) == [("old", 1), ("p", 1)]


def test_durations_and_missing_items(spark):
    d = log(spark, [("s", "p", 1, 1, "trial_end", None, "a", 1.0, "500", 9000.0), ("s", "p", 2, 2, "trial_end", "a", "a", 1.0, "skipped", 9000.0), ("s", "p", 3, 3, "trial_end", "b", "a", 1.0, "2300", 9000.0)])
    got = {r["trial"]: (r["seconds"], r["seconds_raw"], r["wrong"]) for r in T.trial_ends(d).collect()}
    assert got == {1: (0.0, 0.5, True), 2: (None, None, False), 3: (1.5, 2.3, True)}
    none = {r["trial"]: r["seconds"] for r in T.trial_ends(d.withColumn("detail", F.lit(None).cast("string"))).collect()}
    assert none == {1: 8.2, 2: 8.2, 3: 8.2}


def test_oracle_rankings(spark):
    rows = []
    for u in range(4):
        for place in range(5):
            rows += [("oracle", u, place, (u + place) % 5), ("anti", u, place, (u + place + 1) % 5 if place < 4 else 9), ("third", u, place, (u - 2 + place) % 5)]
    lists = spark.createDataFrame([(m, u, p, str(c), c) for m, u, p, c in rows], "method string, unit int, place int, item string, category int")
    lists = lists.where("NOT (method = 'anti' AND category = unit)")
    gold = spark.createDataFrame([(u, u) for u in range(4)], "unit int, gold int")
    g = R.gold_rank(R.first_mentions(lists, ["method", "unit"], "place", "category", ["item"]), gold, ["method", "unit"], "unit")
    top = {r["method"]: (r["a"], r["b"]) for r in g.groupBy("method").agg(F.avg("top1").alias("a"), F.avg("top3").alias("b")).collect()}
    assert top == {"oracle": (1.0, 1.0), "anti": (0.0, 0.0), "third": (0.0, 1.0)}


def test_repeats_close_up_and_metrics(spark):
    lists = spark.createDataFrame([("m", 1, 1, "cup", 5), ("m", 1, 2, "mug", 5), ("m", 1, 3, "??", None), ("m", 1, 4, "??", None), ("m", 1, 5, "bed", 7), ("m", 1, 6, "desk", 8)], "method string, unit int, place int, item string, category int")
    ranked = R.first_mentions(lists, ["method", "unit"], "place", "category", ["item"])
    assert [(r["rank"], r["item"]) for r in ranked.orderBy("rank").collect()] == [(1, "cup"), (2, "??"), (3, "??"), (4, "bed"), (5, "desk")]
    assert R.list_lengths(lists, ["method", "unit"], "category").first()["n_items"] == 5
    truth = spark.createDataFrame([(1, [5, 9], [7], [5], [])], "unit int, pos array<int>, neg array<int>, pos_l array<int>, neg_l array<int>")
    items = R.judged(ranked, truth, "unit", [[8, 9]], [5, 7, 8, 9])
    m = {r["k"]: r for r in R.rank_metrics(items, ["method", "unit"]).collect()}
    assert (m[3]["precision"], m[3]["verifiable"], m[3]["recall"], m[3]["hit"]) == (1.0, pytest.approx(1 / 3), 0.5, 1.0)
    assert (m[6]["precision"], m[6]["precision_lenient"], m[6]["recall"], m[6]["recall_lenient"]) == (0.5, pytest.approx(2 / 3), 0.5, 1.0)
    assert m[6]["precision_single"] == 1.0
    empty = spark.createDataFrame([(1, [99], [], [], [])], "unit int, pos array<int>, neg array<int>, pos_l array<int>, neg_l array<int>")
    e = R.rank_metrics(R.judged(ranked, empty, "unit", [], [5]), ["method", "unit"]).first()
    assert e["precision"] is None and e["recall"] is None and e["hit"] == 0.0


def test_unequal_coverage(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 2)], "method string, unit int")
    assert [r[0] for r in R.common_units(d).collect()] == [2]


def test_leave_one_out_popularity_against_brute_force(spark):
    rnd, sets = random.Random(4), {}
    for u in range(30):
        sets[u] = set(rnd.sample(range(15), rnd.randrange(5)))
    names = {i: f"n{14 - i:02d}" for i in range(15)}
    members = spark.createDataFrame([(u, c) for u, s in sets.items() for c in s], "unit int, category int")
    got = R.loo_popularity(members, spark.createDataFrame([(u,) for u in sets], "unit int"), spark.createDataFrame(list(names.items()), "category int, name string"), k=6)
    mine = {}
    for r in got.orderBy("unit", "rank").collect():
        mine.setdefault(r["unit"], []).append(r["category"])
    for u in sets:
        score = {c: sum(c in s for v, s in sets.items() if v != u) for c in names}
        assert mine[u] == sorted(names, key=lambda c: (-score[c], names[c]))[:6]


@pytest.mark.parametrize("tile", [8 << 20, 7 * 64])
def test_cosine_top_k_in_tiles_of_any_size(spark, tile):
    rng = np.random.default_rng(3)
    u, b = rng.normal(size=(40, 8)), rng.normal(size=(30, 8))
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "unit bigint, vec array<double>")
    bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "item bigint, vec array<double>")
    sims = np.round((u / np.linalg.norm(u, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, 6)
    got = {}
    for r in RT.cosine_top_k(units, bank, 5, tile).orderBy("unit", "rank").collect():
        got.setdefault(r["unit"], []).append(r["item"])
    assert got == {i: sorted(range(30), key=lambda j: (-row[j], j))[:5] for i, row in enumerate(sims)}


def test_overlap_and_jaccard_fill_up(spark):
    bank = spark.createDataFrame([(i, o) for i, os in enumerate(["ab", "bc", "cd", "de", "bf"]) for o in os], "item int, object string")
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    shown = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz")], "case_id int, object string")
    got = {}
    for r in RT.overlap_top_k(shown, bank, cases, 3).orderBy("case_id", "rank").collect():
        got.setdefault(r["case_id"], []).append(r["item"])
    pop = {0: 2, 1: 3, 2: 2, 3: 1, 4: 2}
    assert got[1] == [0, 1, 4] and got[2] == sorted(pop, key=lambda i: (-pop[i], i))[:3]
    tokens = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 0, "x"), (1, 0, "y"), (2, 0, "q")], "item int, text_no int, token string")
    mine = spark.createDataFrame([(1, "x"), (1, "y")], "case_id int, token string")
    j = RT.jaccard_top_k(mine, tokens, cases, spark.createDataFrame([(i,) for i in range(3)], "item int"), 3)
    assert [(r["case_id"], r["item"], r["score"]) for r in j.orderBy("case_id", "rank").collect()] == [(1, 1, 1.0), (1, 0, 0.5), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)]


def test_set_top_k_equals_brute_force_and_skips_frequent_tokens(spark):
    rnd = random.Random(21)
    # every set holds the same frequent word; the others follow a skewed distribution; parts repeat
    def some():
        return sorted({"the", *[f"w{int(40 * rnd.random() ** 2)}" for _ in range(rnd.randrange(0, 7))]} if rnd.random() < 0.9 else {f"only{rnd.randrange(9)}"})

    mine = {i: some() for i in range(60)} | {60: [], 61: ["nowhere"]}
    bank = {(i, n): some() for i in range(80) for n in range(1 + i % 3)}
    cases = spark.createDataFrame([(i,) for i in mine], "case_id int")
    items = spark.createDataFrame([(i,) for i in range(80)], "item int")
    ct = spark.createDataFrame([(i, w) for i, ws in mine.items() for w in ws], "case_id int, token string")
    bt = spark.createDataFrame([(i, n, w) for (i, n), ws in bank.items() for w in ws], "item int, text_no int, token string")
    for k in (1, 6, 100):
        got = {}
        for r in RT.jaccard_top_k(ct, bt, cases, items, k).orderBy("case_id", "rank").collect():
            got.setdefault(r["case_id"], []).append((r["item"], r["score"]))
        for c, ws in mine.items():
            score = {i: max(len({*ws} & {*bank[i, n]}) / max(1, len({*ws} | {*bank[i, n]})) for n in range(1 + i % 3)) for i in range(80)}
            assert got[c] == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    flat = {i: bank[i, 0] for i in range(80)}
    bo = spark.createDataFrame([(i, w) for i, ws in flat.items() for w in ws], "item int, object string")
    often = Counter(w for ws in flat.values() for w in ws)
    pop = {i: sum(often[w] - 1 for w in ws) for i, ws in flat.items()}
    for k in (1, 6, 100):
        got = {}
        for r in RT.overlap_top_k(ct.withColumnRenamed("token", "object"), bo, cases, k).orderBy("case_id", "rank").collect():
            got.setdefault(r["case_id"], []).append((r["item"], r["overlap"]))
        for c, ws in mine.items():
            score = {i: len({*ws} & {*flat[i]}) for i in range(80)}
            assert got[c] == sorted(score.items(), key=lambda x: (-x[1], -pop[x[0]], x[0]))[:k]


def test_noise_cases(spark):
    bank = spark.createDataFrame([(1, ["cup", "tea"], "a"), (2, ["cup"], "b"), (3, ["x"], "nowhere"), (4, ["x"], None)], "id int, objects array<string>, room string")
    rows = [("a", "wrong", 0, "bed"), ("a", "wrong", 1, "tea"), ("a", "screen", 0, "cup"), ("a", "screen", 1, "tea"), ("b", "wrong", 0, "bed"), ("b", "screen", 0, "lamp")]
    pools = spark.createDataFrame(rows, "room string, pool string, place bigint, item string")
    got = {r["case_id"]: r for r in RT.noise_cases(bank, pools, ["room"], "item").collect()}
    assert len(got) == 8 and got["1:clean"]["objects_shown"] == ["cup", "tea"] and got["1:partial"]["objects_shown"] == ["cup"]
    assert got["1:wrong_label"]["objects_shown"] == ["cup", "bed"] and got["1:wrong_label"]["swapped_index"] == 1
    assert got["1:wrong_pick"]["objects_shown"] == ["cup", "tea"] and got["1:wrong_pick"]["swapped_index"] is None
    assert got["2:wrong_pick"]["objects_shown"] == ["lamp"] and not got["2:wrong_pick"]["recoverable"] and got["2:partial"]["recoverable"]


def test_error_pools_and_picks_equal_arrays(spark):
    rnd = random.Random(5)
    items = [(room, rnd.choice([None, *[f"n{i}" for i in range(12)]]), rnd.choice(["wrong", "correct", None]), rnd.randrange(1, 9)) for room in "abc" for _ in range(25)]
    items += [("d", "only", "correct", 7), ("e", "w", "wrong", 8), ("f", "s", "correct", 1), ("g", None, "wrong", 1)]
    d = spark.createDataFrame(items, "room string, item string, status string, rank int")
    want = {}
    for room in "abcdefg":
        wrong = sorted({n for r, n, s, _ in items if r == room and n and s == "wrong"}) or ["bed", "stove"]
        want[room] = (wrong, sorted({n for r, n, _, k in items if r == room and n and k <= 3}) or wrong)
    pools = RT.error_pools(d, ["room"], "item", ["stove", "bed"])
    got = {(r["room"], r["pool"], r["place"]): r["item"] for r in pools.collect()}
    assert got == {(room, p, i): n for room, both in want.items() for p, names in zip(RT.POOLS, both) for i, n in enumerate(names)}
    bank = [(i, [f"n{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 6))], "abcdefg"[i % 7]) for i in range(70)]
    cases = RT.noise_cases(spark.createDataFrame(bank, "id int, objects array<string>, room string"), pools, ["room"], "item").collect()
    by_id = {i: (objects, room) for i, objects, room in bank}
    assert len(cases) == 280
    for r in cases:
        objects, room = by_id[r["id"]]
        if r["condition"] in ("clean", "partial"):
            continue
        free = sorted({*want[room][r["condition"] == "wrong_pick"]} - {*objects})
        at = int(hashlib.md5(f"0:{r['id']}:{r['condition']}".encode()).hexdigest()[:8], 16) % max(1, len(free))
        assert r["objects_shown"] == ([*objects[:-1], free[at]] if free else objects)
        assert r["swapped_index"] == (len(objects) - 1 if free else None)
    assert RT.error_pools(d.limit(0), ["room"], "item", ["bed"]).count() == 0


def test_category_matching(spark):
    cats = spark.createDataFrame([(1, "pillow", []), (2, "coffee_table", []), (3, "table", ["desk"]), (4, "desk", []), (5, "glass_(drink_container)", []), (6, "chest_of_drawers", []), (7, "box", []), (8, "sofa", ["Table"])], "id int, name string, synonyms array<string>")
    ali = spark.createDataFrame([("couch", "sofa"), ("bin", "trash")], "surface string, name string")
    s = MT.surface_table(cats, ali)
    want = {"Two white pillows": 1, "wooden coffee-table": 2, "old tables": 3, "desk": 4, "a glass of water": 5, "the chest of drawers": 6, "boxes": 7, "Couch!": 8, "the": None, "unicorn": None}
    p = spark.createDataFrame([(k,) for k in want] * 3, "phrase string")
    assert {r["phrase"]: r["category"] for r in MT.match_categories(p, s, "phrase").collect()} == want


def test_kappa_and_changes(spark):
    pairs = [("Y", "Y")] * 20 + [("N", "N")] * 15 + [("Y", "N")] * 10 + [("N", "Y")] * 5 + [("Y", None)] * 7
    d = spark.createDataFrame([("c", *p) for p in pairs] + [("same", "Y", "Y")], "col string, x string, y string")
    k = {r["col"]: r for r in AU.cohens_kappa(d, ["col"], "x", "y").collect()}
    assert k["c"]["n"] == 50 and k["c"]["raw_agreement"] == 0.7 and k["c"]["kappa"] == pytest.approx((0.7 - 0.5) / 0.5)
    assert k["same"]["kappa"] is None


def test_unknown_code_fails(spark):
    key = spark.createDataFrame([("U0000", "M1"), ("U0001", "M7")], "item_uid string, method_code string")
    codes = spark.createDataFrame([("M1", "static")], "method_code string, method string")
    assert AU.unblind(key.limit(1), codes).first()["method"] == "static"
    with pytest.raises(Exception, match="unknown method code"):
        AU.unblind(key, codes).collect()


def test_generic_terms_close_up(spark):
    d = spark.createDataFrame([("m", 1, r, i, r > 1, False) for r, i in enumerate(["Room", "cup", "AREA", "tea"], 1)], "method string, scene int, rank int, item string, in_photo boolean, useful boolean")
    g = AU.drop_generic(d, "scene")
    assert [(r["rank"], r["item"]) for r in g.orderBy("rank").collect()] == [(1, "cup"), (2, "tea")]
    m = {r["k"]: r["human_precision"] for r in AU.human_metrics(g, "scene").collect()}
    assert m == {3: pytest.approx(2 / 3), 6: pytest.approx(2 / 6)}  # short lists are penalised


def test_claims(spark):
    claims = spark.createDataFrame([("a", 3.0, 0.0), ("b", 0.5, 0.01), ("c", 1.0, 0.0), ("d", 0.3, 0.001)], "claim_id string, expected double, tol double")
    got = spark.createDataFrame([("a", 3.0), ("b", 0.509), ("d", 0.302), ("e", 1.0)], "claim_id string, got double")
    c = CL.check(claims, got)
    assert {r["claim_id"]: r["verdict"] for r in c.collect()} == {"a": "ok", "b": "ok", "c": "missing", "d": "fail", "e": "unclaimed"}
    assert sorted(r["claim_id"] for r in CL.failures(c).collect()) == ["c", "d"]


def test_samples(spark):
    d = spark.createDataFrame([("hot" if i % 3 else f"s{i % 4}", i) for i in range(90)], "stratum string, id int")
    a = {tuple(r) for r in S.stratified(d, "stratum", "id", 5).collect()}
    assert a == {tuple(r) for r in S.stratified(d.repartition(9), "stratum", "id", 5).collect()}
    assert max(sum(x[0] == s for x in a) for s in {x[0] for x in a}) == 5
    rr = [r["stratum"] for r in S.round_robin(d, "stratum", ["id"], 7).orderBy("turn", "stratum").collect()]
    assert rr == ["hot", "s0", "s1", "s2", "s3", "hot", "s0"]
    assert S.sample_units(d, "id", 10).count() == 10
    p = spark.createDataFrame([("P_10",), ("P_9",)], "p string").orderBy(S.natural_number(F.col("p")))
    assert [r[0] for r in p.collect()] == ["P_9", "P_10"]


def test_majority_ties_go_to_the_smallest_zone(spark):
    rows = [("g", s, z) for s, zs in (("a", [0, 1]), ("b", [1, 0]), ("c", [2, 2, 2])) for z in zs]
    d = spark.createDataFrame(rows, "grid string, subject string, zt int")
    m = {r["subject"]: (r["majority_zone"], r["acc"]) for r in C.leave_one_out_majority(d, ["grid"], "subject").collect()}
    assert m == {"a": (2, 0.0), "b": (2, 0.0), "c": (0, 0.0)}


def test_raters_meet_item_by_item(spark):
    cols = "item_uid int, D string, E string"
    a = spark.createDataFrame([(1, "Y", "Y"), (2, "N", None), (3, "Y", "N"), (4, "Y", "Y")], cols)
    b = spark.createDataFrame([(1, "Y", "N"), (2, "N", "Y"), (9, "Y", "Y")], cols)
    c = spark.createDataFrame([(3, "N", "N"), (4, "Y", None)], cols)
    got = AU.join_raters([a, b, c], "item_uid", ["D", "E"]).collect()
    assert sorted((r["pair"], r["item_uid"], r["D_1"], r["D_2"]) for r in got) == [("1 vs 2", 1, "Y", "Y"), ("1 vs 2", 2, "N", "N"), ("1 vs 3", 3, "Y", "N"), ("1 vs 3", 4, "Y", "Y")]
    k = {(r["pair"], r["column"]): (r["n"], r["raw_agreement"], r["kappa"]) for r in AU.rater_agreement([a, b, c], "item_uid", ["D", "E"]).collect()}
    assert k["1 vs 2", "D"] == (2, 1.0, 1.0) and k["1 vs 3", "D"][:2] == (2, 0.5) and k["1 vs 2", "E"][:2] == (1, 0.0)
    with pytest.raises(ValueError):
        AU.join_raters([a], "item_uid", ["D"])


def test_whole_result_groups_are_registered(spark):
    """All four calibration grids, and every place of the popularity list."""
    from evalgrid.plans import load_all

    reg, sf = load_all(), "/root/testdata/sf0.001"
    assert {r["grid"] for r in reg["q_d16_kshot"].build(spark, sf).select("grid").distinct().collect()} == {"1x3", "2x2", "3x3", "4x4"}
    assert {r["rank"] for r in reg["q_j1_loo_popular"].build(spark, sf).select("rank").distinct().collect()} == set(range(1, 7))  # six names


def test_popularity_sends_no_table_of_units_through_the_driver(spark, tmp_path):
    """Units in a small file would be broadcast, many times larger in memory; only the vocabulary may be."""
    spark.range(3000).select(F.col("id").cast("int").alias("unit")).write.parquet(f"{tmp_path}/u")
    units = spark.read.parquet(f"{tmp_path}/u")
    members = units.where("unit % 2 = 0").select("unit", (F.col("unit") % 5).alias("category"))
    names = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "category int, name string")
    got = R.loo_popularity(members, units, names, k=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "rightHint=(strategy=broadcast)" in plan
    assert got.count() == 9000


def test_popularity_keeps_repeated_and_null_units(spark):
    units = spark.createDataFrame([(1,), (1,), (None,)], "unit int")
    members = spark.createDataFrame([(1, 0), (None, 1), (7, 1)], "unit int, category int")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "category int, name string")
    got = sorted((str(r["unit"]), r["category"], r["score"]) for r in R.loo_popularity(members, units, names, k=9).collect())
    assert got == [("1", 0, 0), ("1", 0, 0), ("1", 1, 2), ("1", 1, 2), ("None", 0, 1), ("None", 1, 2)]


def test_first_mentions_is_one_pass_and_keeps_every_unnamed_item(spark):
    rows = [("m", 1, 1, 7, "x"), ("m", 1, 2, None, "y"), ("m", 1, 2, None, "y"), ("m", 1, 3, 7, "z"), ("m", 1, 4, 8, "w")]
    d = spark.createDataFrame(rows, "method string, unit int, place int, category int, item string")
    got = R.first_mentions(d, ["unit", "method"], "place", "category", ["item"])
    assert [(r["rank"], r["item"]) for r in got.orderBy("rank").collect()] == [(1, "x"), (2, "y"), (3, "y"), (4, "w")]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_calibration_draws_sort_few_rows_and_are_those_of_lowest_hash(spark, monkeypatch):
    """Subject 1 has distinct rows; subject 2 one repeated id, whose hash lies below the limit or not at all."""
    rows = [(1, i, i % 3) for i in range(600)] + [(2, 7, 0)] * 200 + [(3, i, 0) for i in range(4)]
    d = spark.createDataFrame([(s, i, day, i / 600 if i % 5 else None, i / 700) for s, i, day in rows], "s int, id bigint, day int, px double, gx double")
    sorted_rows, top = [], C.top_per_key
    monkeypatch.setattr(C, "top_per_key", lambda df, *a, **k: sorted_rows.append(df.count()) or top(df, *a, **k))
    fits, drawn, _ = C.calibration_fits(d, "s", "id", "day", {"x": ("px", "gx")}, draws=6)
    got = {}
    for r in drawn.where("k = 16").collect():
        got.setdefault((r["s"], r["scheme"], r["draw"]), []).append((r["_h"], r["id"]))
    assert sorted_rows[0] < sum((600 * 4 // 5 + 160, 200 * 2, 3 * 2)) * 6 * 0.75

    def h(draw, i):
        x = (draw * 668265263 + i * 1640531527) & 0xFFFFFFFF
        for _ in range(2):
            x = (((x >> 16) ^ x) * 0x45D9F3B) & 0xFFFFFFFF
        return (x >> 16) ^ x

    want = {}
    for scheme, keep in (("random", lambda s, day: True), ("first session", lambda s, day: day == 0)):
        for draw in range(6):
            for s in (1, 2, 3):
                want[s, scheme, draw] = sorted((h(draw, i), i) for t, i, day in rows if t == s and i % 5 and keep(s, day))[:16]
    assert {k: sorted(v) for k, v in got.items()} == want
