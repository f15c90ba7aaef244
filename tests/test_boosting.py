"""Boosted trees against a plain version that looks at every row and every cut."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrid.operators import boosting as B


def plain_tree(x, g, leaves, least):
    """Best-first tree on rows x (None: missing); returns a function row -> value."""

    def score(rows):
        s = sum(g[i] for i in rows)
        return s * s / len(rows)

    def best(rows):
        found = None
        for f in range(len(x[0])):
            vals = sorted({x[i][f] for i in rows if x[i][f] is not None})
            gone = [i for i in rows if x[i][f] is None]
            for cut in vals[:-1] if not gone else vals:
                a = [i for i in rows if x[i][f] is not None and x[i][f] <= cut]
                b = [i for i in rows if x[i][f] is not None and x[i][f] > cut]
                for side in (False, True) if gone else (len(a) > len(b),):
                    left, right = (a + gone, b) if side else (a, b + gone)
                    if not gone:
                        left, right = a, b
                    if len(left) >= least and len(right) >= least:
                        gain = score(left) + score(right) - score(rows)
                        if found is None or gain > found[0] + 1e-10 * abs(found[0]):
                            found = (gain, f, cut, side, left, right)
        return found if found and found[0] > 1e-12 else None

    nodes, split, heap = {0: list(range(len(x)))}, {}, []
    first = best(nodes[0])
    if first:
        heap.append((-first[0], 0, first))
    while heap and len(split) < leaves - 1:
        _, k, s = heapq.heappop(heap)
        split[k] = (*s[1:4], 2 * len(split) + 1, 2 * len(split) + 2)
        for child, rows in zip(split[k][3:], s[4:]):
            nodes[child] = rows
            more = best(rows)
            if more:
                heapq.heappush(heap, (-more[0], child, more))

    def value(row):
        k = 0
        while k in split:
            f, cut, side, a, b = split[k]
            k = a if (side if row[f] is None else row[f] <= cut) else b
        return -B.STEP * sum(g[i] for i in nodes[k]) / len(nodes[k])

    return value


def plain_predictions(rows, k, iterations, leaves, least):
    """rows: (fold, y, *x). Out-of-fold predictions in order."""
    out = [None] * len(rows)
    for fold in range(k):
        train = [r for r in rows if r[0] != fold]
        x, y = [r[2:] for r in train], [r[1] for r in train]
        p = [sum(y) / len(y)] * len(y)
        mine = [i for i, r in enumerate(rows) if r[0] == fold]
        q = [sum(y) / len(y)] * len(mine)
        for _ in range(iterations):
            value = plain_tree(x, [a - b for a, b in zip(p, y)], leaves, least)
            p = [a + value(r) for a, r in zip(p, x)]
            q = [a + value(rows[i][2:]) for a, i in zip(q, mine)]
        for i, v in zip(mine, q):
            out[i] = v
    return out


def some_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randint(0, 9), rng.random(), rng.choice([0.0, 1.0, 2.0])
        y = math.sin(a) + 2 * b * (c > 0.5) + rng.gauss(0, 0.1) + (1.5 if i % 7 == 0 else 0)
        out.append((i % 3, y, None if i % 7 == 0 else float(a), b, c))
    return out


@pytest.mark.parametrize("cells", [B.CELLS, 0])
def test_both_ways_match_a_plain_version(spark, monkeypatch, cells):
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    rows = some_rows(150, 2)
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, fold int, y double, a double, b double, c double").repartition(3)
    model = B.fit_folds(d, "fold", ["a", "b", "c"], "y", B.Rules(5, leaves=6, leaf_rows=4), cells)
    got = [r["prediction"] for r in B.predict(d, model, "fold").orderBy("id").collect()]
    assert got == pytest.approx(plain_predictions(rows, 3, 5, 6, 4), abs=1e-9)
    assert all(len(t.feature) <= 11 for ts in model.trees.values() for t in ts)


def test_awkward_rows(spark):
    rows = [(0, 1.0, None, "x"), (1, float("nan"), 2.0, "x"), (1, None, 1.0, None), (None, 3.0, float("nan"), "y"), (2, 2.0, 1.0, "z")] * 30
    d = spark.createDataFrame(rows, "fold int, y double, a double, code string")
    got = B.cross_predictions(d, "fold", ["a"], "y", B.Rules(3)).collect()
    assert len(got) == 150 and all((r["prediction"] is None) == (r["fold"] is None) for r in got)
    assert B.cross_predictions(d.limit(0), "fold", ["a"], "y").count() == 0
    none = B.cross_predictions(d.withColumn("y", F.lit(None).cast("double")), "fold", ["a"], "y")
    assert none.where("prediction is not null").count() == 0


def test_many_values_are_binned_and_learned(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 2))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.5 * np.abs(x[:, 1])
    d = spark.createDataFrame([(i % 2, float(v), float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(y, x))], "fold int, y double, a double, b double")
    edges = B.bin_edges(d, ["a", "b"])
    assert all(200 <= len(e) <= B.BINS - 1 for e in edges)
    e = F.col("y") - F.col("prediction")
    got = B.cross_predictions(d, "fold", ["a", "b"], "y", B.Rules(80)).agg(F.sqrt(F.avg(e * e))).first()[0]
    assert got < 0.1 * float(y.std())


def test_missing_values_take_the_better_side(spark):
    d = spark.createDataFrame([(i % 2, 5.0 if i % 3 == 0 else float(i % 5), None if i % 3 == 0 else float(i % 5)) for i in range(600)], "fold int, y double, a double")
    p = B.cross_predictions(d, "fold", ["a"], "y", B.Rules(150)).where("a is null").agg(F.min("prediction"), F.max("prediction")).first()
    assert p[0] == pytest.approx(5.0, abs=0.05) and p[1] == pytest.approx(5.0, abs=0.05)
