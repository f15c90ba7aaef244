"""Quality rules and source mixing against plain versions."""

import collections
import re
import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import DOCS, awkward_docs, many_docs, words  # noqa: E402

from evalgrid.llm import mixing, outliers  # noqa: E402


def plain_statistics(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_statistics_match_a_plain_count(spark):
    line = "a b c d e f g h i j"
    texts = [line + "\n" + line, line + " x " + line + " y " + line, "a " * 30, "# | < > $ % & *\n\n \n# | < > $ % & *", "ab\x0bcd\x0cef", "é漢🎉 é漢🎉", None, ""]
    docs = awkward_docs(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "z", 0) for i, t in enumerate(texts)], DOCS))
    got = outliers.document_statistics(docs, [F.col("doc_id"), F.col("text").alias("t"), F.col("lang"), F.col("source")]).collect()
    assert len(got) == 19
    for r in got:
        assert tuple(r[c] for c in [*outliers.BASE, "base_failed"]) == plain_statistics(r["t"])


def plain_mcd(x, floor):
    """The same concentration steps on one group with numpy."""
    grid, var = 1024.0, np.array(floor) ** 2
    low = lambda v, q: np.sort(v)[int(np.ceil(q * len(v))) - 1]
    m = np.array([low(np.floor(c * grid + 0.5), 0.5) for c in x.T]) / grid
    d = np.array([low(np.floor(np.abs(c - a) * grid + 0.5), 0.5) for c, a in zip(x.T, m)]) / grid * 1.4826
    cov = np.diag(d**2 + var)
    dist = lambda: (np.linalg.solve(np.linalg.cholesky(cov), (x - m).T) ** 2).sum(axis=0)
    bins = lambda: np.floor(64 * np.log(np.maximum(dist(), 1e-9)))
    for _ in range(outliers.STEPS):
        b = bins()
        near = x[b <= low(b, outliers.HALF)]
        m, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(var)
    return dist() * min(1.0, outliers.CHI_HALF / np.exp((low(bins(), outliers.HALF) + 1) / 64))


def test_outliers_match_numpy_and_find_planted_junk(spark):
    docs = many_docs(spark, 900)
    junk = spark.createDataFrame([(5000 + i, " ".join(f"w{j}### |{i}|" for j in range(60)), "en", "hot", 0) for i in range(12)], DOCS)
    stats = outliers.document_statistics(docs.union(junk), [F.col("doc_id"), F.col("lang"), F.col("source")]).cache()
    got = {r["doc_id"]: r for r in outliers.outlier_verdicts(stats).collect()}
    assert all(not got[5000 + i]["kept"] for i in range(12))
    clean = [r for i, r in got.items() if i < 5000 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    own = [r for r in got.values() if r["lang"] == "en" and r["source"] == "s0" and not r["base_failed"]]
    n = np.array([[r[c] for c in outliers.BASE] for r in own], float)
    x = np.c_[np.log1p(n[:, 0]), np.log((n[:, 1] + 1) / n[:, 0]), np.sqrt(n[:, 2] / n[:, 0]), np.log1p(n[:, 3]), n[:, 4] / n[:, 0]]
    want = plain_mcd(x, list(outliers.FEATURES.values()))
    assert np.allclose([r["distance"] for r in own], want, rtol=1e-6, atol=1e-9)


def test_outliers_on_awkward_rows(spark):
    docs = awkward_docs(spark, clash=True)
    got = outliers.judge(docs)
    assert got.count() == 11 and set(outliers.BASE) <= set(got.columns)
    assert {r["doc_id"] for r in got.where("kept").collect()} <= {6}
    kept = outliers.drop_outliers(docs.unionByName(docs.where("doc_id = 6")))
    assert kept.columns == docs.columns and kept.count() in (0, 2)
    assert outliers.judge(docs.limit(0)).count() == 0 and outliers.drop_outliers(docs.limit(0)).count() == 0


def plain_targets(sizes):
    """Share, stop, share the excess again, until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: [3.0, 1.0, 2.0][i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=9))
def test_targets_match_repeated_sharing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame([("b" if s is None else "a" + s, n) for s, n in zip(names, sizes)], "source_key string, source_size long")
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(df).collect()}
    for s, t in plain_targets(dict(zip(names, sizes))).items():
        assert abs(got["b" if s is None else "a" + s] - t) <= 1e-6 * max(1, t)


def test_mix_is_near_its_targets_and_repeats_itself(spark):
    docs = many_docs(spark, 900)
    got = mixing.sampled(docs).toPandas().sort_values("doc_id")
    size = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    assert got["size"].tolist() == [size[i] for i in got.doc_id]
    assert (got.taken <= 2 * got["size"]).all() and len(got) == 900
    want = plain_targets(got.groupby("source")["size"].sum().to_dict())
    for s, g in got.groupby("source"):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 and abs(g.taken.sum() - want[s]) <= 0.02 * want[s]
    again = mixing.sampled(docs.repartition(5)).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == got.taken.tolist()


def test_mix_on_awkward_rows(spark):
    docs = awkward_docs(spark, clash=True)
    got = mixing.sampled(docs).collect()
    assert len(got) == 11 and all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.sampled(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
