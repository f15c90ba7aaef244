"""Periodic runs, decontamination and whitening against plain versions."""

import hashlib
import math
import random
import re
import sys
import zlib
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import CLASH, DOCS, awkward_docs, many_docs, words  # noqa: E402

from evalgrid.llm import charpoly, decontaminate, periodic, whitening  # noqa: E402
from evalgrid.llm import queries as Q  # noqa: E402


def plain_runs(c, least=6, power=4):
    """Every stretch of equal words q apart, kept if no smaller period fits."""
    n, out = len(c), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and c[j] == c[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, power * q):
                w = c[i : i + size]
                if not any(w[d:] == w[:-d] for d in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 6), st.integers(0, 40), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_match_a_plain_search(c, period, at, rule):
    c = c[:at] + [c[at + (i - at) % period] if at + period <= len(c) else c[i] for i in range(at, len(c))]
    assert periodic.runs(np.array(c, np.int64), *rule) == plain_runs(c, *rule)


def test_runs_of_long_texts_and_large_sets(monkeypatch):
    n = 30_000
    assert periodic.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    base = np.arange(n) % 1234
    base[20_000] = -1
    assert periodic.runs(base) == [(0, 20_000, 1234), (20_001, n - 20_001, 1234)]
    monkeypatch.setattr(periodic, "_CHUNK", 4)
    rng = random.Random(3)
    for _ in range(100):
        c = [rng.randint(0, 1) for _ in range(rng.randint(0, 150))]
        assert periodic.runs(np.array(c, np.int64), 2, 2) == plain_runs(c, 2, 2)


def plain_op11(doc_id, text):
    w = words(text)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_op11_matches_a_plain_version(spark, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab cd é".split()) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["a\tb\n" * 30, "x " * 7 + "é\x0by " * 9, "same " * 5, "same " * 6, " lead and trail ", "\x1c a b " * 9]
    docs = spark.createDataFrame([(200 + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    docs = docs.union(many_docs(spark, 120)).union(awkward_docs(spark).where("doc_id is null or doc_id <> 6"))
    docs.withColumn("runs", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, Q.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((plain_op11(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert got == want and sum(r[1] > 0 for r in got) > 20


def test_runs_on_awkward_rows(spark):
    docs = awkward_docs(spark, clash=True)
    got = periodic.find_runs(docs, [F.col("doc_id"), F.col("row")]).collect()
    assert len(got) == 11 and all(r["collapsed"] == "" and r["runs"] == [] for r in got if r["doc_id"] in (3, 4, 5))
    long = next(r for r in got if r["doc_id"] == 6)
    assert [tuple(x) for x in long["runs"]] == [(0, 60_000, 2931)] and len(long["collapsed"].split()) == 2931
    assert periodic.find_runs(docs.limit(0), [F.col("doc_id")]).count() == 0


BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_contamination(docs, bench):
    split = lambda t: [w for w in BETWEEN.split((t or "").translate(LOWER)) if w]
    windows = {}
    for item, text in bench:
        w = split(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, items = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= own
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc_id, len(w), len(hit), sorted(items), [list(s) for s in spans] if len(spans) < 2 else None))
    return sorted(out, key=repr)


def collected(df):
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [list(s) for s in r["spans"]]) for r in df.collect()]
    assert all(sum(b - a for a, b in r[4]) == r[2] for r in rows)
    return sorted(((*r[:4], r[4] if len(r[4]) < 2 else None) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_contamination_matches_a_plain_search(spark, seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("a b c É é d1".split()) for _ in range(n))
    bench = [(i, say(rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 10, 11, 14, 30]))) for i in range(25)]
    bench += [(3, bench[8][1]), (50, bench[9][1].upper()), (50, bench[9][1]), (None, "null item of some words and more words than ten in all"), (60, None), (61, "... !"), (9, "b a")]
    docs = [(i, say(rng.choice([0, 1, 3, 8, 12, 40, 90]))) for i in range(60)]
    docs += [(100 + i, f"{say(3)}, {bench[rng.randrange(len(bench))][1] or ''}! -{say(4)}") for i in range(80)] + [docs[5], (None, bench[9][1]), (7, None)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, places string")
    b = spark.createDataFrame([(*r, 1.0) for r in bench], "item_id bigint, text string, win double")
    got = collected(decontaminate.contamination(d, b, [F.col("doc_id")]))
    assert got == plain_contamination(docs, bench) and sum(r[2] > 0 for r in got) > 40


def test_contamination_with_a_hot_passage_and_a_full_filter(spark, monkeypatch):
    """A third of the rows holds one passage; a filter of 64 bits passes everything and loses nothing."""
    rng = random.Random(5)
    passage = " ".join(f"w{i}" for i in range(40))
    docs = [(i, (passage + " " if i % 3 == 0 else "") + " ".join(f"x{rng.randrange(500)}" for _ in range(20))) for i in range(900)]
    bench = [(1, passage), (2, " ".join(f"w{i}" for i in range(5, 25))), (3, "x1 x2 x3")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    want = plain_contamination(docs, bench)
    assert collected(decontaminate.contamination(d, b, [F.col("doc_id")])) == want
    monkeypatch.setattr(decontaminate.shingle_filter, "__defaults__", (6,))
    assert collected(decontaminate.contamination(d, b, [F.col("doc_id")])) == want


def test_contamination_on_awkward_rows(spark):
    docs = awkward_docs(spark, clash=True)
    b = spark.createDataFrame([(1, "THE quick, brown fox jumps over the lazy dog again!"), (2, "one"), (3, None)], "item_id bigint, text string")
    got = decontaminate.contamination(docs, b, [F.col("doc_id"), F.col("fp")]).collect()
    assert len(got) == 11 and sorted((r["doc_id"] or 0, r["n_hit"]) for r in got if r["n_hit"]) == [(0, 10), (1, 10), (1, 10), (2, 10), (7, 1)]
    none = decontaminate.contamination(docs, b.limit(0), [F.col("doc_id")])
    assert none.count() == 11 and none.where("n_hit > 0 or n_words is null or size(items) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), b, [F.col("doc_id")]).count() == 0
    assert len(CLASH) > 0


def leverrier(m):
    """Characteristic polynomial by traces, with whole numbers."""
    one = np.array([[int(i == j) for j in range(len(m))] for i in range(len(m))], object)
    c, a = [1], one
    for k in range(1, len(m) + 1):
        ma = m.dot(a)
        c.append(int(-Fraction(int(np.trace(ma)), k)))
        a = ma + one * c[-1]
    return c


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([1, 3, 10**5]))
def test_polynomial_roots_and_vectors(d, n, seed, most):
    rng = np.random.default_rng(seed)
    x = rng.integers(-most, most + 1, (n, d)).astype(object)
    m = x.T.dot(x)
    moduli = charpoly.primes(charpoly.coefficient_bits(int(np.trace(m)), d))
    poly = charpoly.remaindered(moduli, charpoly.characteristic_mod(m, moduli).tolist())
    assert poly == leverrier(m)
    simple = charpoly.squarefree(poly, moduli)
    want = np.sort(np.linalg.eigvalsh(m.astype(float)))[::-1]
    found = []
    for at, level, times in charpoly.isolate(poly, simple, d):
        value, vectors = charpoly.null_vectors(m, simple, at, level, times)
        assert len(vectors) == times
        with localcontext(Context(prec=150)):
            for v in vectors:
                off = [sum((Decimal(int(a)) * b for a, b in zip(row, v)), Decimal(0)) - value * y for row, y in zip(m, v)]
                assert max(map(abs, off)) < Decimal(10) ** -20 and abs(sum(y * y for y in v) - 1) < Decimal(10) ** -20
        found += [(float(value), [float(y) for y in v]) for v in vectors]
    assert len(found) == np.linalg.matrix_rank(m.astype(float), tol=1e-7 * max(1.0, want[0]))
    assert np.allclose([e for e, _ in found], want[: len(found)], rtol=1e-9)
    u = np.array([v for _, v in found]).reshape(-1, d)
    assert np.allclose(u @ u.T, np.eye(len(u)), atol=1e-14)


def test_primes_are_the_largest():
    found = charpoly.primes(200)
    assert len(found) == 7 and found[0] == 2**31 - 1 and all(pow(2, p - 1, p) == 1 for p in found) and found == sorted(found, reverse=True)


def plain_whitening(rows):
    """numpy on the grid, centred before multiplying."""
    x = {i: np.array([math.floor(float(c) * 64) + 1_000_000 for c in v], object) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s = len(fit), fit.sum(axis=0)
    z = (fit * n - s).astype(float) / n
    e, q = np.linalg.eigh(z.T @ z / n)
    return {i: (int(((v * n - s) ** 2).sum()), ((v * n - s).astype(float) / n) @ q[:, ::-1]) for i, v in x.items()}, e[::-1], n


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(300, 20)) * np.linspace(3, 0.3, 20)).astype(np.float32)
    rows = [(i, [float(c) for c in v[i]]) for i in range(300)]
    rows += [(900 + i, rows[i % 3][1]) for i in range(120)]
    odd = [(2000, None), (2001, [float("nan")] * 20), (2002, [None] + [0.0] * 19), (2003, [float("inf")] + [0.0] * 19), (2004, [1.0] * 19), (2005, [])]
    df = spark.createDataFrame([(*r, 5) for r in rows + odd], "vec_id bigint, embedding array<float>, n int")
    got = whitening.whitened(df, "embedding", [F.col("vec_id")]).collect()
    want, e, n = plain_whitening(rows)
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n} == {300} and len({r["identity_error"] for r in got}) == 1
    sign = {}
    for r in got:
        k = r["component"] - 1
        deviation, projected = want[r["vec_id"]]
        w = projected[k] / math.sqrt(e[k])
        s = sign.setdefault(k, 1.0 if w * r["whitened"] > 0 else -1.0)
        assert r["deviation"] == deviation and abs(s * r["whitened"] - w) < 1e-9 and abs(r["explained"] - e[k] / e.sum()) < 1e-12 and r["identity_error"] < 1e-12


def test_whitening_without_spread_and_with_repeated_eigenvalues(spark):
    make = lambda rows: spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    same = whitening.whitened(make([[0.5, 1.0]] * 4), "embedding", [F.col("vec_id")]).collect()
    assert len(same) == 8 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in same)
    cube = [[float(a), float(b), float(c), 7.0] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    got = whitening.whitened(make(cube), "embedding", [F.col("vec_id")]).collect()
    assert len(got) == 32 and {round(r["explained"], 9) for r in got} == {round(1 / 3, 9), 0.0}
    assert all((r["whitened"] is None) == (r["component"] == 4) for r in got) and got[0]["identity_error"] < 1e-12
    big = whitening.whitened(make([[1e300, 0.0], [-1e300, 0.0], [1.0, 2.0]]), "embedding", [F.col("vec_id")]).collect()
    assert len(big) == 6 and all(r["deviation"] is None for r in big if r["vec_id"] < 2) and big[0]["identity_error"] < 1e-9
    for empty in (make([[1.0]]).limit(0), make([[]])):
        assert whitening.whitened(empty, "embedding", [F.col("vec_id")]).count() == 0


def test_polynomial_through_spark_tasks(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-(10**9), 10**9, (30, 24)).astype(object)
    m = x.T.dot(x)
    assert whitening.characteristic(spark, m)[0] == leverrier(m)
