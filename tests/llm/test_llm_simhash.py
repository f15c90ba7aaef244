"""SimHash against brute force: fingerprints, every pair within the radius, components, one kept."""

import random
import sys
from itertools import combinations
from pathlib import Path

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward_docs, many_docs, words  # noqa: E402

from evalgrid.llm import simhash as S  # noqa: E402
from evalgrid.llm.components import connected_components  # noqa: E402


def plain_fingerprint(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\t\n漢", max_size=60))
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_long_text_goes_in_blocks(monkeypatch):
    text = " ".join(str(i % 701) for i in range(5_000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "_BLOCK", 97)
    assert S.fingerprint(text) == whole == plain_fingerprint(text)


def test_masks_cover_every_three_bits_on_every_level():
    def covered(masks, bits):
        return all(any(not m & hit for m in masks) for c in combinations(bits, 3) for hit in [sum(1 << b for b in c)])

    first, second, third = S._mask_levels()
    assert len(first) == 15 and covered(first, range(64))
    for t in (0, 7, 14):
        assert covered(second[15 * t : 15 * t + 15], [b for b in range(64) if not first[t] >> b & 1])
    assert max(64 - m.bit_count() for m in third) <= 8


def test_links_join_all_pairs_within_the_radius_at_any_bucket_size(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << i for i in rng.sample(range(20), rng.randint(0, 4))) for b in base for _ in range(25)}
    fps = sorted(near)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    u = np.array(fps, np.uint64)
    pairs = [(i, i + 1 + j) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 3)]
    want = components(range(len(u)), pairs)
    number = {S._signed(x): i for i, x in enumerate(fps)}
    for bucket in (1024, 3):
        links = [(number[r["a"]], number[r["b"]]) for r in S.fingerprint_links(df, bucket).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
        assert components(range(len(u)), links) == want


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 400)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(200, 400)]}}


def test_documents_against_brute_force(spark):
    docs = many_docs(spark, 150)
    noisy = docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" end")))
    docs = docs.union(noisy)
    rows = docs.collect()
    fp = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    ids = sorted(fp)
    want = components(ids, [(a, b) for a, b in combinations(ids, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in got)


def test_awkward_rows(spark):
    got = S.near_duplicates(awkward_docs(spark, clash=True)).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by[3] == by[4] == by[5] == [("0" * 16, 3)]
    assert by[1] == [by[2][0]] * 2 and by[1][0][1] == 1
    assert S.near_duplicates(awkward_docs(spark).limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    docs = awkward_docs(spark, clash=True)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8]
