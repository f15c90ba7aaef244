"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint is filed under 15 masked copies of itself. The masks come from one structure:
bit i has a non-zero vector m(i) of 4 bits, and mask v keeps the bits whose m(i) has an odd inner
product with v. Three differing bits span at most three dimensions of four, so some v is orthogonal
to all of them, its mask keeps none of them, and the pair meets there: no pair within the radius is
missed. Masks keep about 34 bits, so unrelated fingerprints rarely meet.

Equal fingerprints are one row before anything is compared. Buckets of one are dropped by a counted
join; a bucket above BUCKET members is filed again under 15 masks of the bits its own mask left out
(and once more after that, when at most 8 bits are open and a bucket holds at most 256 different
fingerprints), so no task ever holds more than BUCKET members of a bucket and no pair is lost.

Defined results: null text is empty; a text without words has fingerprint 0 and links to other
zeros; fewer than three words are one shingle; a component whose ids are all null has a null id;
equal rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from evalgrid.llm.common import keyed_rows, row_key
from evalgrid.llm.components import connected_components
from evalgrid.session import cut_lineage

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
TABLES = 2 ** (RADIUS + 1) - 1
LEVELS = 3
BUCKET = 1024
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half the shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n, digest, ones = len(words) - width + 1, xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : min(n, at + _BLOCK)], starts[at + width :])
        h = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in spans), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), index=texts.index)


def covering_masks(bits: list[int]) -> list[int]:
    """15 masks over `bits`: whichever three of them are struck out, one mask keeps none of the three."""
    vector = {b: 1 + i % TABLES for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, TABLES + 1)]


def _mask_levels() -> list[list[int]]:
    """Level by level, mask number 15 * parent + child, each with the bits of its parent."""
    levels = [covering_masks(list(range(BITS)))]
    for _ in range(LEVELS - 1):
        levels.append([m | c for m in levels[-1] for c in covering_masks([b for b in range(BITS) if not m >> b & 1])])
    return levels


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _filed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, t, key) under each child mask of the row's table t; the first level has t = 0."""
    table = F.array(*[F.lit(_signed(m)) for m in masks])
    child = F.explode(F.sequence(F.col("t") * TABLES, F.col("t") * TABLES + TABLES - 1)).alias("t")
    return rows.select("fp", child).select("fp", "t", F.col("fp").bitwiseAND(F.element_at(table, F.col("t") + 1)).alias("key"))


def _spanning(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius in one bucket: a breadth-first tree, so at most
    len(fp) - 1 of them however dense the bucket is."""
    todo, a, b = np.arange(len(fp)), [], []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            near = np.bitwise_count(fp[front[0]] ^ fp[todo]) <= RADIUS
            hit, todo = todo[near], todo[~near]
            a.append(np.full(len(hit), fp[front[0]]))
            b.append(fp[hit])
            front = np.concatenate([front[1:], hit])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a partition sorted by bucket; a bucket's rows may span batches."""

    def links(t, key, fp):
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[new, len(fp)])
        a, b = [], []
        for at in (new[size == 2],):  # most buckets are pairs
            near = np.bitwise_count(fp[at] ^ fp[at + 1]) <= RADIUS
            a.append(fp[at][near])
            b.append(fp[at + 1][near])
        for at, n in zip(new[size > 2], size[size > 2]):
            x, y = _spanning(fp[at : at + n])
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        now[2] = now[2].view(np.uint64)
        t, key, fp = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if not len(t):
            continue
        cut = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0], key[0]) != (t[-1], key[-1]) else 0
        held = [x[cut:] for x in (t, key, fp)]
        if cut:
            yield links(t[:cut], key[:cut], fp[:cut])
    if held is not None:
        yield links(*held)


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all different fingerprints of `fps` (fp: long, distinct) within
    the radius: every pair within it is joined by a path of links."""
    found, rows = [], fps.select("fp", F.lit(0).alias("t"))
    for level, masks in enumerate(_mask_levels()):
        filed = _filed(rows, masks)
        counts = filed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # sizes after the explode are not what the planner thinks: no broadcast here
        shared = cut_lineage(filed.join(counts.hint("merge"), ["t", "key"]))
        last = level == LEVELS - 1
        small = shared if last else shared.where(F.col("n") <= bucket)
        sorted_ = small.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
        found.append(sorted_.mapInArrow(_bucket_links, "a bigint, b bigint"))
        rows = shared.where(F.col("n") > bucket).select("fp", "t")
        if last or rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def classified(docs: DataFrame, keep: list[Column], bucket: int = BUCKET) -> DataFrame:
    """`keep` columns (doc_id among them), fp, root (a fingerprint that names the class) and
    component_id, one row per document."""
    signed = cut_lineage(docs.select(*keep, _fingerprints("text").alias("fp")))
    fps = cut_lineage(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(connected_components(fingerprint_links(fps, bucket)).withColumnRenamed("node", "fp"))
    linked = fps.join(roots, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    classes = fps.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return signed.join(classes, "fp")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id per document."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classified(docs, [F.col("doc_id")], bucket).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest id (a null id only if there is no
    other), all columns as they came."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    kept = classified(docs, [F.col("doc_id"), *row_key(docs)]).groupBy("root").agg(F.min(rank).alias("r")).select("r._k1", "r._k2")
    return keyed_rows(docs).join(kept, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("_row.*")
