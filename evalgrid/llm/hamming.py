"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

Codes are cut into m equal segments, and every different code is filed under (segment, value). The
search grows a radius r from 0: each query probes the values at distance r from its own in every
segment. A code within total distance m(r + 1) - 1 has some segment within r, so once the k-th best
distance found is no larger than that, nothing unseen can be nearer or tie, and the query stops.

A pair is taken only where it is first met (the lowest segment at its smallest segment distance), so
candidates need no deduplication, and only if it can still enter the query's k best: both are part
of the join's condition, and nothing else leaves it. Equal codes are one entry with its k smallest
ids; equal queries are searched once. Rounds are written tables; the driver sees one count a round.

Defined results: rows with a null vector have no code and are neither queries nor results; null and
NaN elements count as 0; ties go to the smaller id, a null id last; a query finds itself; fewer than
k rows give as many as there are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from evalgrid.session import cut_lineage

BITS = 64


@F.pandas_udf(LongType())
def sign_code(vectors: pd.Series) -> pd.Series:
    """Bit i is set if the elements at i, i + 64, i + 128, .. add up to more than 0."""
    out = []
    for v in vectors:
        if v is None:
            out.append(None)
            continue
        x = np.nan_to_num(np.array([0.0 if e is None else e for e in v], np.float64), nan=0.0)
        x = np.pad(x, (0, -len(x) % BITS)).reshape(-1, BITS).sum(axis=0) if len(x) else np.zeros(BITS)
        out.append(int(np.packbits(x > 0, bitorder="little").view("<i8")[0]))
    return pd.Series(out, index=vectors.index, dtype="Int64")


def segment_count(codes: int) -> int:
    """Segments of about log2(codes) bits: 8, 4 or 2 of them."""
    return 8 if codes < 1 << 12 else 4 if codes < 1 << 24 else 2


def _segment(code: Column, j: Column | int, width: int) -> Column:
    shift = F.lit(j * width) if isinstance(j, int) else j * width
    return F.call_function("shiftrightunsigned", code, shift.cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, r: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), r)]


def _probes(queries: DataFrame, m: int, width: int, r: int) -> DataFrame:
    """(qcode, bound, j, value): the values at distance r in each segment."""
    at = queries.select("qcode", "bound", F.explode(F.array(*[F.lit(j) for j in range(m)])).alias("j"))
    # one literal that the optimizer folds into an array, not thousands of expressions
    flips = F.split(F.lit(",".join(map(str, _flips(width, r)))), ",").cast("array<bigint>")
    at = at.select("qcode", "bound", "j", _segment(F.col("qcode"), F.col("j"), width).alias("own"), F.explode(flips).alias("flip"))
    return at.select("qcode", "bound", "j", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))


def _first_met(a: Column, b: Column, j: Column, m: int, width: int, r: int) -> Column:
    """Whether segment j is the first at distance r, none being nearer."""
    d = [F.bit_count(_segment(a.bitwiseXOR(b), i, width)) for i in range(m)]
    return reduce(lambda x, y: x & y, [F.when(F.lit(i) < j, d[i] > r).otherwise(d[i] >= r) for i in range(m)])


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k best (qcode, distance, id) of each query code."""
    order = Window.partitionBy("qcode").orderBy("distance", F.col("id").asc_nulls_last())
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(codes: DataFrame, is_query: Column, k: int, segments: int | None = None) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of `codes` (id, code) to every row of it for
    which `is_query` holds."""
    codes = cut_lineage(codes.where(F.col("code").isNotNull()).select("id", "code", is_query.alias("q")))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last()))
    few = codes.select("id", "code", rank.alias("n")).where(F.col("n") <= k)
    entries = cut_lineage(few.groupBy("code").agg(F.collect_list(F.struct("id")).alias("ids")))
    n_codes = entries.count()
    m = segments or segment_count(n_codes)
    width = BITS // m
    index = entries.select("code", "ids", F.explode(F.array(*[F.lit(j) for j in range(m)])).alias("j"))
    index = cut_lineage(index.select("j", _segment(F.col("code"), F.col("j"), width).alias("value"), "code", "ids"))
    wanted = codes.where("q").select(F.col("code").alias("qcode"))
    active, done = cut_lineage(wanted.distinct().withColumn("bound", F.lit(BITS))), []
    state = None
    for r in range(width + 1):
        probes = _probes(active, m, width, r)
        a, b = F.col("qcode"), F.col("code")
        near = F.bit_count(a.bitwiseXOR(b))
        # the planner does not see how many probes a query has, and would broadcast them
        met = probes.hint("merge").join(index, ["j", "value"]).where((near <= F.col("bound")) & _first_met(a, b, F.col("j"), m, width, r))
        found = met.select("qcode", near.alias("distance"), F.explode("ids").alias("e")).select("qcode", "distance", "e.id")
        state = cut_lineage(_best(found if state is None else state.unionByName(found), k).drop("rank"))
        reach = state.groupBy("qcode").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("bound"))
        left = active.drop("bound").join(reach, "qcode", "left").withColumn("bound", F.when(F.col("n") >= k, F.col("bound")).otherwise(BITS)).select("qcode", "bound")
        covered = m * (r + 1) - 1
        active = cut_lineage(left.where(F.col("bound") > covered))
        done.append(state.join(active, "qcode", "left_anti") if r < width else state)
        if r == width or active.isEmpty():
            break
        state = cut_lineage(state.join(active.select("qcode"), "qcode"))
    best = _best(reduce(lambda x, y: x.unionByName(y), done), k)
    queries = codes.where("q").select(F.col("id").alias("query_id"), F.col("code").alias("qcode"))
    return queries.join(best, "qcode").select("query_id", "rank", "id", "distance")
