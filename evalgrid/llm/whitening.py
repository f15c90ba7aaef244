"""Embedding whitening on exact integers.

Entries go to a grid of integers. Spark sums the different vectors and the products of their entries,
centred at the whole numbers nearest the means, without rounding; n^2 times their covariance is then
an integer matrix. Its characteristic polynomial (modulo primes, a task for each few of them, joined
by Chinese remaindering) gives the eigenvalues as exactly counted and isolated roots, and tasks find
the unit vectors of their null spaces in high precision (`charpoly`). Everything is rounded once, to
doubles, at the end.

The driver holds d x d integers for vectors of d entries, whatever the number of rows; its work on the
polynomial grows with d^3 (a second for 64 entries).

Defined results: rows whose vector is null, or holds a null or non-finite entry, are left out, as are
vectors whose length is not the one that most rows have (ties: the longer). Grid values stop at 2^61.
Equal vectors count once in the fit, and each of their rows gets its results. A component without any
spread (eigenvalue 0) has explained 0 and whitened null, and no part in identity_error; a table
without any spread has explained and identity_error null. deviation is null where it exceeds a long.
No rows, or vectors without entries: no result rows. Equal eigenvalues: any orthogonal vectors of their
space, the same for all rows; the sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from evalgrid.llm import charpoly
from evalgrid.session import cut_lineage

GRID = 64
OFFSET = 1_000_000
MOST = 16  # components
_EDGE = float(1 << 61)
_LIMB = 60
_PRIMES_A_TASK = 32


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # of the fit list, per dimension
    explained: tuple[float | None, ...]  # one per component
    directions: tuple[tuple[float, ...], ...]  # of the components with spread, unit vectors
    scales: tuple[float, ...]  # n times the root of their eigenvalues
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit where that is enough, else integers of any size."""
        wide = int(np.abs(x).max(initial=0)) * self.n >= 1 << 61
        return x.astype(object) * self.n - np.array(self.sums, object) if wide else x * self.n - np.array(self.sums, np.int64)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        d = len(self.sums)
        return deviations.astype(float) @ (np.array(self.directions).reshape(-1, d).T / np.array(self.scales))


def gridded(vectors: DataFrame, column: str, keep: list[Column]) -> DataFrame:
    """`keep` columns and _x, the grid values of `column`, of the rows that take part."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    on_grid = lambda c: F.floor(F.greatest(F.least(c.cast("double") * GRID, F.lit(_EDGE)), F.lit(-_EDGE))) + OFFSET
    rows = vectors.where(F.col(column).isNotNull()).where(finite).select(*keep, F.transform(column, on_grid).alias("_x"))
    size = F.size("_x")
    usual = rows.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(size == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _exact_gram(z: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, exact, as integers of any size."""
    if int(np.abs(z).max(initial=0)) ** 2 * len(z) < 1 << 53:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    return z.astype(object).T @ z.astype(object)


def _scatter(fit: DataFrame, center: list[int]) -> tuple[list[int], np.ndarray]:
    """Per dimension the sum of x - center over the fit list, and the sums of their products."""
    d, mask = len(center), (1 << _LIMB) - 1
    i, j = np.tril_indices(d)
    mid = np.array(center, np.int64)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gram = np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                z = _matrix(batch.column(0)) - mid
                sums = sums + (z.astype(object) if np.abs(z).max() > 1 << 40 else z).sum(axis=0).astype(object)
                gram = gram + _exact_gram(z)
        values = [*sums.tolist(), *gram[i, j].tolist()]
        keys = [pa.array(np.r_[np.full(d, -1), i].astype(np.int32)), pa.array(np.r_[np.arange(d), j].astype(np.int32))]
        limbs = [pa.array(v, pa.decimal128(38, 0)) for v in ([int(v) >> _LIMB for v in values], [int(v) & mask for v in values])]
        yield pa.RecordBatch.from_arrays([*keys, *limbs], ["i", "j", "high", "low"])

    got = fit.select("_x").mapInArrow(parts, "i int, j int, high decimal(38,0), low decimal(38,0)")
    got = got.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums, gram = [0] * d, np.zeros((d, d), object)
    for r in got:
        value = (int(r["high"]) << _LIMB) + int(r["low"])
        if r["i"] < 0:
            sums[r["j"]] = value
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = value
    return sums, gram


def characteristic(spark: SparkSession, matrix: np.ndarray) -> tuple[list[int], list[int]]:
    """Coefficients of det(x - matrix), and the primes it was remaindered from. Each task takes a few."""
    moduli = charpoly.primes(charpoly.coefficient_bits(int(np.trace(matrix)), len(matrix)))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            for at in range(0, len(own), _PRIMES_A_TASK):
                some = own[at : at + _PRIMES_A_TASK]
                c = charpoly.characteristic_mod(matrix, some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(-(-len(moduli) // _PRIMES_A_TASK))
    found = {r["p"]: r["c"] for r in dealt.mapInArrow(residues, "p bigint, c array<bigint>").collect()}
    return charpoly.remaindered(moduli, [found[p] for p in moduli]), moduli


def _components(spark: SparkSession, matrix: np.ndarray, most: int) -> list[tuple[float, float, list[float]]]:
    """Share of the trace, root of the eigenvalue, and unit vector of the largest positive ones."""
    poly, moduli = characteristic(spark, matrix)
    simple, trace = charpoly.squarefree(poly, moduli), int(np.trace(matrix))
    intervals = charpoly.isolate(poly, simple, most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, at, level, times in zip(*[c.to_pylist() for c in batch.columns]):
                value, found = charpoly.null_vectors(matrix, simple, int(at), level, times)
                with localcontext(Context(prec=60)):
                    share, root = float(value / trace), float(value.sqrt())
                n = len(found)
                rows = [pa.array([place] * n), pa.array([share] * n), pa.array([root] * n), pa.array([[float(x) for x in v] for v in found])]
                yield pa.RecordBatch.from_arrays(rows, ["place", "share", "root", "direction"])

    listed = [(k, str(at), level, times) for k, (at, level, times) in enumerate(intervals)]
    if not listed:
        return []
    tasks = spark.createDataFrame(listed, "place bigint, at string, level bigint, times bigint").repartition(len(listed))
    got = tasks.mapInArrow(vectors, "place bigint, share double, root double, direction array<double>").collect()
    out = []
    for r in sorted(got, key=lambda r: r["place"]):
        largest = max(r["direction"], key=abs)
        out.append((r["share"], r["root"], [x if largest > 0 else -x for x in r["direction"]]))
    return out[:most]


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity: products are centred
    in each task, and the tasks' own means are brought together."""
    k = len(model.scales)
    i, j = np.tril_indices(k)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(model.deviations(_matrix(batch.column(0))))
                mean = w.mean(axis=0)
                gram = (w - mean).T @ (w - mean)
                cells = [i.astype(np.int32), j.astype(np.int32), gram[i, j], np.full(len(i), len(w), float), mean[i], mean[j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["i", "j", "products", "rows", "mi", "mj"])

    got = fit.select("_x").mapInArrow(parts, "i int, j int, products double, rows double, mi double, mj double")
    own = F.sum(F.col("rows") * F.col("mi") * F.col("mj")) - F.sum(F.col("rows") * F.col("mi")) * F.sum(F.col("rows") * F.col("mj")) / F.sum("rows")
    cov = got.groupBy("i", "j").agg(((F.sum("products") + own) / F.sum("rows")).alias("c"))
    return cov.agg(F.max(F.abs(F.col("c") - (F.col("i") == F.col("j")).cast("double")))).first()[0]


def learn(rows: DataFrame, most: int = MOST) -> Whitening | None:
    """The whitening of the different vectors in column _x, all of one length; None without any."""
    spark = rows.sparkSession
    fit = cut_lineage(rows.select("_x").distinct())
    totals = fit.select(F.posexplode("_x").alias("i", "x")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    totals = sorted(totals.collect(), key=lambda r: r["i"])
    if not totals:
        return None
    n = totals[0]["n"]
    center = [int(r["s"]) // n for r in totals]
    sums, gram = _scatter(fit, center)
    matrix = gram * n - np.outer(np.array(sums, object), np.array(sums, object))
    trace = int(np.trace(matrix))
    found = _components(spark, matrix, min(most, len(totals))) if trace else []
    rest = min(most, len(totals)) - len(found)
    explained = (*[share for share, _, _ in found], *[0.0 if trace else None] * rest)
    model = Whitening(n, tuple(int(r["s"]) for r in totals), explained, tuple(tuple(v) for _, _, v in found), tuple(root for _, root, _ in found))
    if not found:
        return model
    return Whitening(model.n, model.sums, model.explained, model.directions, model.scales, _identity_error(fit, model))


OUT = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType())]


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """The columns of `rows` before _x (which is last), and for each component: its number, n, the row's
    deviation and whitened value, explained and identity_error."""
    schema = StructType([*rows.schema.fields[:-1], *[StructField(c, t) for c, t in OUT]])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, found = len(model.explained), len(model.scales)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            dev = model.deviations(_matrix(batch.column(batch.num_columns - 1)))
            if int(np.abs(dev).max()) ** 2 * dev.shape[1] < 1 << 63:
                square = pa.array((dev * dev).sum(axis=1).astype(np.int64))
            else:
                exact = (dev.astype(object) ** 2).sum(axis=1).tolist()
                square = pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())
            values = np.full((m, k), np.nan)
            values[:, :found] = model.whiten(dev)
            each = pa.array(np.repeat(np.arange(m), k))
            own = [c.take(each) for c in batch.columns[:-1]]
            flat = pa.array(values.ravel(), mask=np.tile(np.arange(k) >= found, m))
            same = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), square.take(each), flat]
            same.append(pa.array(list(model.explained) * m, pa.float64()))
            same.append(pa.array([model.identity_error] * (m * k), pa.float64()))
            yield pa.RecordBatch.from_arrays([*own, *same], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def whitened(vectors: DataFrame, column: str, keep: list[Column], most: int = MOST) -> DataFrame:
    """`keep` columns and the results of `whiten` for each row of `vectors` that takes part."""
    rows = cut_lineage(gridded(vectors, column, keep))
    return whiten(rows, learn(rows, most))
