"""Hash draws and the normal distribution as column expressions.

Draws depend only on (seed, replicate, slot), never on partitioning, so a rerun, a retried task
or another SQL engine gives the same numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 32-bit integer mixing (public multiply-xorshift constants).
MASK = 0xFFFFFFFF
MIX = 0x45D9F3B
SEED_STEP = 374761393
REP_STEP = 668265263
SLOT_STEP = 1640531527

# Acklam's rational approximation of the normal quantile.
ACKLAM_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
ACKLAM_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
ACKLAM_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
ACKLAM_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
ACKLAM_SPLIT = 0.02425
# Chebyshev fit of erfc (Numerical Recipes), error below 1.2e-7.
ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]


def _fold(x: Column) -> Column:
    return F.shiftright(x, 16).bitwiseXOR(x)


def add_hash(df: DataFrame, seed: Column, rep: Column, slot: Column, out: str) -> DataFrame:
    """Add a 32-bit hash of (seed, replicate, slot), scrambled in steps.

    Each step is its own projection: as one expression every step would repeat the one before.
    """
    low = slot.cast("bigint").bitwiseAND(F.lit(MASK))
    base = seed.cast("bigint") * F.lit(SEED_STEP) + rep.cast("bigint") * F.lit(REP_STEP) + low * F.lit(SLOT_STEP)
    df = df.withColumn(out, base.bitwiseAND(F.lit(MASK)))
    for _ in range(2):
        df = df.withColumn(out, (_fold(F.col(out)) * F.lit(MIX)).bitwiseAND(F.lit(MASK)))
    return df.withColumn(out, _fold(F.col(out)))


def poisson_thresholds() -> list[int]:
    """Hash values from which a Poisson(1) variate is at least 1, 2, ..: all that 32 bits can tell."""
    out, p, cum, k = [], math.exp(-1), 0.0, 0
    while (at := math.ceil((cum := cum + p) * (MASK + 1))) <= MASK:
        out.append(at)
        k += 1
        p /= k
    return out


def weights_room(shape: tuple[int, ...]) -> list[np.ndarray]:
    """What poisson_weights works in: taken once where it is called often, as new memory costs more."""
    return [np.empty(shape, kind) for kind in (np.uint32, np.uint32, np.uint8, bool, np.float64)]


def poisson_weights(seed: int, rep: np.ndarray, slot: np.ndarray, room: list[np.ndarray] | None = None) -> np.ndarray:
    """Poisson(1) weights for arrays inside a task: the hash of add_hash, in wrapping 32 bits, against
    poisson_thresholds up to the greatest hash. With `room` the result lies there."""
    low = lambda x: (x & MASK).astype(np.uint32)
    base, slot = np.atleast_1d(low(np.asarray(seed * SEED_STEP + rep * REP_STEP))), low(np.asarray(slot)) * np.uint32(SLOT_STEP)
    x, y, w, more, out = room or weights_room(np.broadcast_shapes(base.shape, slot.shape))
    np.add(base, slot, out=x)
    for _ in range(2):
        np.bitwise_xor(np.right_shift(x, np.uint32(16), out=y), x, out=x)
        np.multiply(x, np.uint32(MIX), out=x)
    np.bitwise_xor(np.right_shift(x, np.uint32(16), out=y), x, out=x)
    w[...], top = 0, int(x.max(initial=0))
    for at in poisson_thresholds():
        if at > top:
            break
        np.add(w, np.greater_equal(x, np.uint32(at), out=more).view(np.uint8), out=w)
    out[...] = w
    return out


def md5_rank(seed: int | str, *parts: Column) -> Column:
    """Sort key of a seeded shuffle: the md5 of 'seed:part:part'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _poly(x: Column, coef: list[float]) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.lit(2.0) ** 0.5
    t = 1.0 / (1.0 + 0.5 * x)
    tail = t * F.exp(-x * x + _poly(t, ERFC))
    return F.when(z >= 0, 1.0 - tail / 2).otherwise(tail / 2)


def normal_quantile(p: Column) -> Column:
    """Inverse of normal_cdf for 0 < p < 1, null outside."""
    q = p - 0.5
    r = q * q
    middle = q * _poly(r, ACKLAM_A) / _poly(r, ACKLAM_B)

    def tail(share: Column) -> Column:
        t = F.sqrt(-2.0 * F.log(share))
        return _poly(t, ACKLAM_C) / _poly(t, ACKLAM_D)

    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < ACKLAM_SPLIT, tail(p))
        .when(p > 1 - ACKLAM_SPLIT, -tail(1 - p))
        .otherwise(middle)
    )
