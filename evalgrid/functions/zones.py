"""Screen zones: position -> grid cell, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grids every accuracy table reports, as (name, rows, columns).
GRIDS = [("1x2", 1, 2), ("2x1", 2, 1), ("1x3", 1, 3), ("2x2", 2, 2), ("3x3", 3, 3), ("4x4", 4, 4)]
# Fixed value: threshold of the fixed-threshold estimator (0.333, not one third).
THETA = 0.333
NO_ZONE = -1


def _col(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def _cell(scaled: Column, n: Column) -> Column:
    return F.least(F.greatest(F.floor(scaled), F.lit(0)), n - 1).cast("int")


def zone_of(x, y, rows, cols) -> Column:
    """Grid cell of a normalised position, off-screen clamped to the edge; NO_ZONE without one."""
    x, y, rows, cols = _col(x), _col(y), _col(rows), _col(cols)
    cell = _cell(y * rows, rows) * cols + _cell(x * cols, cols)
    return F.when(finite(x) & finite(y), cell).otherwise(F.lit(NO_ZONE)).cast("int")


def threshold_zone(x, y, theta: float = THETA, side: int = 3) -> Column:
    """Zone by dividing through a fixed threshold; not the same as multiplying by `side`."""
    x, y, n = _col(x), _col(y), F.lit(side)
    cell = _cell(y / F.lit(theta), n) * n + _cell(x / F.lit(theta), n)
    return F.when(finite(x) & finite(y), cell).otherwise(F.lit(NO_ZONE)).cast("int")


def strip_zone(x, zones) -> Column:
    """One-dimensional zone along x."""
    return zone_of(x, F.lit(0.0), F.lit(1), zones)


def grid_list(grids=None) -> Column:
    """The grids as an array of structs, to explode next to facts in one pass."""
    return F.array(
        *[
            F.struct(F.lit(g).alias("grid"), F.lit(r).alias("rows"), F.lit(c).alias("cols"))
            for g, r, c in (grids or GRIDS)
        ]
    )


def from_pixels(px, extent) -> Column:
    """Screen fraction of a pixel position."""
    return _col(px) / _col(extent)
