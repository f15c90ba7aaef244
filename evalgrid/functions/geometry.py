"""Eye and head geometry from landmark columns, as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard against zero lengths, opening below which the lid ratio is undefined, its range.
TINY = 1e-9
SHUT = 0.05
FLAT = 1e-6
LID_RANGE = (-1.0, 2.0)

Point = tuple[Column, Column]


def eye_geometry(outer: Point, inner: Point, upper: Point, lower: Point, iris: Point) -> dict[str, Column]:
    """Iris position within the eye, all as products over the squared corner distance.

    With corner axis c = inner - outer, width w = |c| and a point p relative to the outer corner:
    h = p.c / w^2 (0 at the outer corner, 1 at the inner), v = (c x p) / w^2 signed so that down the
    image is positive for either eye, open = lid distance / w, and vlid = the same cross product of
    the iris below the upper lid over that of the lower lid, within LID_RANGE; null when nearly shut.
    """

    def rel(p: Point, q: Point) -> Point:
        return p[0] - q[0], p[1] - q[1]

    def dot(p: Point, q: Point) -> Column:
        return p[0] * q[0] + p[1] * q[1]

    c = rel(inner, outer)
    w2 = F.greatest(dot(c, c), F.lit(TINY**2))
    turn = F.when(c[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))

    def depth(p: Point) -> Column:
        """Distance down the image from the corner axis, times the width."""
        return turn * (c[0] * p[1] - c[1] * p[0])

    gap, width = rel(lower, upper), F.sqrt(w2)
    opening = F.sqrt(dot(gap, gap) / w2)
    part = F.try_divide(depth(rel(iris, upper)), depth(gap))
    sighted = (opening >= SHUT) & (F.abs(depth(gap)) > FLAT * width)
    return {
        "h": dot(rel(iris, outer), c) / w2,
        "v": depth(rel(iris, outer)) / w2,
        "vlid": F.when(sighted, F.greatest(F.lit(LID_RANGE[0]), F.least(F.lit(LID_RANGE[1]), part))),
        "open": opening,
        "width_px": width,
    }


def head_angles(r: list[list[Column]]) -> dict[str, Column]:
    """Yaw, pitch and roll in degrees of a rotation Rz(roll) Ry(yaw) Rx(pitch)."""
    s = F.least(F.greatest(-r[2][0], F.lit(-1.0)), F.lit(1.0))
    return {
        "yaw": F.degrees(F.asin(s)),
        "pitch": F.degrees(F.atan2(r[2][1], r[2][2])),
        "roll": F.degrees(F.atan2(r[1][0], r[0][0])),
    }


def centred(points: Column, nose: Column) -> Column:
    """Mean of an array of coordinates relative to the nose, moved to mid-screen."""
    total = F.aggregate(points, F.lit(0.0), lambda a, x: a + x)
    return total / F.size(points) - nose + 0.5
