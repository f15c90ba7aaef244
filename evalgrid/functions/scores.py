"""Scalar scores and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clamp of the information rate, reading window, verdict bands.
BITS_EPS = 1e-9
READING_WINDOW_S = 0.8
SNR_BANDS = [(1.5, "nothing to recover"), (3.0, "marginal"), (None, "workable")]
CORR_BANDS = [(0.3, "useless"), (0.6, "weak"), (None, "usable")]


def rate(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is zero or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def bits_per_selection(p: Column, n: Column, floor_at_chance: bool = True) -> Column:
    """Information per selection among n choices at accuracy p.

    With `floor_at_chance` anything at or below 1/n carries no bits; without it the formula is
    used as it stands, with n - 1 kept at least 1.
    """
    q = F.least(F.greatest(p, F.lit(BITS_EPS)), F.lit(1 - BITS_EPS))
    rest = (n - 1) if floor_at_chance else F.greatest(n - 1, F.lit(1))
    bits = F.log2(n.cast("double")) + q * F.log2(q) + (1 - q) * F.log2((1 - q) / rest)
    return F.when(q <= 1 / n, F.lit(0.0)).otherwise(bits) if floor_at_chance else bits


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def banded(value: Column, bands) -> Column:
    """Label of the first band whose upper bound exceeds the value; null stays null."""
    out = F.lit(None).cast("string")
    for bound, label in reversed(bands):
        out = F.lit(label) if bound is None else F.when(value < bound, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def snr_verdict(snr: Column) -> Column:
    return banded(snr, SNR_BANDS)


def corr_verdict(r: Column) -> Column:
    return banded(F.abs(r), CORR_BANDS)


def readings_per_dwell(fps: Column, dwell_ms: Column) -> Column:
    return fps * dwell_ms / 1000.0


def same_item(item: Column, cue: Column) -> Column:
    """A missing item is simply wrong."""
    return F.coalesce(item.cast("string") == cue.cast("string"), F.lit(False))


def verdict(category: Column, pos: Column, neg: Column) -> Column:
    """correct / wrong / unverifiable; an unmatched item (null category) is unverifiable."""
    hit = F.coalesce(F.array_contains(pos, category), F.lit(False))
    miss = F.coalesce(F.array_contains(neg, category), F.lit(False))
    return F.when(hit, "correct").when(miss, "wrong").otherwise("unverifiable")


def lenient(category: Column, group: Column, pos: Column) -> Column:
    """Correct, or a category of the same equivalence group is present."""
    hit = F.coalesce(F.array_contains(pos, category), F.lit(False))
    return hit | F.coalesce(F.arrays_overlap(group, pos), F.lit(False))


def hypothesis_verdict(lower: Column, threshold: float = 0.75) -> Column:
    """Supported iff the interval's lower end reaches the threshold; null without data."""
    return F.when(lower.isNotNull(), lower >= threshold)


def extended_labels(pos: Column, neg: Column, other_pos: Column, pos_ok: Column, neg_ok: Column, known: Column):
    """Merge a second, exhaustive label source: (pos_x, neg_x), both sorted.

    Its positives count unless the first source verified them absent; its absences count only
    where it labelled the unit at all (`known`), and never against a positive of either source.
    """
    pos_x = F.array_union(pos, F.array_except(F.array_intersect(other_pos, pos_ok), neg))
    absent = F.when(known, F.array_except(neg_ok, other_pos)).otherwise(F.filter(neg_ok, lambda _: F.lit(False)))
    neg_x = F.array_except(F.array_except(F.array_union(neg, absent), pos), other_pos)
    return F.sort_array(pos_x), F.sort_array(neg_x)


def first_class(members: Column, classes: list[tuple[str, list]]) -> Column:
    """Name of the first class, in priority order, whose indicators intersect `members`."""
    return F.coalesce(
        *[
            F.when(F.arrays_overlap(members, F.array(*[F.lit(i) for i in ids])), F.lit(name))
            for name, ids in classes
        ]
    )
