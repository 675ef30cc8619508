"""Interval arithmetic as column expressions; an interval is a pair (lo, hi)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def iou(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Shared length over covered length; 0 when nothing is covered."""
    shared = overlap(lo_a, hi_a, lo_b, hi_b)
    covered = (hi_a - lo_a) + (hi_b - lo_b) - shared
    return F.when(covered > 0, shared / covered).otherwise(F.lit(0.0))


def unshared(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Length covered by exactly one of two intervals; null when either is missing."""
    both = (hi_a - lo_a) + (hi_b - lo_b)
    return F.when(both.isNotNull(), both - 2.0 * overlap(lo_a, hi_a, lo_b, hi_b))


def contains(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Whether a covers all of b."""
    return (lo_a <= lo_b) & (hi_a >= hi_b)


def holds(lo: Column, hi: Column, point: Column) -> Column:
    return (lo <= point) & (point <= hi)


def midpoint(lo: Column, hi: Column) -> Column:
    return 0.5 * (lo + hi)
