"""Robust statistics of small arrays, as Columns: groups are samples along an edge, never whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def percentile(ordered: Column, part: float) -> Column:
    """Linear interpolation between neighbours of a sorted array."""
    at = F.lit(part) * (F.size(ordered) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return F.when(low == high, a).otherwise(a * (high - at) + b * (at - low))


def nearest_rank(ordered: Column, part: float) -> Column:
    return F.get(ordered, F.floor((F.size(ordered) - 1) * part + 0.5).cast("int"))


def truncated_rank(ordered: Column, part: float) -> Column:
    return F.get(ordered, F.least(F.floor(F.size(ordered) * part).cast("int"), F.size(ordered) - 1))


def trimmed_mean(ordered: Column, part: float) -> Column:
    """The mean without so many of the lowest and as many of the highest."""
    cut = F.floor(F.size(ordered) * part).cast("int")
    kept = F.slice(ordered, cut + 1, F.size(ordered) - cut * 2)
    return F.when(F.size(kept) == 0, percentile(ordered, 0.5)).otherwise(total(kept) / F.size(kept))


def consistency(positive: Column, negative: Column) -> Column:
    return F.when(positive + negative > 0, F.greatest(positive, negative) / (positive + negative)).otherwise(0.0)


def narrow_place(values: Column) -> Column:
    """Where widths are narrowest, counted from 0, if that is narrow against their upper quarter; an eighth at each end does not count.  Null under eight values."""
    n = F.size(values)
    cut = F.greatest(F.lit(1), F.floor(n * 0.12 + 0.5)).cast("int")
    core = F.slice(values, cut + 1, F.greatest(n - cut * 2, F.lit(0)))
    low, high = F.array_min(core), percentile(F.array_sort(core), 0.75)
    return F.when((n >= 8) & (high > 0) & (low / high <= 0.42), cut + F.array_position(core, low).cast("int") - 1)


def outer_offset(values: Column) -> Column:
    """How far an outline reaches beyond an edge: a high percentile of what lies outside, 0 if nothing does."""
    outside = F.array_sort(F.filter(values, lambda v: v >= 0))
    return F.when(F.size(outside) > 0, percentile(outside, 0.88)).otherwise(0.0)


def tapered(value: Column, x: Column, start: Column, width: Column) -> Column:
    """An offset that fades to nothing towards either end of a region, over 8 % of its width but two columns at least; 0 outside."""
    fade = F.greatest(F.lit(2.0), F.floor(width * 0.08 + 0.5))
    near = F.least(x - start, start + width - 1 - x)
    return F.when(near < 0, 0.0).otherwise(value * F.least(F.lit(1.0), near / fade))
