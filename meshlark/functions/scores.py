"""Confidence tiers and combinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM, MARGIN = 0.75, 0.55, 0.08


def tier(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(score >= high, "accepted").when(score >= medium, "flagged").otherwise("unresolved")


def combine(*values: Column) -> Column:
    """Geometric mean of those that are not null; 0 if one is 0 or less, NULL if there is none."""
    some = F.array_compact(F.array(*[v.cast("double") for v in values]))
    logs = F.aggregate(some, F.lit(0.0), lambda a, v: a + F.log(F.when(v > 0, v)))
    return F.when(F.size(some) == 0, None).when(F.array_min(some) <= 0, 0.0).otherwise(F.exp(logs / F.size(some)))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """The sum of weight * part, in order (so that floats agree with a plain loop), within 0..1."""
    total = None
    for weight, part in parts:
        term = F.lit(weight) * part
        total = term if total is None else total + term
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
