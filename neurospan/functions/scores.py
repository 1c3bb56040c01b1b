"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speculative(caa: Column, cab: Column, cba: Column, cbb: Column) -> Column:
    return F.greatest(F.least(caa, cab), F.least(cba, cbb))


def tiered(tiers: list[tuple[Column, Column]], otherwise: float = float("inf")) -> Column:
    """The score of the first tier whose condition holds."""
    out = F.when(*tiers[0])
    for condition, score in tiers[1:]:
        out = out.when(condition, score)
    return out.otherwise(F.lit(otherwise))


def by_resolution(resolution: Column, iou: Column, tiers32: Column, tiers16: Column) -> Column:
    """Dispatch on the resolution in nm: 8 gives 10 and the lack of overlap; unknown ones are infinite. FLOAT, as stored."""
    return tiered([(resolution == 32, tiers32), (resolution == 16, tiers16), (resolution == 8, 10 + (1 - iou))]).cast("float")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tab_of(x: Column, boundaries: list[int], tabs: int) -> Column:
    """Number of the tab that an x coordinate is in, counted from the far side."""
    edges = F.array(*(F.lit(b) for b in sorted(boundaries)))
    return (F.lit(tabs) - F.size(F.filter(edges, lambda b: b < x))).cast("int")
