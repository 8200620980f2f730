"""Saturating conversions, rationals and lookup curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saturate(v: Column, high: int = 65535) -> Column:
    """Truncation with saturation; NaN and null become 0."""
    safe = F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.floor(F.least(F.greatest(safe, F.lit(0.0)), F.lit(float(high)))).cast("long")


def scale_bits(v: Column, bits: int) -> Column:
    """n-bit samples to 16 bits."""
    return F.floor(v / float((1 << bits) - 1) * 65535).cast("long")


def compare(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """-1, 0 or 1 of two rationals by cross-multiplication, without overflow."""
    wide = lambda c: c.cast("decimal(19,0)")
    a, b = wide(n1) * wide(d2), wide(n2) * wide(d1)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def doubling_curve(points: list[int], size: int) -> Column:
    """SQL value of a curve over the column x whose slope doubles at each point."""
    edges = [0, *points, size]
    out, base = F.lit(0), 0
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = F.when(F.col("x") >= a, F.lit(base) + (F.col("x") - a) * (1 << i)).otherwise(out)
        base += (b - a) * (1 << i)
    return out.cast("long")


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner's rule, plus the identity."""
    acc = F.lit(0.0)
    for k in reversed(coefficients):
        acc = acc * x + F.lit(float(k))
    return acc + x


def lut(values: DataFrame, key: str, curve: DataFrame) -> DataFrame:
    """value -> curve[value]; a curve has at most 65,536 rows (x, y)."""
    return values.join(F.broadcast(curve), F.col(key) == F.col("x"), "left")
