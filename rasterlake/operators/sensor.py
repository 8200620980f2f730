"""Sensor rules on rows: defects, luma and chroma, levels and phases of formats, plane placement, rectangles, byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .curves import cut


def bad_columns(px: DataFrame, columns: list[int], height: int) -> DataFrame:
    """Samples of the listed columns anew, two lines from the edges on; the colour pattern is RGGB.

    Green: the mean of three of the four diagonal neighbours, without the farthest from their mean, rounded. Red and blue: the
    four neighbours two places off diagonally weigh 0.0732233 and the two of the line 0.3535534. All are read before any
    is replaced, so that neighbouring bad columns see each other's old samples. Only listed columns are gathered.
    """
    near = {"nw": (-1, -1), "sw": (1, -1), "ne": (-1, 1), "se": (1, 1), "a": (2, -2), "b": (-2, -2), "d": (2, 2), "e": (-2, 2), "w2": (0, -2), "e2": (0, 2)}
    listed = F.col("c").isin(columns)
    reach = sorted({c + k for c in columns for k in range(-2, 3)})
    some = grid.neighbours(px.filter(F.col("c").isin(reach)), near).filter(listed & F.col("r").between(2, height - 3))
    diag = [F.col(n) for n in ("nw", "sw", "ne", "se")]
    total = sum(diag[1:], diag[0])
    off = [F.abs(x * 4 - total) for x in diag]
    far = F.greatest(*off)
    out = F.coalesce(*(F.when(o == far, x) for o, x in zip(off, diag, strict=True)))
    green = F.floor((total - out + 1) / 3)
    other = F.floor((F.col("a") + F.col("b") + F.col("d") + F.col("e")) * 0.0732233 + (F.col("w2") + F.col("e2")) * 0.3535534 + 0.5)
    keys = [*grid.image(px), "r", "c"]
    fixed = some.select(*keys, F.when(F.pmod(F.col("r") + F.col("c"), F.lit(2)) == 1, green).otherwise(other).cast("long").alias("new"))
    return px.join(fixed, keys, "left").select(*keys, F.coalesce("new", "v").alias("v"))


def luma_chroma(y: Column, cb: Column, cr: Column, zero: int = 16383) -> list[Column]:
    """Red, green and blue from luma and chroma around zero, cut to 16 bits."""
    b, r = cb - zero, cr - zero
    return [cut(F.round(x, 6)) for x in (y + r * 1.4, y + b * -0.343 + r * -0.711, y + b * 1.765)]


def small_raw(version: int, y: Column, cb: Column, cr: Column, gains: tuple[int, int, int], hue: int = 0, zero: int = 16383) -> list[Column]:
    """Red, green and blue of reduced raw frames in whole numbers; versions 0 and 2 differ by luma's offset of 512."""
    right = F.shiftright
    y, b, r = (x.cast("long") for x in (y, cb - zero, cr - zero))
    if version == 1:
        b, r = b * 4 + hue, r * 4 + hue
        parts = right(b * 50 + r * 22929, 14), right(b * -5640 - r * 11751, 14), right(b * 29040 - r * 101, 14)
    else:
        y = y - 512 if version == 0 else y
        parts = r, right(b * -778 - r * 2048, 12), b
    return [F.least(F.greatest(right((y + p) * g, 8), F.lit(0)), F.lit(65535)).cast("long") for p, g in zip(parts, gains, strict=True)]


def white_from_xy(x: Column, y: Column, matrix: list[list[float]]) -> list[Column]:
    """Balance of a white point: the reciprocal of each row times X, Y, Z; 0 where the point or the product is not positive."""
    xyz = x / y, F.lit(1.0), (1 - x - y) / y
    rows = (sum((v * float(k) for v, k in zip(xyz[1:], row[1:], strict=True)), xyz[0] * float(row[0])) for row in matrix)
    return [F.coalesce(F.when((y > 0) & (s > 0), 1 / s), F.lit(0.0)) for s in rows]


def rational(x: Column, denominator: int) -> Column:
    """Numerator of x over a fixed denominator, cut towards zero after three digits."""
    return cut(F.round(x * denominator, 3), -(1 << 31), (1 << 31) - 1)


def field_tone(v: Column, bits: int) -> Column:
    """Square-law tone of 8-bit codes, moved to the top of so many bits above 14; larger codes stay."""
    return F.when(v < 256, F.shiftleft(F.floor(v * v / 3.969 + 0.5).cast("long"), bits)).otherwise(v)


def low_bits(high: DataFrame, low: DataFrame, bits: int = 2) -> DataFrame:
    """Samples with further low bits that lie elsewhere, by place; a missing one is 0."""
    keys = [*grid.image(high), "r", "c"]
    return high.join(low.select(*keys, F.col("v").alias("low")), keys, "left").select(*keys, (F.col("v") * (1 << bits) + F.coalesce("low", F.lit(0))).cast("long").alias("v"))


def placed_planes(px: DataFrame) -> DataFrame:
    """Four half-size planes (plane, r, c, v) to one pattern: planes 0 to 3 are upper left, upper right, lower left, lower right."""
    return px.select(*grid.image(px), (F.col("r") * 2 + F.floor(F.col("plane") / 2)).cast("long").alias("r"), (F.col("c") * 2 + F.pmod(F.col("plane"), F.lit(2))).cast("long").alias("c"), "v")


def colour_at(pattern: str, side: int, r: Column, c: Column, top: int = 0, left: int = 0) -> Column:
    """Letter of a side x side colour pattern at a place; top and left move the pattern's origin."""
    at = F.pmod(r - top, F.lit(side)) * side + F.pmod(c - left, F.lit(side))
    return F.element_at(F.split(F.lit(pattern), ""), (at + 1).cast("int"))


def first_usable(rows: DataFrame, group: str, order: str, usable: Column) -> DataFrame:
    """Of each group the first row that is usable; groups without one are left out. A minimum, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c != group]
    return rows.filter(usable).groupBy(group).agg(F.min_by(F.struct(*rest), order).alias("f")).select(group, "f.*")


def by_rank(rows: DataFrame, group: str, key: str, ranking: list) -> DataFrame:
    """Of each group the row whose key comes first in the ranking; keys outside it do not count."""
    rank = F.array_position(F.array(*map(F.lit, ranking)), F.col(key))
    return first_usable(rows.withColumn("rank", rank), group, "rank", F.col("rank") > 0).drop("rank")


def from_borders(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Rectangle (x, y, w, h) within borders; null if they cross."""
    w, h = width - right - left, height - bottom - top
    return F.when((w >= 0) & (h >= 0), F.struct(left.alias("x"), top.alias("y"), w.alias("w"), h.alias("h")))


def border_offsets(rect: Column, width: Column, height: Column) -> list[Column]:
    """Distances of a rectangle from the left, top, right and bottom."""
    return [rect["x"], rect["y"], width - rect["x"] - rect["w"], height - rect["y"] - rect["h"]]


def adapted(rect: Column, outer: Column) -> Column:
    """A rectangle in the coordinates of one that holds it; null if it begins before that one or is larger."""
    fits = (rect["x"] >= outer["x"]) & (rect["y"] >= outer["y"]) & (rect["w"] <= outer["w"]) & (rect["h"] <= outer["h"])
    return F.when(fits, F.struct((rect["x"] - outer["x"]).alias("x"), (rect["y"] - outer["y"]).alias("y"), rect["w"].alias("w"), rect["h"].alias("h")))


def byte_ranges(parts: DataFrame, key: str, order: str, offset: str, size: str) -> DataFrame:
    """key, start, size: a file's parts as one range if each begins where the one before ends, else one range for each part."""
    w = Window.partitionBy(key).orderBy(order)
    p = parts.withColumn("joins", F.coalesce(F.lag(F.col(offset) + F.col(size)).over(w) == F.col(offset), F.lit(True)))
    p = p.groupBy(key).agg(F.bool_and("joins").alias("one"), F.min(offset).alias("start"), F.sum(size).alias("size"), F.collect_list(F.struct(F.col(offset).alias("start"), F.col(size).alias("size"))).alias("parts"))
    whole = F.array(F.struct("start", "size"))
    return p.select(key, F.explode(F.when(F.col("one"), whole).otherwise(F.col("parts"))).alias("x")).select(key, "x.*")


def composite_id(*codes: Column) -> Column:
    """Bytes as two hexadecimal digits each, with spaces between."""
    return F.format_string(" ".join(["%02X"] * len(codes)), *codes)


def pick_level(*candidates: Column) -> Column:
    """The first candidate that is known: camera, file, masked areas; else 0."""
    return F.coalesce(*candidates, F.lit(0))
