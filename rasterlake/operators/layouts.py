"""Stored order to image order, as arithmetic on places: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import image as of


def from_slices(stored: DataFrame, height: int, n: int, first: int, last: int) -> DataFrame:
    """Samples (i, v) stored as n vertical slices of one width, then one of another, each line by line."""
    i, whole = F.col("i"), n * first * height
    size = F.when(i < whole, first).otherwise(last)
    j = F.when(i < whole, F.pmod(i, F.lit(first * height))).otherwise(i - whole)
    left = F.when(i < whole, F.floor(i / (first * height)) * first).otherwise(n * first)
    return stored.select(*of(stored), F.floor(j / size).cast("long").alias("r"), (left + F.pmod(j, size)).cast("long").alias("c"), "v")


def interlaced(px: DataFrame, height: int) -> DataFrame:
    """Even stored lines run from the top, odd ones from the bottom."""
    half = F.floor(F.col("r") / 2)
    return px.withColumn("r", F.when(F.pmod(F.col("r"), F.lit(2)) == 0, half).otherwise(height - 1 - half).cast("long"))


def turned_lines(px: DataFrame, width: int, steps: list[int], starts: list[int]) -> DataFrame:
    """Lines turned about by (start + row * step) samples; step and start depend on the row modulo their number."""
    at = F.pmod(F.col("r"), F.lit(len(steps))).cast("int")
    pick = lambda xs: F.array(*map(F.lit, xs))[at]
    return px.withColumn("c", F.pmod(F.col("c") + pick(starts) + F.col("r") * pick(steps), F.lit(width)).cast("long"))


def quads(blocks: DataFrame) -> DataFrame:
    """Places (r, c) that hold four samples, to 2 x 2 samples."""
    return blocks.select(*of(blocks), "r", "c", F.posexplode("v").alias("k", "s")).select(*of(blocks), (F.col("r") * 2 + F.expr("k div 2")).cast("long").alias("r"), (F.col("c") * 2 + F.expr("k % 2")).cast("long").alias("c"), F.col("s").alias("v"))


def on_45_degrees(px: DataFrame, width: int, other: bool = False) -> DataFrame:
    """Samples of a sensor turned by 45 degrees, spread over a square whose diagonals they fill. other: columns are staggered, not lines."""
    r, c = F.col("r"), F.col("c")
    half = lambda x: F.floor(x / 2)
    new = (width // 2 - 1 + r - half(c), half(c + 1) + r) if other else (width - 1 - c + half(r), half(r + 1) + c)
    return px.select(*of(px), new[0].cast("long").alias("r"), new[1].cast("long").alias("c"), "v")


def upright(px: DataFrame, height: int, width: int, turned: int, image: str | None = None) -> DataFrame:
    """The upright rectangle inside a square that is turned by 45 degrees, sampled bilinearly; turned: width of the sensor's side.

    Places whose four neighbours are not all inside take the nearest sample, or 0 outside. Each target names its sources, and one
    join on place brings them; the target grid is generated, not collected. image: the column that tells images apart.
    """
    spark, root = px.sparkSession, 2**0.5
    keys = [image] if image else []
    sides = sorted((int(turned * root), int((width - turned) * root)))
    h, w = sides
    at = px.select(image).distinct().withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h * w - 1).cast("long")))) if image else spark.range(h * w)
    at = at.select(*keys, F.expr(f"id div {w}").alias("tr"), F.expr(f"id % {w}").alias("tc"))
    dx, dy = F.col("tc") - w / 2, F.col("tr") - h / 2
    at = at.withColumns({"x": (dx + dy) * 0.5**0.5 + width / 2, "y": (dy - dx) * 0.5**0.5 + height / 2})
    at = at.withColumns({"x0": F.floor("x"), "y0": F.floor("y"), "sx": F.round("x").cast("long"), "sy": F.round("y").cast("long")})
    fx, fy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    part = lambda r, c, k: F.struct(r.alias("r"), c.alias("c"), k.alias("k"))
    x0, y0 = F.col("x0"), F.col("y0")
    four = F.array(part(y0, x0, (1 - fx) * (1 - fy)), part(y0, x0 + 1, fx * (1 - fy)), part(y0 + 1, x0, (1 - fx) * fy), part(y0 + 1, x0 + 1, fx * fy))
    inside = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < width) & (y0 + 1 < height)
    parts = at.select(*keys, "tr", "tc", F.explode(F.when(inside, four).otherwise(F.array(part(F.col("sy"), F.col("sx"), F.lit(1.0))))).alias("p")).select(*keys, "tr", "tc", "p.*")
    got = parts.join(px, [*keys, "r", "c"], "left").groupBy(*keys, "tr", "tc").agg(F.coalesce(F.sum(F.col("k") * F.col("v")), F.lit(0.0)).alias("v"))
    return got.select(*keys, F.col("tr").alias("r"), F.col("tc").alias("c"), "v")


def quadrants(px: DataFrame, split_row: int, split_col: int) -> DataFrame:
    """Adds qr and qc, 1 from the splits on."""
    return px.withColumns({"qr": (F.col("r") >= split_row).cast("int"), "qc": (F.col("c") >= split_col).cast("int")})


def quadrant_black(px: DataFrame, black: int, by_line: DataFrame, by_column: DataFrame, split_row: int, split_col: int) -> DataFrame:
    """Samples less the black level, plus by_line (r, qc, up) and by_column (c, qr, across), from 0 to 65535; unlisted corrections are 0."""
    p = quadrants(px, split_row, split_col).join(by_line, ["r", "qc"], "left").join(by_column, ["c", "qr"], "left")
    x = F.col("v") - black + F.coalesce("up", F.lit(0)) + F.coalesce("across", F.lit(0))
    return p.select(*of(px), "r", "c", F.least(F.greatest(x, F.lit(0)), F.lit(65535)).cast("long").alias("v"))


def quadrant_gain(px: DataFrame, gains: list[list[float]], split_row: int, split_col: int) -> DataFrame:
    """Samples times the gain of their quadrant, cut to integers from 0 to 65535."""
    qr, qc = F.col("r") >= split_row, F.col("c") >= split_col
    gain = F.when(qr & qc, gains[1][1]).when(qr, gains[1][0]).when(qc, gains[0][1]).otherwise(gains[0][0])
    return px.select(*of(px), "r", "c", F.least(F.greatest(F.floor(F.col("v") * gain), F.lit(0)), F.lit(65535)).cast("long").alias("v"))


def byte_sums(rows: DataFrame, keys: list[str], order: str, step: int = 1) -> DataFrame:
    """Running sums modulo 256 of byte differences (v), step apart within a line."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, F.pmod(F.col(order), F.lit(step))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("v", F.pmod(F.sum("v").over(w), F.lit(256)).cast("long"))


def without_outlier(*values: Column) -> Column:
    """Mean of the values but the one that is farthest from the mean of all; the first such if several are."""
    xs = F.array(*values)
    mean = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / len(values)
    far = F.array_max(F.transform(xs, lambda x: F.abs(x - mean)))
    at = F.array_position(F.transform(xs, lambda x: F.abs(x - mean)), far)
    return (F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) - F.element_at(xs, at.cast("int"))) / (len(values) - 1)


def white_balance(*raw: Column) -> list[Column]:
    """Four coefficients divided by the first green, greens averaged; the fourth is null. Null if the green is 0 or null."""
    r, g1, g2, b = (x.cast("double") for x in raw)
    green = F.when(g1 != 0, g1)
    return [r / green, (g1 + g2) / 2 / green, b / green, F.lit(None).cast("double")]


def taken_at(text: Column, hours: Column, offset: Column) -> Column:
    """UTC time of 'yyyy:MM:dd HH:mm:ss' by whole hours from UTC, else by an offset such as +02:00, else as UTC; null if malformed."""
    local = F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))
    parts = F.regexp_extract(offset, r"^([+-])(\d\d):(\d\d)$", 1), F.regexp_extract(offset, r"^[+-](\d\d):(\d\d)$", 1), F.regexp_extract(offset, r"^[+-](\d\d):(\d\d)$", 2)
    minutes = F.when(parts[0] != "", (parts[1].cast("int") * 60 + parts[2].cast("int")) * F.when(parts[0] == "-", -1).otherwise(1))
    return (local.cast("double") - F.coalesce(hours * 60, minutes, F.lit(0)) * 60).cast("timestamp")
