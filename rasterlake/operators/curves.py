"""Lookup curves: built from knots, splines or polynomials, applied plainly or with dither, whole or by quadrant."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grid import image
from .layouts import quadrants

#: Fixed values of the dither sequence: multiplier and word.
MULTIPLIER, WORD = 15700, 1 << 16
MODULUS = MULTIPLIER * WORD - 1


def cut(x: Column, low: int = 0, high: int = 65535) -> Column:
    """Towards zero to an integer, held between low and high; null stays null."""
    whole = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    return F.when(x.isNotNull(), F.least(F.greatest(whole, F.lit(low)), F.lit(high))).cast("long")


def from_knots(knots: DataFrame, step: int) -> DataFrame:
    """x, y for every x up to the last knot (i, y): knots lie step apart, with linear steps in whole numbers between them.

    knots has at most 65,536 rows; without knots the curve is empty.
    """
    following = F.lead("y").over(Window.partitionBy(F.lit(0)).orderBy("i"))
    k = knots.select("i", "y", following.alias("after")).filter("after is not null")
    k = k.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(step - 1))))
    return k.select((F.col("i") * step + F.col("b")).cast("long").alias("x"), F.expr(f"(({step} - b) * y + b * after) div {step}").alias("y"))


def dither_table(curve: DataFrame) -> DataFrame:
    """x, base and delta of a curve (x, y) of at most 65,536 rows, from each value's neighbours; an end is its own neighbour."""
    w = Window.partitionBy(F.lit(0)).orderBy("x")
    delta = F.lead("y", 1).over(w), F.lag("y", 1).over(w)
    d = curve.select("x", "y", (F.coalesce(delta[0], "y") - F.coalesce(delta[1], "y")).alias("delta"))
    return d.select("x", F.when(F.col("y") == 0, 0).otherwise(F.expr("y - (delta + 2) div 4")).cast("long").alias("base"), F.col("delta").cast("long").alias("delta"))


def dither_state(seed: Column, place: Column, powers: Column) -> Column:
    """State of the dither sequence at a place of the line that a 32-bit seed starts.

    x -> 15700 * (x mod 65536) + x div 65536 multiplies by 15700 modulo 15700 * 65536 - 1, so any state follows from the seed
    and that power, without running through those before it. From the second step on, states lie between 1 and the modulus.
    """
    once = F.lit(MULTIPLIER) * F.pmod(seed, F.lit(WORD)) + F.shiftright(seed, 16)
    later = F.pmod(F.pmod(seed, F.lit(MODULUS)) * powers, F.lit(MODULUS))
    later = F.when(seed == 0, 0).when(later == 0, MODULUS).otherwise(later)
    return F.when(place == 0, seed).when(place == 1, once).otherwise(later)


def dithered(px: DataFrame, curve: DataFrame, width: int) -> DataFrame:
    """base + (delta * (state mod 2048) + 1024) >> 12 of every sample; a line's seed is its first two samples, low one first.

    Samples outside the curve are left out, and so are lines whose first two samples are missing. Table and powers have at
    most 65,536 and width rows.
    """
    spark = px.sparkSession
    seeds = px.filter("c < 2").groupBy(*image(px), "r").agg(F.sum(F.col("v") * F.when(F.col("c") == 0, 1).otherwise(WORD)).alias("seed"), F.count("*").alias("k")).filter("k = 2").drop("k")
    powers = spark.createDataFrame([(c, pow(MULTIPLIER, c, MODULUS)) for c in range(width)], "c long, powers long")
    p = px.join(F.broadcast(powers), "c").join(seeds, [*image(px), "r"]).join(F.broadcast(dither_table(curve)), F.col("v") == F.col("x"))
    rand = dither_state(F.col("seed"), F.col("c"), F.col("powers"))
    return p.select(*image(px), "r", "c", (F.col("base") + F.shiftright(F.col("delta") * F.pmod(rand, F.lit(2048)) + 1024, 12)).cast("long").alias("v"))


def spline(points: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(x, a, b, c, d) of each segment of the natural cubic spline; points have rising x. Solved on the driver: a handful."""
    x, y = np.array(points, float).T
    h, n = np.diff(x), len(x)
    m, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 3 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(m, right)
    b = np.diff(y) / h - h * (2 * c[:-1] + c[1:]) / 3
    return [tuple(map(float, s)) for s in zip(x[:-1], y[:-1], b, c[:-1], np.diff(c) / (3 * h), strict=True)]


def splined(v: Column, segments: list[tuple[float, ...]]) -> Column:
    """The spline at v, as a whole number from 0 to 65535; below the first point the first segment goes on."""
    out = None
    for x, a, b, c, d in segments:
        t = v - F.lit(x)
        y = F.lit(a) + t * (F.lit(b) + t * (F.lit(c) + t * F.lit(d)))
        out = y if out is None else F.when(v >= x, y).otherwise(out)
    return cut(out)


def quadrant_curves(px: DataFrame, points: list[list[list[tuple[float, float]]]], split_row: int, split_col: int) -> DataFrame:
    """Every sample through the spline of its quadrant: points[qr][qc]."""
    p = quadrants(px, split_row, split_col)
    lines = [[splined(F.col("v"), spline(points[i][j])) for j in (0, 1)] for i in (0, 1)]
    row = [F.when(F.col("qc") == 0, a).otherwise(b) for a, b in lines]
    return p.select(*image(px), "r", "c", F.when(F.col("qr") == 0, row[0]).otherwise(row[1]).alias("v"))


def shared_targets(x: list[list[list[int]]]) -> list[list[list[tuple[int, int]]]]:
    """Points of four quadrants that bring each quadrant's values to the rounded mean of all four.

    A last point continues the last ratio up to full scale.
    """
    y = [(sum(x[i][j][k] for i in (0, 1) for j in (0, 1)) + 2) >> 2 for k in range(len(x[0][0]))]

    def ends(own: list[int]) -> list[tuple[int, int]]:
        last = min(y[-1] * 65535 // own[-1], 65535)
        return sorted(set([(0, 0), *zip(own, y, strict=True), (last, last), (65535, 65535)]))

    return [[ends(x[i][j]) for j in (0, 1)] for i in (0, 1)]


def right_half(px: DataFrame, split_col: int, square: float, slope: float, offset: float, factor: float, temperature: float, reference: float) -> DataFrame:
    """A parabola over samples from split_col on; its slope grows by 1 and by the sensor's distance from the reference temperature."""
    lin = slope + (temperature - reference) * factor + 1.0
    x = F.col("v")
    return px.select(*image(px), "r", "c", F.when(F.col("c") >= split_col, cut((x * square + lin) * x + offset)).otherwise(x).cast("long").alias("v"))


def flat_field(px: DataFrame, gains: DataFrame, top: int, left: int, cell_h: int, cell_w: int, colours: Column | None = None) -> DataFrame:
    """Samples times a gain that is bilinear between nodes (gy, gx, gain), cut to 16 bits; samples outside whole cells stay.

    colours: an expression of r and c; gains then have a column of that name (colour), and samples without one stay.
    """
    key = ["colour"] if colours is not None else []
    across, down = Window.partitionBy(*key, "gy").orderBy("gx"), Window.partitionBy(*key, "gx").orderBy("gy")
    g = gains.withColumn("east", F.lead("gain").over(across)).withColumn("south", F.lead("gain").over(down)).withColumn("corner", F.lead("east").over(down))
    g = g.filter("corner is not null").select(*key, "gy", "gx", "gain", "east", "south", "corner")
    at = lambda c, first, size: (F.floor((F.col(c) - first) / size).cast("long"), F.pmod(F.col(c) - first, F.lit(size)) / size)
    (gy, fy), (gx, fx) = at("r", top, cell_h), at("c", left, cell_w)
    p = px.withColumns({"gy": gy, "gx": gx, "fy": fy, "fx": fx})
    p = p.withColumn("colour", colours) if key else p
    up, low = F.col("gain") + (F.col("east") - F.col("gain")) * F.col("fx"), F.col("south") + (F.col("corner") - F.col("south")) * F.col("fx")
    mult = up + (low - up) * F.col("fy")
    return p.join(g, [*key, "gy", "gx"], "left").select(*image(px), "r", "c", F.coalesce(cut(F.round(F.col("v") * mult, 6)), F.col("v")).alias("v"))


def tables(spark: SparkSession, bits: int, gammas: tuple[float, ...]) -> DataFrame:
    """gamma, inverse, x, y: curves from 8 or 16 bits to 16, both ways."""
    top = (1 << bits) - 1
    g = F.explode(F.array(*(F.struct(F.lit(float(v)).alias("gamma"), F.lit(i).alias("inverse")) for v in gammas for i in (False, True)))).alias("g")
    t = spark.range(top + 1).select(F.col("id").alias("x"), g).select("g.*", "x")
    power = F.when(F.col("inverse"), F.col("gamma")).otherwise(1 / F.col("gamma"))
    return t.withColumn("y", F.floor(F.round(F.pow(F.col("x") / top, power) * 65535, 6)).cast("long"))
