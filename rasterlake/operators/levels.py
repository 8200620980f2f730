"""Black and white levels, clipping and superpixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import image, in_rects, phase


def black_levels(px: DataFrame, h: int = 2, w: int = 2) -> DataFrame:
    """Mean sample of each phase of the colour pattern."""
    return px.groupBy(*image(px), phase(h, w).alias("phase")).agg(F.avg("v").alias("level"), F.count("*").alias("n"))


def masked_black(px: DataFrame, rects: list[tuple[int, int, int, int]], h: int = 2, w: int = 2) -> DataFrame:
    """Mean sample of each phase over all masked rectangles (x, y, w, h); a sample in two of them counts twice."""
    return black_levels(in_rects(px, rects), h, w)


def rescale_components(pix: Column, black: list[float], white: list[float]) -> Column:
    """max(v - black, 0) / (white - black) of every component of an array; unchanged if the numbers of levels differ."""
    if len(black) != len(white):
        return pix
    return F.transform(pix, lambda v, i: F.greatest(v - F.get(F.array(*map(F.lit, map(float, black))), i), F.lit(0.0)) / F.get(F.array(*(F.lit(float(b - a)) for a, b in zip(black, white, strict=True))), i))


def colours(px: DataFrame, pattern: str) -> DataFrame:
    """Number of different colours of a square pattern, as many letters as places, over the samples (0 where there are none)."""
    side = int(len(pattern) ** 0.5)
    letter = F.element_at(F.split(F.lit(pattern), ""), phase(side, side) + 1)
    return px.groupBy(*image(px)).agg(F.countDistinct(letter).alias("colours"))


def scaled(px: DataFrame, black: DataFrame, white: float) -> DataFrame:
    """The rescaled image with its new levels, 0 and 1."""
    return rescale(px, black, white).withColumns({"black": F.lit(0.0), "white": F.lit(1.0)})


def rescale(px: DataFrame, black: DataFrame, white: float, h: int = 2, w: int = 2) -> DataFrame:
    """max(v - black, 0) / (white - black) by phase; black has one row per phase (h * w of them), or per image and phase."""
    keys = [*image(black), "phase"]
    levels = black.select(*keys, "level")
    levels = levels if image(black) else F.broadcast(levels)  # a handful of rows; those of many images are not sent about
    scaled = F.greatest(F.col("v") - F.col("level"), F.lit(0.0)) / (F.lit(float(white)) - F.col("level"))
    return px.withColumn("phase", phase(h, w)).join(levels, keys).select(*image(px), "r", "c", scaled.alias("v"))


def superpixel(px: DataFrame, height: int, width: int) -> DataFrame:
    """2x2 RGGB blocks to one pixel; greens are averaged; an odd last line or column is left out."""
    p = phase()
    at = px.filter((F.col("r") < height // 2 * 2) & (F.col("c") < width // 2 * 2))
    pick = lambda *k: F.avg(F.when(p.isin(*k), F.col("v")))
    return at.groupBy(*image(px), F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg(pick(0).alias("red"), pick(1, 2).alias("green"), pick(3).alias("blue"))


def superpixel4(px: DataFrame, height: int, width: int) -> DataFrame:
    """2x2 blocks to one pixel of four channels."""
    p = phase()
    at = px.filter((F.col("r") < height // 2 * 2) & (F.col("c") < width // 2 * 2))
    return at.groupBy(*image(px), F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg(*(F.max(F.when(p == k, F.col("v"))).alias(f"ch{k}") for k in range(4)))


def clip(v: Column, low: float | None = 0.0, high: float | None = 1.0) -> Column:
    v = v if low is None else F.greatest(v, F.lit(low))
    return v if high is None else F.least(v, F.lit(high))


def colour_clip(pix: Column) -> Column:
    """Negative channels to 0; if any exceeds 1, the mean of scaling by the maximum and by the Euclidean norm over sqrt(n)."""
    low = F.transform(pix, lambda x: F.greatest(x, F.lit(0.0)))
    top = F.array_max(low)
    norm = F.sqrt(F.aggregate(low, F.lit(0.0), lambda a, x: a + x * x)) / F.sqrt(F.size(low).cast("double"))
    return F.when(top > 1, F.transform(low, lambda x: (x / top + F.least(x / norm, F.lit(1.0))) / 2)).otherwise(low)
