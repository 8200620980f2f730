"""The develop pipeline: levels, colour reconstruction, calibration, crop and tone, as one declarative plan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import colour
from rasterlake.operators import demosaic, grid, levels

STEPS = frozenset({"rescale", "demosaic", "calibrate", "crop", "srgb"})


def develop(px: DataFrame, white: float, height: int, width: int, camera: np.ndarray, wb: tuple[float, float, float] = (1, 1, 1), crop: tuple[int, int, int, int] | None = None, steps: frozenset[str] = STEPS, black: list[float] | None = None, masked: list[tuple[int, int, int, int]] | None = None, pattern: str | list[list[int]] = "RGGB") -> DataFrame:
    """r, c, red, green, blue, of each image_id if there are some. steps is a set: its order does not matter.

    black: known levels of the four phases; else they are means over the masked rectangles (x, y, w, h), where there are some; else 0.
    pattern: the four letters of a 2x2 mosaic, reconstructed by gradients, or the colours of a wider one, by means.
    """
    keys = [*grid.image(px), "r", "c"]
    if "rescale" in steps:
        if black is None and masked:
            found = levels.masked_black(px, masked)
        else:
            found = px.sparkSession.createDataFrame(list(enumerate(map(float, black or [0.0] * 4))), "phase int, level double")
        px = levels.rescale(px, found, white)
    if "demosaic" in steps:
        rgb = demosaic.ppg(px, height, width, pattern) if isinstance(pattern, str) else demosaic.window_means(px, pattern)
    else:
        rgb = px.select(*keys, *(F.col("v").alias(n) for n in ("red", "green", "blue")))
    if "calibrate" in steps:
        balanced = [F.col(n) * float(k) for n, k in zip(("red", "green", "blue"), wb, strict=True)]
        pix = levels.colour_clip(F.array(*colour.matrix(colour.camera_to_rgb(camera), balanced)))
        rgb = rgb.withColumn("pix", pix).select(*keys, *(F.col("pix")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))))
    if "crop" in steps and crop:
        rgb = grid.crop(rgb, *crop)
    if "srgb" in steps:
        rgb = rgb.select(*keys, *(colour.srgb(F.col(n)).alias(n) for n in ("red", "green", "blue")))
    return rgb
