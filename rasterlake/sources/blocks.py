"""Coded images cut into blocks that are rows of their own, so that one large image is decoded by many tasks.

A codec is a function from a block's bytes and its first line to an array of lines; any function will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake import attach

from . import containers

Codec = Callable[[bytes, int], np.ndarray]
_LAYOUT = "height int, width int, block_height int, block_width int, tiled boolean, channels int, depth int, compression int, predictor int, real boolean, little boolean"


def strips(files: DataFrame, line_bytes: int, lines: int = 1, start: int = 0) -> DataFrame:
    """path, line, part: so many lines of fixed length each, from a byte on; the last strip may hold fewer, and a last line that is cut is left out.

    The bytes are cut by the engine: no shuffle, and no Python.
    """
    whole = F.floor((F.length("content") - start) / line_bytes)
    at = F.explode(F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - 1, F.lit(lines).cast("long"))))
    cut = files.select("path", "content", whole.alias("whole"), at.alias("line"))
    place, size = F.col("line") * line_bytes + start + 1, F.least(F.lit(lines), F.col("whole") - F.col("line")) * line_bytes
    return cut.select("path", "line", F.substring(F.col("content"), place.cast("int"), size.cast("int")).alias("part"))


def chunks(files: DataFrame, size: int) -> DataFrame:
    """path, line, part: runs of so many bytes, the last one perhaps shorter; line is the run's number."""
    at = F.explode(F.when(F.length("content") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.length("content") - 1) / size))))
    return files.select("path", "content", at.alias("line")).select("path", "line", F.substring(F.col("content"), (F.col("line") * size + 1).cast("int"), F.lit(size)).alias("part"))


def dealt(blocks: DataFrame) -> DataFrame:
    """Blocks of one file among all tasks: the coded bytes are shuffled once."""
    return blocks.repartition("path", "line")


def decoded(blocks: DataFrame, codec: Codec) -> DataFrame:
    """path, r, c, v of every sample; an empty or null block has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, int(line) + i, x) for p, line, part in zip(batch["path"], batch["line"], batch["part"], strict=True) if part for i, x in enumerate(np.atleast_2d(codec(bytes(part), int(line))))]
            yield pd.DataFrame(rows, columns=["path", "r", "vs"])

    attach(blocks.sparkSession)
    lines = blocks.select("path", "line", "part").mapInPandas(run, "path string, r long, vs array<long>")
    return lines.select("path", "r", F.posexplode("vs").alias("c", "v")).select("path", "r", F.col("c").cast("long").alias("c"), "v")


def tiff_blocks(files: DataFrame, directory: str = "0") -> DataFrame:
    """path, line, left, part and the layout of each strip or tile of a directory; files without one have no blocks."""
    names = ["path", "line", "left", "part", *(x.split()[0] for x in _LAYOUT.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                shared, places = containers.tiff_layout(content or b"", directory)
                rows += [(path, top, left, content[at : at + size], *(shared[n] for n in names[4:])) for top, left, at, size in places]
            yield pd.DataFrame(rows, columns=names)

    attach(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, f"path string, line long, left long, part binary, {_LAYOUT}")


def tiff_samples(blocks: DataFrame) -> DataFrame:
    """path, r, c, channel, v of every sample of TIFF blocks, each decoded by itself."""
    names = [x.split()[0] for x in _LAYOUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch.to_dict("records"):
                block = containers.tiff_block(b["part"], int(b["line"]), left=int(b["left"]), **{n: b[n] for n in names})
                rows += [(b["path"], int(b["line"]) + i, int(b["left"]), block.shape[2], x.ravel().astype(float)) for i, x in enumerate(block)]
            yield pd.DataFrame(rows, columns=["path", "r", "left", "n", "vs"])

    attach(blocks.sparkSession)
    lines = blocks.mapInPandas(run, "path string, r long, left long, n int, vs array<double>")
    flat = lines.select("path", "r", "left", "n", F.posexplode("vs").alias("i", "v"))
    return flat.select("path", "r", (F.col("left") + F.floor(F.col("i") / F.col("n"))).cast("long").alias("c"), F.pmod("i", "n").cast("int").alias("channel"), "v")
