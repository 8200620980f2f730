"""Rectangular sample grids: narrow rows (r, c, v) over images kept as one array per line.

Several images share a table if it has a column image_id: every operator then keeps it, and images never see each other. Heights,
widths and patterns that an operator takes are those of all its images, as camera modes have them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rasterlake import attach

#: Side of the tiles that stencils are worked in, in samples.
TILE = 128


def image(px: DataFrame) -> list[str]:
    """The column that tells images apart, if there is one."""
    return [c for c in px.columns if c == "image_id"]


def pixels(lines: DataFrame, line: str = "vec_id", samples: str = "embedding") -> DataFrame:
    """One row (r, c, v) per sample; null lines and null samples are left out."""
    at = lines.select(*image(lines), F.col(line).cast("long").alias("r"), F.posexplode(samples).alias("c", "s"))
    return at.select(*image(lines), "r", F.col("c").cast("long").alias("c"), F.col("s").cast("double").alias("v")).filter("v is not null")


def integers(px: DataFrame, scale: int = 1000) -> DataFrame:
    """Samples shifted to positive integers, as sensor counts are."""
    return px.withColumn("v", F.floor((F.col("v") + 1) * scale).cast("long"))


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Samples inside the rectangle, re-based to its corner."""
    inside = F.col("r").between(y, y + h - 1) & F.col("c").between(x, x + w - 1)
    return px.filter(inside).withColumns({"r": F.col("r") - y, "c": F.col("c") - x})


def tiles(px: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """Tile of each sample and its place there."""
    at = lambda c, n: (F.floor(F.col(c) / n).cast("long"), F.pmod(F.col(c), F.lit(n)).cast("long"))
    (tr, ir), (tc, ic) = at("r", tile_h), at("c", tile_w)
    return px.select(*image(px), tr.alias("tile_r"), tc.alias("tile_c"), ir.alias("r"), ic.alias("c"), "v")


def pad_tiles(px: DataFrame, height: int, width: int, tile_h: int, tile_w: int) -> DataFrame:
    """Whole tiles: samples beyond the last line or column repeat the nearest sample."""
    rows = F.when(F.col("r") == height - 1, F.sequence(F.col("r"), F.lit(-(-height // tile_h) * tile_h - 1))).otherwise(F.array("r"))
    cols = F.when(F.col("c") == width - 1, F.sequence(F.col("c"), F.lit(-(-width // tile_w) * tile_w - 1).cast("long"))).otherwise(F.array("c"))
    grown = px.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))
    return tiles(grown, tile_h, tile_w)


def rotate(px: DataFrame, height: int, width: int, turns: str) -> DataFrame:
    """turns: 90cw, 90ccw, 180 or transpose."""
    r, c = F.col("r"), F.col("c")
    new = {"90cw": (c, height - 1 - r), "90ccw": (width - 1 - c, r), "180": (height - 1 - r, width - 1 - c), "transpose": (c, r)}[turns]
    return px.select(*image(px), new[0].alias("r"), new[1].alias("c"), "v")


def deinterleave(px: DataFrame, height: int, width: int) -> DataFrame:
    """2x2 interleaved planes to quadrants."""
    half = lambda c, n: F.floor(F.col(c) / 2) + F.pmod(F.col(c), F.lit(2)) * (n // 2)
    return px.select(*image(px), half("r", height).cast("long").alias("r"), half("c", width).cast("long").alias("c"), "v")


def flips(orientation: Column) -> tuple[Column, Column, Column]:
    """(transpose, horizontal, vertical) of an orientation code 1 to 8; others count as 1. Flips come before the transposition."""
    one = lambda *codes: orientation.isin(*codes)
    return one(5, 6, 7, 8), one(2, 3, 7, 8), one(3, 4, 6, 7)


def phase(h: int = 2, w: int = 2) -> Column:
    """Place in a repeating h x w pattern."""
    return (F.pmod(F.col("r"), F.lit(h)) * w + F.pmod(F.col("c"), F.lit(w))).cast("int")


def neighbours(px: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds, for each name, the sample at (row offset, column offset), or null where there is none.

    Samples are dealt to square tiles, those near a tile's edge to its neighbours too: one shuffle of little more than the image, and
    a task holds one tile. v may be of any type. Samples without a value or a place are left out; of repeated ones the largest counts.
    """
    up, across = (max((abs(at[i]) for at in places.values()), default=0) for i in (0, 1))
    if max(up, across) >= TILE:
        raise ValueError("a neighbour is farther away than a tile")
    keys = image(px)
    seen = lambda c, reach: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE)))
    dealt = px.select(*keys, "r", "c", "v").dropna(subset=["r", "c"]).filter("v is not null")
    dealt = dealt.withColumn("tile_r", seen("r", up)).withColumn("tile_c", seen("c", across))
    kinds = {f.name: f.dataType for f in px.schema}
    schema = StructType([StructField(k, kinds[k]) for k in keys] + [StructField(k, LongType()) for k in ("r", "c")] + [StructField(n, kinds["v"]) for n in ("v", *places)])

    def gather(key: tuple, tile: pa.Table) -> pa.Table:
        top, left = (int(k.as_py()) * TILE for k in key[-2:])
        r, c = tile["r"].to_numpy() - top + up, tile["c"].to_numpy() - left + across
        row = np.full((TILE + 2 * up, TILE + 2 * across), -1)
        if len(np.unique(r * row.shape[1] + c)) < len(r):
            order = _ascending(tile["v"].combine_chunks())
            row[r[order], c[order]] = order
        else:
            row[r, c] = np.arange(len(r))
        r, c = np.nonzero(row[up : up + TILE, across : across + TILE] >= 0)
        v = tile["v"].combine_chunks()
        found = {k: tile[k].combine_chunks().take(pa.array(row[r + up, c + across])) for k in keys}
        found |= {"r": pa.array(r + top), "c": pa.array(c + left)}
        for name, (dr, dc) in {"v": (0, 0), **places}.items():
            at = row[r + up + dr, c + across + dc]
            found[name] = v.take(pa.array(at, mask=at < 0))
        return pa.table(found)

    attach(px.sparkSession)
    return dealt.groupBy(*keys, "tile_r", "tile_c").applyInArrow(gather, schema)


def _ascending(v: pa.Array) -> np.ndarray:
    """Places of the values in ascending order, those of structs field by field, nulls first."""
    fields = v.flatten() if pa.types.is_struct(v.type) else [v]
    table = pa.table({str(i): f for i, f in enumerate(fields)})
    return pc.sort_indices(table, [(n, "ascending") for n in table.column_names], null_placement="at_start").to_numpy()


def in_rects(px: DataFrame, rects: list[tuple[int, int, int, int]]) -> DataFrame:
    """Samples of each rectangle (x, y, w, h), with its number: a handful of rectangles become one expression."""
    hit = F.array_compact(F.array(*(F.when(F.col("c").between(x, x + w - 1) & F.col("r").between(y, y + h - 1), F.lit(i)) for i, (x, y, w, h) in enumerate(rects))))
    return px.withColumn("rect", F.explode(hit))


def nearest(px: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """A smaller image whose samples are those under the centres of its pixels.

    A source sample is under one centre at most, so that each knows its own place: no join, no shuffle.
    """

    def place(c: str, size: int, to: int) -> tuple[Column, Column]:
        t = F.ceil((F.col(c) * to * 2 - size) / (2 * size)).cast("long")
        return t, (F.floor((t * 2 + 1) * size / (2 * to)) == F.col(c)) & (t >= 0) & (t < to)

    if to_height > height or to_width > width:
        raise ValueError("the image would grow")
    (r, r_hit), (c, c_hit) = place("r", height, to_height), place("c", width, to_width)
    return px.filter(r_hit & c_hit).select(*image(px), r.alias("r"), c.alias("c"), "v")


def fitted(height: int, width: int, box_height: int, box_width: int) -> tuple[int, int]:
    """Height and width within a box, in proportion, each at least 1; a smaller image stays."""
    scale = min(1.0, box_height / height, box_width / width)
    return max(1, round(height * scale)), max(1, round(width * scale))
