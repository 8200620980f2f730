"""Queries over many images: every 64 lines of the embeddings are one, the last perhaps with fewer lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.operators import demosaic, grid, levels, lossless
from rasterlake.sinks import images as sink
from rasterlake.sources import blocks

from . import develop
from .layouts import hue_sql, other_sql
from .queries import _INVERSE, CAMERA, CROSS, PRED, RING, query, read, rounded, sql_mean

SIDE = 64
PX = f"px AS (SELECT vec_id // {SIDE} AS image_id, vec_id % {SIDE} AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
IX = PX + ", ix AS (SELECT image_id, r, c, CAST(floor((v + 1) * 1000) AS BIGINT) AS v FROM px)"
COLOURS = ("red", "green", "blue")


def images(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings")
    return grid.pixels(e.select(F.expr(f"vec_id div {SIDE}").alias("image_id"), F.expr(f"vec_id % {SIDE}").alias("r"), "embedding"), "r")


def near(table: str, places: str, name: str = "nb", columns: tuple[str, ...] = ("v",)) -> str:
    """SQL of the neighbours of every sample in its own image; columns other than v are named column_place."""
    cols, joins = "", ""
    for n, at in (x.split("=") for x in places.split()):
        dr, dc = at.split(":")
        cols += "".join(f", {n}.{c} AS {n if columns == ('v',) else f'{c}_{n}'}" for c in columns)
        joins += f" LEFT JOIN {table} {n} ON {n}.image_id = p.image_id AND {n}.r = p.r + ({dr}) AND {n}.c = p.c + ({dc})"
    return f"{name} AS (SELECT p.*{cols} FROM {table} p{joins})"


def _by_place(own: str, beside: str, above: str, corner: str, when: tuple[str, str]) -> str:
    """SQL of a colour whose samples lie where both conditions (line, column) hold."""
    line, column = when
    return f"CASE WHEN {line} AND {column} THEN {own} WHEN {line} THEN {beside} WHEN {column} THEN {above} ELSE {corner} END"


_MEANS = sql_mean("w1", "e1"), sql_mean("n1", "s1"), sql_mean("nw", "ne", "sw", "se")
#: Parities (line, column) of the red samples, as the patterns' letters say.
_RED = {"RGGB": (0, 0), "GRBG": (0, 1), "GBRG": (1, 0), "BGGR": (1, 1)}


def bilinear_sql(pattern: str) -> list[str]:
    r, c = _RED[pattern]
    red, blue = (_by_place("v", *_MEANS, (f"r % 2 = {a}", f"c % 2 = {b}")) for a, b in ((r, c), (1 - r, 1 - c)))
    return [red, f"CASE WHEN (r + c) % 2 <> {(r + c) % 2} THEN v ELSE {sql_mean('n1', 's1', 'w1', 'e1')} END", blue]


for _pattern in _RED:
    query(f"WITH {PX}, {near('px', RING)} SELECT image_id, r, c, " + ", ".join(f"round({x}, 9) AS {n}" for x, n in zip(bilinear_sql(_pattern), COLOURS, strict=True)) + " FROM nb", f"images_bilinear_{_pattern.lower()}")(
        lambda spark, d, p=_pattern: rounded(demosaic.bilinear(images(spark, d), p), 9, *COLOURS)
    )


@query(f"WITH {PX}, {near('px', RING)} SELECT image_id, r, c, " + ", ".join("round(" + _by_place("v", *_MEANS, (f"r % 2 = {k // 2}", f"c % 2 = {k % 2}")) + f", 9) AS ch{k}" for k in range(4)) + " FROM nb")
def bilinear4(spark, d):
    return rounded(demosaic.bilinear4(images(spark, d)), 9, "ch0", "ch1", "ch2", "ch3")


@query(f"WITH {PX} SELECT image_id, CAST((r % 2) * 2 + c % 2 AS INTEGER) AS phase, round(avg(v), 9) AS level, count(*) AS n FROM px WHERE c < 8 GROUP BY 1, 2")
def images_masked_black(spark, d):
    """The first eight samples of each line are masked."""
    return rounded(levels.masked_black(images(spark, d), [(0, 0, 8, SIDE)]), 9, "level")


@query(f"WITH {IX}, {near('ix', 'a=0:-1 b=-1:0 d=-1:-1')}, x AS (SELECT image_id, c, (v - (CASE WHEN r = 0 AND c = 0 THEN 32768 WHEN r = 0 THEN a WHEN c = 0 THEN b ELSE {PRED[6]} END) + 32768) & 65535 AS w FROM nb) SELECT image_id, CAST(c % 2 AS INTEGER) AS component, CAST(CASE WHEN w = 32768 THEN 0 ELSE length(bin(abs(w - 32768))) END AS INTEGER) AS ssss, count(*) AS n FROM x GROUP BY 1, 2, 3")
def images_size_classes(spark, d):
    """Two components in turn."""
    return lossless.histogram_by_component(lossless.residuals(grid.integers(images(spark, d)), 6), 2)


@query(
    f"WITH {IX}, {near('ix', 'w1=0:-1 e1=0:1')}, k AS (SELECT image_id, r, c, CASE WHEN c % 2 = 0 THEN v WHEN e1 IS NULL THEN w1 ELSE (w1 + e1 + 1) // 2 END AS v FROM nb), {near('k', 'n1=-1:0 s1=1:0', 'nk')} "
    "SELECT image_id, r, c, CAST(CASE WHEN r % 3 = 1 AND n1 IS NOT NULL AND s1 IS NOT NULL THEN (n1 + s1 + 1) // 2 ELSE v END AS BIGINT) AS v FROM nk"
)
def chroma_both_ways(spark, d):
    return demosaic.chroma_lines(demosaic.chroma(grid.integers(images(spark, d))))


@query(f"WITH {PX} SELECT image_id, CAST(4 AS BIGINT) AS colours FROM px WHERE r % 2 = 1 AND c % 2 = 1 GROUP BY 1 UNION ALL SELECT image_id, CAST(2 AS BIGINT) FROM px GROUP BY 1 HAVING max(r) = 0")
def pattern_colour_counts(spark, d):
    """A 2x2 pattern of four colours; an image of one line shows two of them."""
    return levels.colours(images(spark, d), "CMYG")


_DIAGONALS = " ".join(f"{n}={dr}:{dc}" for n, (dr, dc) in demosaic.DIAGONALS.items())
_INNER = f"r BETWEEN 3 AND {SIDE - 4} AND c BETWEEN 3 AND 60"


def ppg_sql(table: str, pattern: str) -> str:
    """Tables border, green and rgb (image_id, r, c, red, green, blue) of the gradient reconstruction."""
    r, c = _RED[pattern]
    on_green, red_line = f"(r + c) % 2 <> {(r + c) % 2}", f"r % 2 = {r}"
    red, _, blue = bilinear_sql(pattern)
    around = f"CASE WHEN {on_green} THEN v ELSE {sql_mean('n1', 's1', 'w1', 'e1')} END"
    slopes = ", ".join(f"abs(v - {k}2) * 2 + abs({k}1 - {back}1) AS g{k}" for k, back in ("ns", "ew", "we", "sn"))
    least = "least(gn, ge, gw, gs)"
    pick = " ".join(f"WHEN g{k} = {least} THEN ({k}1 * 3 + {back}1 + v - {k}2) / 4" for k, back in ("ns", "ew", "we"))
    across = (hue_sql("w1", "e1"), hue_sql("n1", "s1"))
    at_green = [f"CASE WHEN {red_line} THEN {a} ELSE {b} END" for a, b in (across, across[::-1])]
    return (
        f"{near(table, RING, 'ring')}, border AS (SELECT image_id, r, c, {red} AS red, {around} AS green, {blue} AS blue FROM ring WHERE NOT ({_INNER})), "
        f"{near(table, CROSS, 'crossed')}, sloped AS (SELECT *, {slopes} FROM crossed WHERE {_INNER}), "
        f"green AS (SELECT image_id, r, c, CASE WHEN {on_green} THEN v {pick} ELSE (s1 * 3 + n1 + v - s2) / 4 END AS green FROM sloped UNION ALL SELECT image_id, r, c, green FROM border), "
        f"guided AS (SELECT p.image_id, p.r, p.c, p.v, green.green AS g FROM {table} p JOIN green USING (image_id, r, c)), {near('guided', _DIAGONALS, 'seen', ('v', 'g'))}, "
        f"rgb AS (SELECT image_id, r, c, CASE WHEN {on_green} THEN {at_green[0]} WHEN {red_line} THEN v ELSE {other_sql()} END AS red, g AS green, "
        f"CASE WHEN {on_green} THEN {at_green[1]} WHEN {red_line} THEN {other_sql()} ELSE v END AS blue FROM seen WHERE {_INNER} UNION ALL SELECT image_id, r, c, red, green, blue FROM border)"
    )


@query(f"WITH {PX}, {ppg_sql('px', 'GRBG')} SELECT image_id, r, c, " + ", ".join(f"round({n}, 8) AS {n}" for n in COLOURS) + " FROM rgb")
def ppg_full(spark, d):
    return rounded(demosaic.ppg(images(spark, d), SIDE, 64, "GRBG"), 8, *COLOURS)


_SCALED = "b AS (SELECT image_id, (r % 2) * 2 + c % 2 AS p, avg(v) AS l FROM ix WHERE c < 8 GROUP BY 1, 2), px2 AS (SELECT ix.image_id, r, c, greatest(v - l, 0.0) / (2000.0::DOUBLE - l) AS v FROM ix JOIN b ON b.image_id = ix.image_id AND b.p = (r % 2) * 2 + c % 2)"
_WB = (1.8, 1.0, 1.4)
_MAPPED = ", ".join("greatest((" + " + ".join(f"k[{3 * i + j + 1}] * {n} * {_WB[j]}::DOUBLE" for j, n in enumerate(COLOURS)) + f") / det, 0.0) AS {x}" for i, x in enumerate("xyz"))
_TONED = ", ".join(f"round(CASE WHEN {x} <= 0.00304::DOUBLE THEN {x} * 12.92::DOUBLE ELSE pow({x}, 1 / 2.4::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END, 6) AS {n}" for x, n in zip("xyz", COLOURS, strict=True))
_CLIPPED = ", ".join(f"CASE WHEN top > 1 THEN ({x} / top + least({x} / norm, 1.0)) / 2 ELSE {x} END AS {x}" for x in "xyz")


@query(
    f"WITH {IX}, {_SCALED}, {ppg_sql('px2', 'BGGR')}, {_INVERSE}, mapped AS (SELECT image_id, r, c, {_MAPPED} FROM rgb, inv), tops AS (SELECT *, greatest(x, y, z) AS top, sqrt(x * x + y * y + z * z) / sqrt(3.0::DOUBLE) AS norm FROM mapped), "
    f"clipped AS (SELECT image_id, r, c, {_CLIPPED} FROM tops) SELECT image_id, r - 6 AS r, c - 8 AS c, {_TONED} FROM clipped WHERE r BETWEEN 6 AND 55 AND c BETWEEN 8 AND 55"
)
def images_developed(spark, d):
    """All steps for every image: black from its own masked samples, gradients, calibration with a balance, crop and tone."""
    px = grid.integers(images(spark, d)).withColumn("v", F.col("v").cast("double"))
    out = develop.develop(px, 2000.0, SIDE, 64, CAMERA, _WB, crop=(8, 6, 48, 50), masked=[(0, 0, 8, SIDE)], pattern="BGGR")
    return rounded(out, 6, *COLOURS)


@query(
    f"WITH {PX}, {near('px', RING)}, rgb AS (SELECT image_id, r, c, unnest([0, 1, 2]) AS channel, unnest([" + ", ".join(bilinear_sql("GRBG")) + "]) AS v FROM nb) "
    "SELECT image_id, r, c, CAST(channel AS INTEGER) AS channel, CAST(floor(least(greatest(v * 65535, 0.0), 65535.0)) AS BIGINT) AS v FROM rgb"
)
def developed_files(spark, d):
    """Samples of the 16-bit TIFF files that reconstructed images become."""
    files = sink.developed(demosaic.bilinear(images(spark, d), "GRBG"))
    read_again = blocks.tiff_samples(blocks.dealt(blocks.tiff_blocks(files.select(F.col("image_id").cast("string").alias("path"), "content"))))
    return read_again.select(F.col("path").cast("long").alias("image_id"), "r", "c", "channel", F.col("v").cast("long").alias("v"))


@query(f"WITH {IX} SELECT image_id, md5(unhex(string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY r, c))) AS md5 FROM ix GROUP BY 1")
def sample_digests(spark, d):
    return sink.digests(grid.integers(images(spark, d)))
