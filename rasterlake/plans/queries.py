"""Registered queries of the image operators over the driver's tables, each with its DuckDB counterpart.

Embeddings serve as the sample grid: one line per vec_id, 64 samples wide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake import attach
from rasterlake.functions import colour, numeric
from rasterlake.operators import demosaic, grid, levels, lookup, lossless

from . import develop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PX = "px AS (SELECT vec_id AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
IX = PX + ", ix AS (SELECT r, c, CAST(floor((v + 1) * 1000) AS BIGINT) AS v FROM px)"
CAMERA = np.array([[0.9, -0.3, -0.1], [-0.4, 1.2, 0.2], [-0.1, 0.2, 0.7]])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.pixels(read(spark, sf_dir, "embeddings"))


def ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.integers(px(spark, sf_dir))


def near(table: str, names: str) -> str:
    """SQL of the neighbour values of every sample: one join per name, as dr:dc."""
    places = dict(x.split("=") for x in names.split())
    cols, joins = "", ""
    for n, at in places.items():
        dr, dc = at.split(":")
        cols += f", {n}.v AS {n}"
        joins += f" LEFT JOIN {table} {n} ON {n}.r = p.r + ({dr}) AND {n}.c = p.c + ({dc})"
    return f"nb AS (SELECT p.r, p.c, p.v{cols} FROM {table} p{joins})"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"WITH {PX} SELECT CAST((r % 2) * 2 + c % 2 AS INTEGER) AS phase, round(avg(v), 9) AS level, count(*) AS n FROM px GROUP BY 1")
def black_level_by_phase(spark, d):
    return rounded(levels.black_levels(px(spark, d)), 9, "level")


@query(f"WITH {PX}, b AS (SELECT (r % 2) * 2 + c % 2 AS p, avg(v) AS l FROM px GROUP BY 1) SELECT r, c, round(greatest(v - l, 0.0) / (1.0 - l), 9) AS v FROM px JOIN b ON b.p = (r % 2) * 2 + c % 2")
def rescale_by_phase(spark, d):
    x = px(spark, d)
    return rounded(levels.rescale(x, levels.black_levels(x), 1.0), 9, "v")


SUPER = f"WITH {PX}, ends AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px), q AS (SELECT px.*, (r % 2) * 2 + c % 2 AS k FROM px, ends WHERE r < h // 2 * 2 AND c < w // 2 * 2)"


def shape(spark, d):
    """Lines and samples of the grid: two numbers."""
    r = read(spark, d, "embeddings").agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    return r[0] or 0, r[1] or 0


@query(SUPER + " SELECT r // 2 AS r, c // 2 AS c, round(avg(v) FILTER (k = 0), 9) AS red, round(avg(v) FILTER (k IN (1, 2)), 9) AS green, round(avg(v) FILTER (k = 3), 9) AS blue FROM q GROUP BY 1, 2")
def superpixel_rgb(spark, d):
    return rounded(levels.superpixel(px(spark, d), *shape(spark, d)), 9, "red", "green", "blue")


@query(SUPER + " SELECT r // 2 AS r, c // 2 AS c, max(v) FILTER (k = 0) AS ch0, max(v) FILTER (k = 1) AS ch1, max(v) FILTER (k = 2) AS ch2, max(v) FILTER (k = 3) AS ch3 FROM q GROUP BY 1, 2")
def superpixel_4ch(spark, d):
    return levels.superpixel4(px(spark, d), *shape(spark, d))


@query(f"WITH {PX} SELECT r - 10 AS r, c - 4 AS c, v FROM px WHERE r BETWEEN 10 AND 209 AND c BETWEEN 4 AND 51")
def crop_rebase(spark, d):
    return grid.crop(px(spark, d), 4, 10, 48, 200)


@query(f"WITH {PX} SELECT r // 32 AS tile_r, c // 16 AS tile_c, r % 32 AS r, c % 16 AS c, v FROM px")
def tile_assign(spark, d):
    return grid.tiles(px(spark, d), 32, 16)


@query(f"WITH {PX}, e AS (SELECT max(r) AS h FROM px), g AS (SELECT unnest(CASE WHEN r = h THEN range(r, (h // 48 + 1) * 48) ELSE [r] END) AS r, c, v FROM px, e), k AS (SELECT r, unnest(CASE WHEN c = 63 THEN range(c, 80) ELSE [c] END) AS c, v FROM g) SELECT r // 48 AS tile_r, c // 20 AS tile_c, r % 48 AS r, c % 20 AS c, v FROM k")
def tile_padded(spark, d):
    h, w = shape(spark, d)
    return grid.pad_tiles(px(spark, d), h, w, 48, 20)


for _turns, _r, _c in (("90cw", "c", "h - 1 - r"), ("90ccw", "63 - c", "r"), ("180", "h - 1 - r", "63 - c"), ("transpose", "c", "r")):
    query(f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px) SELECT {_r} AS r, {_c} AS c, v FROM px, e", f"rotate_{_turns}")(lambda spark, d, t=_turns: grid.rotate(px(spark, d), *shape(spark, d), t))


@query(f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px) SELECT CAST(r // 2 + (r % 2) * (h // 2) AS BIGINT) AS r, CAST(c // 2 + (c % 2) * 32 AS BIGINT) AS c, v FROM px, e")
def deinterleave_2x2(spark, d):
    return grid.deinterleave(px(spark, d), *shape(spark, d))


RING = "n1=-1:0 s1=1:0 w1=0:-1 e1=0:1 nw=-1:-1 ne=-1:1 sw=1:-1 se=1:1"


def sql_mean(*names: str) -> str:
    return f"(({' + '.join(f'coalesce({n}, 0.0)' for n in names)}) / nullif({' + '.join(f'CAST({n} IS NOT NULL AS INTEGER)' for n in names)}, 0))"


@query(
    f"WITH {PX}, {near('px', RING)} SELECT r, c, "
    f"round(CASE WHEN (r + c) % 2 = 0 AND r % 2 = 0 THEN v WHEN (r + c) % 2 = 0 THEN {sql_mean('nw', 'ne', 'sw', 'se')} WHEN r % 2 = 0 THEN {sql_mean('w1', 'e1')} ELSE {sql_mean('n1', 's1')} END, 9) AS red, "
    f"round(CASE WHEN (r + c) % 2 = 1 THEN v ELSE {sql_mean('n1', 's1', 'w1', 'e1')} END, 9) AS green, "
    f"round(CASE WHEN (r + c) % 2 = 0 AND r % 2 = 1 THEN v WHEN (r + c) % 2 = 0 THEN {sql_mean('nw', 'ne', 'sw', 'se')} WHEN r % 2 = 0 THEN {sql_mean('n1', 's1')} ELSE {sql_mean('w1', 'e1')} END, 9) AS blue FROM nb"
)
def bilinear_rgb(spark, d):
    return rounded(demosaic.bilinear(px(spark, d)), 9, "red", "green", "blue")


CROSS = "n1=-1:0 n2=-2:0 s1=1:0 s2=2:0 w1=0:-1 w2=0:-2 e1=0:1 e2=0:2"


@query(
    f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px), {near('px', CROSS)}, g AS (SELECT *, abs(v - n2) * 2 + abs(n1 - s1) AS gn, abs(v - e2) * 2 + abs(e1 - w1) AS ge, abs(v - w2) * 2 + abs(w1 - e1) AS gw, abs(v - s2) * 2 + abs(s1 - n1) AS gs FROM nb, e WHERE r BETWEEN 3 AND h - 4 AND c BETWEEN 3 AND 60) "
    "SELECT r, c, round(CASE WHEN (r + c) % 2 = 1 THEN v WHEN gn = least(gn, ge, gw, gs) THEN (n1 * 3 + s1 + v - n2) / 4 WHEN ge = least(gn, ge, gw, gs) THEN (e1 * 3 + w1 + v - e2) / 4 WHEN gw = least(gn, ge, gw, gs) THEN (w1 * 3 + e1 + v - w2) / 4 ELSE (s1 * 3 + n1 + v - s2) / 4 END, 9) AS green FROM g"
)
def ppg_green(spark, d):
    return rounded(demosaic.ppg_green(px(spark, d), *shape(spark, d)), 9, "green")


COLOUR = "CASE WHEN (q.r + q.c) % 2 = 1 THEN 1 WHEN q.r % 2 = 0 THEN 0 ELSE 2 END"


@query(
    f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px), j AS (SELECT p.r, p.c, q.v, {COLOUR} AS k, p.r = q.r AND p.c = q.c AS own FROM px p JOIN (SELECT unnest([-1, 0, 1]) AS dr) a ON true JOIN (SELECT unnest([-1, 0, 1]) AS dc) b ON true JOIN px q ON q.r = p.r + dr AND q.c = p.c + dc, e WHERE NOT (p.r BETWEEN 3 AND h - 4 AND p.c BETWEEN 3 AND 60)) "
    "SELECT r, c, " + ", ".join(f"round(coalesce(max(v) FILTER (own AND k = {k}), avg(v) FILTER (k = {k})), 9) AS {n}" for k, n in enumerate(("red", "green", "blue"))) + " FROM j GROUP BY r, c"
)
def ppg_border(spark, d):
    return rounded(demosaic.border_means(px(spark, d), *shape(spark, d)), 9, "red", "green", "blue")


#: Colours of the 6x6 mosaic (0 red, 1 green, 2 blue).
XTRANS = [[1, 1, 0, 1, 1, 2], [1, 1, 2, 1, 1, 0], [2, 0, 1, 0, 2, 1], [1, 1, 2, 1, 1, 0], [1, 1, 0, 1, 1, 2], [0, 2, 1, 2, 0, 1]]


@query(
    f"WITH {PX}, j AS (SELECT p.r, p.c, q.v, [{', '.join(str(x) for row in XTRANS for x in row)}][CAST((q.r % 6) * 6 + q.c % 6 + 1 AS INTEGER)] AS k FROM px p JOIN (SELECT unnest(range(-2, 3)) AS dr) a ON true JOIN (SELECT unnest(range(-2, 3)) AS dc) b ON true JOIN px q ON q.r = p.r + dr AND q.c = p.c + dc) "
    "SELECT r, c, " + ", ".join(f"round(avg(v) FILTER (k = {k}), 9) AS {n}" for k, n in enumerate(("red", "green", "blue"))) + " FROM j GROUP BY r, c"
)
def xtrans_bilinear(spark, d):
    return rounded(demosaic.window_means(px(spark, d), XTRANS), 9, "red", "green", "blue")


@query(f"WITH {IX}, {near('ix', 'w1=0:-1 e1=0:1')} SELECT r, c, CAST(CASE WHEN c % 2 = 0 THEN v WHEN e1 IS NULL THEN w1 ELSE (w1 + e1 + 1) // 2 END AS BIGINT) AS v FROM nb")
def chroma_interp(spark, d):
    return demosaic.chroma(ix(spark, d))


PRED = {1: "a", 2: "b", 3: "d", 4: "a + b - d", 5: "a + ((b - d) >> 1)", 6: "b + ((a - d) >> 1)", 7: "(a + b) >> 1"}
LJ = f"WITH {IX}, {near('ix', 'a=0:-1 b=-1:0 d=-1:-1')}"


def _diff(p: int) -> str:
    guess = f"CASE WHEN r = 0 AND c = 0 THEN 32768 WHEN r = 0 THEN a WHEN c = 0 THEN b ELSE {PRED[p]} END"
    return f"CAST(((v - ({guess}) + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT)"


for _p in PRED:
    query(f"{LJ} SELECT r, c, {_diff(_p)} AS diff FROM nb", f"ljpeg_diff_p{_p}")(lambda spark, d, p=_p: lossless.residuals(ix(spark, d), p))


@query(f"{LJ}, x AS (SELECT {_diff(4)} AS diff FROM nb) SELECT CAST(CASE WHEN diff = 0 THEN 0 ELSE length(bin(abs(diff))) END AS INTEGER) AS ssss, count(*) AS n FROM x GROUP BY 1")
def ssss_histogram(spark, d):
    return lossless.histogram(lossless.residuals(ix(spark, d), 4))


@query()
def code_lengths(spark, d):
    """Built on the driver from the histogram, which has 17 rows at most."""
    counts = {r["ssss"]: r["n"] for r in lossless.histogram(lossless.residuals(ix(spark, d), 4)).collect()}
    return spark.createDataFrame(sorted(lossless.code_lengths(counts).items()), "ssss int, bits int")


@query("SELECT event_id, value, CAST(floor(least(greatest(coalesce(value, 0.0), 0.0), 65535.0)) AS BIGINT) AS v16, CAST(floor(floor(least(greatest(coalesce(value, 0.0), 0.0), 4095.0)) / 4095.0 * 65535) AS BIGINT) AS scaled FROM events")
def saturate_u16(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", "value", numeric.saturate(v).alias("v16"), numeric.scale_bits(numeric.saturate(v, 4095), 12).alias("scaled"))


@query("WITH k AS (SELECT i AS x, i * i // 65535 AS y FROM range(0, 65536) t(i)) SELECT event_id, CAST(y AS BIGINT) AS y FROM events LEFT JOIN k ON x = CAST(floor(least(greatest(value * 100, 0.0), 65535.0)) AS BIGINT)")
def linearize_lut(spark, d):
    curve = spark.range(65536).select(F.col("id").alias("x"), F.expr("id * id div 65535").alias("y"))
    ev = read(spark, d, "events").select("event_id", numeric.saturate(F.col("value") * 100).alias("key"))
    return numeric.lut(ev, "key", curve).select("event_id", "y")


@query("SELECT CAST(i AS BIGINT) AS x, CAST(CASE WHEN i >= 3000 THEN 9500 + (i - 3000) * 16 WHEN i >= 2500 THEN 5500 + (i - 2500) * 8 WHEN i >= 2000 THEN 3500 + (i - 2000) * 4 WHEN i >= 1500 THEN 2500 + (i - 1500) * 2 ELSE i END AS BIGINT) AS y FROM range(0, 4096) t(i)".replace("2500 + (i - 1500)", "1500 + (i - 1500)").replace("3500 + (i - 2000)", "2500 + (i - 2000)").replace("5500 + (i - 2500)", "4500 + (i - 2500)").replace("9500 + (i - 3000)", "8500 + (i - 3000)"))
def sony_curve(spark, d):
    return spark.range(4096).select(F.col("id").alias("x")).withColumn("y", numeric.doubling_curve([1500, 2000, 2500, 3000], 4096))


@query("SELECT event_id, round(((0.0001 * value + -0.002) * value + 0.5) * value + 1.5 + value, 10) AS y FROM events")
def poly_curve(spark, d):
    return read(spark, d, "events").select("event_id", F.round(numeric.polynomial(F.col("value"), [1.5, 0.5, -0.002, 0.0001]), 10).alias("y"))


U = "abs(v)"


@query(f"WITH {PX} SELECT r, c, round(CASE WHEN {U} <= 0.00304 THEN {U} * 12.92 ELSE pow({U}, 1 / 2.4) * 1.055 - 0.055 END, 8) AS s FROM px")
def srgb_gamma(spark, d):
    return px(spark, d).select("r", "c", F.round(colour.srgb(F.abs("v")), 8).alias("s"))


@query(f"WITH {PX} SELECT r, c, round(CASE WHEN {U} <= 0.00304 * 12.92 THEN {U} / 12.92 ELSE pow(({U} + 0.055) / 1.055, 2.4) END, 8) AS lin, round(pow({U}, 1 / 2.2), 8) AS g, round(pow({U}, 1.8), 8) AS gi FROM px")
def gamma_inverse(spark, d):
    v = F.abs("v")
    return px(spark, d).select("r", "c", F.round(colour.srgb_inverse(v), 8).alias("lin"), F.round(colour.gamma(v, 2.2), 8).alias("g"), F.round(colour.gamma_inverse(v, 1.8), 8).alias("gi"))


RGB3 = "e AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS x, abs(CAST(embedding[2] AS DOUBLE)) AS y, abs(CAST(embedding[3] AS DOUBLE)) AS z FROM embeddings)"


def three(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", *(F.abs(e[i].cast("double")).alias(n) for i, n in enumerate("xyz")))


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > {216 / 24389!r} THEN cbrt({t}) ELSE ({t} * {24389 / 27!r} + 16) / 116 END)"


@query(f"WITH {RGB3} SELECT vec_id, round({_f('y')} * 116 - 16, 6) AS l, round(({_f('x / 0.9505')} - {_f('y')}) * 500, 6) AS a, round(({_f('y')} - {_f('z / 1.089')}) * 200, 6) AS b FROM e")
def xyz_lab(spark, d):
    out = colour.lab(F.col("x"), F.col("y"), F.col("z"), (0.9505, 1.0, 1.089))
    return three(spark, d).select("vec_id", *(F.round(c, 6).alias(n) for c, n in zip(out, "lab", strict=True)))


#: The sRGB primaries' matrix, once more, so that SQL works the camera's matrix out by itself.
_PRIMARIES = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_CELLS = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
_PRODUCT = ", ".join("(" + " + ".join(f"{CAMERA[i][k]!r}::DOUBLE * {_PRIMARIES[k][j]!r}::DOUBLE" for k in range(3)) + f") AS {_CELLS[3 * i + j]}" for i in range(3) for j in range(3)).replace("np.float64(", "(")
_SUMMED = ", ".join(f"{_CELLS[3 * i + j]} / ({' + '.join(_CELLS[3 * i : 3 * i + 3])}) AS {_CELLS[3 * i + j]}" for i in range(3) for j in range(3))
_COFACTORS = ("e * i - f * h", "c * h - b * i", "b * f - c * e", "f * g - d * i", "a * i - c * g", "c * d - a * f", "d * h - e * g", "b * g - a * h", "a * e - b * d")
_INVERSE = f"m AS (SELECT {_PRODUCT}), s AS (SELECT {_SUMMED} FROM m), inv AS (SELECT a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det, [" + ", ".join(_COFACTORS) + "] AS k FROM s)"


@query(f"WITH {RGB3}, {_INVERSE} SELECT vec_id, " + ", ".join(f"round((k[{3 * i + 1}] * x + k[{3 * i + 2}] * y + k[{3 * i + 3}] * z) / det, 7) AS {n}" for i, n in enumerate(("red", "green", "blue"))) + " FROM e, inv")
def camera_matrix(spark, d):
    out = colour.matrix(colour.camera_to_rgb(CAMERA), [F.col(n) for n in "xyz"])
    return three(spark, d).select("vec_id", *(F.round(c, 7).alias(n) for c, n in zip(out, ("red", "green", "blue"), strict=True)))


def _clip(n: str) -> str:
    return f"round(CASE WHEN top > 1 THEN ({n} / top + least({n} / norm, 1.0)) / 2 ELSE {n} END, 8)"


@query(f"WITH {RGB3}, k AS (SELECT vec_id, x * 6 AS x, y * 6 AS y, z * 6 AS z FROM e), t AS (SELECT *, greatest(x, y, z) AS top, sqrt(x * x + y * y + z * z) / sqrt(3.0) AS norm FROM k) SELECT vec_id, {_clip('x')} AS red, {_clip('y')} AS green, {_clip('z')} AS blue FROM t")
def colour_clip(spark, d):
    p = three(spark, d).select("vec_id", levels.colour_clip(F.array(*(F.col(n) * 6 for n in "xyz"))).alias("p"))
    return p.select("vec_id", *(F.round(F.col("p")[i], 8).alias(n) for i, n in enumerate(("red", "green", "blue"))))


def _cells(m: np.ndarray) -> list[tuple[int, int, float]]:
    return [(i, j, round(float(x), 6)) for i, row in enumerate(m) for j, x in enumerate(row)]


#: The published adaptation from illuminant A to D65, to two digits.
@query("SELECT i, j, CAST(x AS DOUBLE) AS x FROM (VALUES (0, 0, 0.84), (0, 1, -0.12), (0, 2, 0.39), (1, 0, -0.14), (1, 1, 1.10), (1, 2, 0.13), (2, 0, 0.08), (2, 1, -0.13), (2, 2, 3.19)) t(i, j, x)")
def bradford(spark, d):
    return spark.createDataFrame([(i, j, round(x, 2)) for i, j, x in _cells(colour.bradford("A", "D65"))], "i int, j int, x double")


@query(f"WITH {_INVERSE} SELECT CAST((n - 1) // 3 AS INTEGER) AS i, CAST((n - 1) % 3 AS INTEGER) AS j, round(k[n] / det, 6) AS x FROM inv, range(1, 10) t(n)")
def pinv_matrix(spark, d):
    """The matrix from camera to linear sRGB: the pseudo-inverse of rows that sum to 1."""
    return spark.createDataFrame(_cells(colour.camera_to_rgb(CAMERA)), "i int, j int, x double")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def dim_lookup_exact(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return lookup.exact(o, c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def dim_lookup_anti(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return lookup.missing(c, o, o.o_custkey == c.c_custkey).select("c_custkey", "c_name")


@query(
    "WITH r1 AS (SELECT c_nationkey AS k, min(c_name) AS v FROM customer WHERE c_acctbal > 9900 GROUP BY 1 HAVING count(DISTINCT c_name) = 1), r2 AS (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1 HAVING count(DISTINCT s_name) = 1), "
    "r3 AS (SELECT n_nationkey AS k, n_name AS v FROM nation) SELECT n.n_nationkey AS k, coalesce(r1.v, r2.v, r3.v) AS v, CAST(CASE WHEN r1.v IS NOT NULL THEN 1 WHEN r2.v IS NOT NULL THEN 2 WHEN r3.v IS NOT NULL THEN 3 END AS INTEGER) AS rule FROM nation n LEFT JOIN r1 ON r1.k = n.n_nationkey LEFT JOIN r2 ON r2.k = n.n_nationkey LEFT JOIN r3 ON r3.k = n.n_nationkey"
)
def resolve_fallback(spark, d):
    c, s, n = (read(spark, d, t) for t in ("customer", "supplier", "nation"))
    rules = [c.filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v")), s.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v")), n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))]
    return lookup.resolve(n.select(F.col("n_nationkey").alias("k")), "k", rules, "v")


@query("SELECT l_orderkey, l_linenumber, CAST(sign(CAST(l_partkey AS HUGEINT) * (l_linenumber + 1) - CAST(l_suppkey AS HUGEINT) * (l_orderkey + 1)) AS INTEGER) AS cmp FROM lineitem")
def rational_compare(spark, d):
    cmp = numeric.compare(F.col("l_partkey"), F.col("l_orderkey") + 1, F.col("l_suppkey"), F.col("l_linenumber") + 1)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cmp.alias("cmp"))


@query("SELECT p_brand, p_type, count(*) AS n, CAST(grouping_id(p_brand, p_type) AS BIGINT) AS level FROM part GROUP BY ROLLUP (p_brand, p_type)")
def catalogue_rollup(spark, d):
    return lookup.rollup(read(spark, d, "part"), "p_brand", "p_type")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS models, count(DISTINCT p_type) AS n_models FROM part GROUP BY 1")
def catalogue_modes(spark, d):
    return lookup.catalogue(read(spark, d, "part"), "p_brand", "p_type")


RECTS = [(2, 5, 10, 40), (8, 20, 30, 100), (60, 0, 4, 500)]


@query(f"WITH {PX}, k(rect, x, y, w, h) AS (VALUES " + ", ".join(f"({i}, {x}, {y}, {w}, {h})" for i, (x, y, w, h) in enumerate(RECTS)) + ") SELECT CAST(rect AS INTEGER) AS rect, CAST((r % 2) * 2 + c % 2 AS INTEGER) AS phase, count(*) AS n, round(avg(v), 9) AS level FROM px JOIN k ON c BETWEEN x AND x + w - 1 AND r BETWEEN y AND y + h - 1 GROUP BY 1, 2")
def range_rects(spark, d):
    return grid.in_rects(px(spark, d), RECTS).groupBy("rect", grid.phase().alias("phase")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("level"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def keyed_union_last_wins(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    both = o.filter("o_orderkey % 2 = 0").unionByName(o.filter("o_orderkey % 2 <> 0"))
    return lookup.last_wins(both, ["o_custkey"], F.col("o_orderkey"))


@query("SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(c_mktsegment, s_name) AS v FROM supplier FULL JOIN customer ON c_custkey = s_suppkey")
def merge_left_precedence(spark, d):
    left = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return lookup.merge(left, read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k", "v")


@query("SELECT doc_id, md5(text) AS digest, octet_length(encode(text)) AS bytes FROM documents")
def md5_rows(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity < 24 AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def scan_filtered(spark, d):
    x = read(spark, d, "lineitem").filter((F.col("l_quantity") < 24) & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value >= 10) AS success, count(*) FILTER (value < 10) AS failure, arg_min(props, event_id) FILTER (value < 10) AS first_error FROM events GROUP BY 1")
def job_summary(spark, d):
    return lookup.summary(read(spark, d, "events").filter("value is not null"), "event_type", F.col("value") >= 10, "event_id", "props")


@query("WITH k AS (SELECT i AS o FROM range(0, 10) t(i)) SELECT o, o IN (5, 6, 7, 8) AS t, o IN (2, 3, 7, 8) AS h, o IN (3, 4, 6, 7) AS v FROM k")
def orientation_flips(spark, d):
    return spark.range(10).select(F.col("id").alias("o"), *(c.alias(n) for c, n in zip(grid.flips(F.col("id")), "thv", strict=True)))


@query()
def develop_srgb(spark, d):
    """The whole pipeline on the grid; its values have no SQL: tests hold the reconstruction against loops, and its steps have queries of their own."""
    h, w = shape(spark, d)
    masked = [(0, 0, 8, h)]  # the first eight samples of each line
    return develop.develop(grid.integers(px(spark, d)).withColumn("v", F.col("v").cast("double")), 2000.0, h, w, CAMERA, crop=(8, 8, 48, max(h - 16, 0)), masked=masked)
