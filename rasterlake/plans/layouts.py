"""Queries of stored orders, calibration and the rest of the gradient reconstruction, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import demosaic, grid, layouts

from .queries import PX, near, px, query, read, rounded, shape


@query(f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px), s AS (SELECT r * 64 + c AS i, v, h FROM px, e), k AS (SELECT *, i < 2 * 24 * h AS early FROM s) SELECT CASE WHEN early THEN i % (24 * h) // 24 ELSE (i - 48 * h) // 16 END AS r, CASE WHEN early THEN i // (24 * h) * 24 + i % 24 ELSE 48 + (i - 48 * h) % 16 END AS c, v FROM k")
def slices_joined(spark, d):
    return layouts.from_slices(px(spark, d).select((F.col("r") * 64 + F.col("c")).alias("i"), "v"), shape(spark, d)[0], 2, 24, 16)


@query(f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px) SELECT CASE WHEN r % 2 = 0 THEN r // 2 ELSE h - 1 - r // 2 END AS r, c, v FROM px, e")
def interlaced_lines(spark, d):
    return layouts.interlaced(px(spark, d), shape(spark, d)[0])


@query(f"WITH {PX} SELECT r, (c + [0, 5, 9, 3][r % 4 + 1] + r * [7, 1, 2, 11][r % 4 + 1]) % 64 AS c, v FROM px")
def turned_lines(spark, d):
    return layouts.turned_lines(px(spark, d), 64, [7, 1, 2, 11], [0, 5, 9, 3])


@query(f"WITH {PX} SELECT r * 2 + c % 4 // 2 AS r, c // 4 * 2 + c % 2 AS c, v FROM px")
def quads_unpacked(spark, d):
    x = read(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))).alias("c", "v"))
    return layouts.quads(x).withColumn("v", F.col("v").cast("double"))


@query(f"WITH {PX} SELECT 63 - c + r // 2 AS r, (r + 1) // 2 + c AS c, v FROM px")
def sensor_45_degrees(spark, d):
    return layouts.on_45_degrees(px(spark, d), 64)


@query(f"WITH {PX} SELECT 31 + r - c // 2 AS r, (c + 1) // 2 + r AS c, v FROM px")
def sensor_45_degrees_other(spark, d):
    return layouts.on_45_degrees(px(spark, d), 64, other=True)


_NEAR = "CASE WHEN x0 >= 0 AND y0 >= 0 AND x0 + 1 < 64 AND y0 + 1 < 64"


@query(
    f"WITH {PX}, sq AS (SELECT r // 64 AS g, r % 64 AS r, c, v FROM px), t AS (SELECT g, tr, tc, (tc - 28 + tr - 16.5) * sqrt(0.5::DOUBLE) + 32 AS x, (tr - 16.5 - (tc - 28)) * sqrt(0.5::DOUBLE) + 32 AS y FROM (SELECT CAST(a.i AS DOUBLE) AS tr, CAST(b.i AS DOUBLE) AS tc FROM range(0, 33) a(i), range(0, 56) b(i)), (SELECT DISTINCT g FROM sq)), "
    "k AS (SELECT *, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0, CAST(round(x) AS BIGINT) AS sx, CAST(round(y) AS BIGINT) AS sy FROM t) "
    f"SELECT k.g AS image, CAST(tr AS BIGINT) AS r, CAST(tc AS BIGINT) AS c, round(coalesce({_NEAR} THEN coalesce(a.v, 0) * (1 - x + x0) * (1 - y + y0) + coalesce(b.v, 0) * (x - x0) * (1 - y + y0) + coalesce(p.v, 0) * (1 - x + x0) * (y - y0) + coalesce(q.v, 0) * (x - x0) * (y - y0) ELSE o.v END, 0), 9) AS v FROM k "
    "LEFT JOIN sq a ON a.g = k.g AND a.r = y0 AND a.c = x0 LEFT JOIN sq b ON b.g = k.g AND b.r = y0 AND b.c = x0 + 1 LEFT JOIN sq p ON p.g = k.g AND p.r = y0 + 1 AND p.c = x0 LEFT JOIN sq q ON q.g = k.g AND q.r = y0 + 1 AND q.c = x0 + 1 LEFT JOIN sq o ON o.g = k.g AND o.r = sy AND o.c = sx"
)
def upright_45_degrees(spark, d):
    """Every 64 lines are an image, the last one perhaps with fewer."""
    squares = px(spark, d).select(F.expr("r div 64").alias("image"), F.expr("r % 64").alias("r"), "c", "v")
    return rounded(layouts.upright(squares, 64, 64, 24, "image"), 9, "v")


@query(f"WITH {PX}, i AS (SELECT r, c, CAST(floor((v + 1) * 1000) AS BIGINT) AS v FROM px) SELECT r, c, least(greatest(v - 300 + CASE WHEN c >= 30 THEN r % 7 ELSE r % 5 END + CASE WHEN r >= 40 THEN c % 3 ELSE 0 END, 0), 65535) AS v FROM i")
def quadrant_black(spark, d):
    x = grid.integers(px(spark, d))
    lines = x.select("r").distinct().select("r", F.explode(F.array(F.struct(F.lit(0).alias("qc"), (F.col("r") % 5).alias("up")), F.struct(F.lit(1).alias("qc"), (F.col("r") % 7).alias("up")))).alias("s")).select("r", "s.*")
    columns = spark.range(64).select(F.col("id").alias("c"), F.lit(1).alias("qr"), (F.col("id") % 3).alias("across"))
    return layouts.quadrant_black(x, 300, lines, columns, 40, 30)


@query(f"WITH {PX}, i AS (SELECT r, c, CAST(floor((v + 1) * 1000) AS BIGINT) AS v FROM px) SELECT r, c, CAST(floor(v * CASE WHEN r >= 40 AND c >= 30 THEN 1.25::DOUBLE WHEN r >= 40 THEN 0.75::DOUBLE WHEN c >= 30 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) AS v FROM i")
def quadrant_gain(spark, d):
    return layouts.quadrant_gain(grid.integers(px(spark, d)), [[1.0, 1.5], [0.75, 1.25]], 40, 30)


@query(f"WITH {PX}, b AS (SELECT r, c, CAST(floor((v + 1) * 100) AS BIGINT) AS v FROM px) SELECT r, c, CAST(sum(v) OVER (PARTITION BY r, c % 2 ORDER BY c) % 256 AS BIGINT) AS v FROM b")
def byte_sums(spark, d):
    return layouts.byte_sums(px(spark, d).withColumn("v", F.floor((F.col("v") + 1) * 100).cast("long")), ["r"], "c", 2)


@query(f"WITH {PX}, {near('px', 'nw=-1:-1 ne=-1:1 sw=1:-1 se=1:1')}, m AS (SELECT *, (nw + ne + sw + se) / 4 AS m FROM nb WHERE nw + ne + sw + se IS NOT NULL) SELECT r, c, round((m * 4 - CASE greatest(abs(nw - m), abs(ne - m), abs(sw - m), abs(se - m)) WHEN abs(nw - m) THEN nw WHEN abs(ne - m) THEN ne WHEN abs(sw - m) THEN sw ELSE se END) / 3, 9) AS v FROM m")
def outlier_dropped(spark, d):
    p = grid.neighbours(px(spark, d), {"nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)})
    return p.select("r", "c", F.round(layouts.without_outlier(*(F.col(n) for n in ("nw", "ne", "sw", "se"))), 9).alias("v")).filter("v is not null")


def hue_sql(a: str, b: str) -> str:
    return f"CASE WHEN (g_{a} < g AND g < g_{b}) OR (g_{a} > g AND g > g_{b}) THEN v_{a} + (v_{b} - v_{a}) * (g - g_{a}) / (g_{b} - g_{a}) ELSE (v_{a} + v_{b}) / 2 + (g * 2 - g_{a} - g_{b}) / 4 END"


def _slope(a: str, b: str) -> str:
    return f"abs(v_{a} - v_{b}) + abs(v_{a}2 - v) + abs(v - v_{b}2) + abs(g_{a} - g) + abs(g - g_{b})"


def other_sql() -> str:
    return f"CASE WHEN {_slope('ne', 'sw')} < {_slope('nw', 'se')} THEN {hue_sql('ne', 'sw')} ELSE {hue_sql('nw', 'se')} END"


@query(
    f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px), q AS (SELECT r, c, v, v * v AS g FROM px), nb AS (SELECT p.*, e.h, "
    + ", ".join(f"{n}.v AS v_{n}, {n}.g AS g_{n}" for n in demosaic.DIAGONALS)
    + " FROM q p, e"
    + "".join(f" LEFT JOIN q {n} ON {n}.r = p.r + ({dr}) AND {n}.c = p.c + ({dc})" for n, (dr, dc) in demosaic.DIAGONALS.items()).replace(" LEFT JOIN", " LEFT JOIN", 1)
    + f") SELECT r, c, round(CASE WHEN (r + c) % 2 = 1 THEN CASE WHEN r % 2 = 0 THEN {hue_sql('w1', 'e1')} ELSE {hue_sql('n1', 's1')} END WHEN r % 2 = 0 THEN v ELSE {other_sql()} END, 9) AS red, "
    f"round(CASE WHEN (r + c) % 2 = 1 THEN CASE WHEN r % 2 = 0 THEN {hue_sql('n1', 's1')} ELSE {hue_sql('w1', 'e1')} END WHEN r % 2 = 0 THEN {other_sql()} ELSE v END, 9) AS blue FROM nb WHERE r BETWEEN 3 AND h - 4 AND c BETWEEN 3 AND 60"
)
def ppg_red_blue(spark, d):
    """With the squared samples as the guide."""
    return rounded(demosaic.ppg_red_blue(px(spark, d).withColumn("g", F.col("v") * F.col("v")), *shape(spark, d)), 9, "red", "blue")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_tax, 0), 6) AS red, round((l_tax + l_discount) / 2 / nullif(l_tax, 0), 6) AS green, round(l_extendedprice / nullif(l_tax, 0), 6) AS blue FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem)")
def white_balance(spark, d):
    x = read(spark, d, "lineitem")
    out = layouts.white_balance(*(F.col(n) for n in ("l_quantity", "l_tax", "l_discount", "l_extendedprice")))[:3]
    return x.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(n) for c, n in zip(out, ("red", "green", "blue"), strict=True)))
