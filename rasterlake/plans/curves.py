"""Queries of lookup curves and sensor rules, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.operators import curves, grid, lookup, sensor

from .queries import IX, PX, ix, near, px, query, read, rounded

GRID = f"WITH RECURSIVE {IX}"
KNOTS = "k AS (SELECT i, 60000 * i * i // 256 AS y FROM range(0, 17) t(i))"
CURVE = "cv AS (SELECT x, x * x // 64 AS y FROM range(0, 2048) t(x))"


def _cut(x: str) -> str:
    return f"CAST(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(trunc({x}), 0), 65535) END AS BIGINT)"


def squares(spark):
    return spark.range(2048).select(F.col("id").alias("x"), F.expr("id * id div 64").alias("y"))


@query(f"WITH {KNOTS}, q AS (SELECT i, y, lead(y) OVER (ORDER BY i) AS z FROM k) SELECT i * 256 + b AS x, ((256 - b) * y + b * z) // 256 AS y FROM q, range(0, 256) t(b) WHERE z IS NOT NULL")
def knot_curve(spark, d):
    return curves.from_knots(spark.range(17).select(F.col("id").alias("i"), F.expr("60000 * id * id div 256").alias("y")), 256)


@query(f"WITH {CURVE} SELECT x, CASE WHEN y = 0 THEN 0 ELSE y - (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) + 2) // 4 END AS base, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS delta FROM cv WINDOW w AS (ORDER BY x)")
def dither_table(spark, d):
    return curves.dither_table(squares(spark))


@query(
    f"{GRID}, {CURVE}, tb AS (SELECT x, CASE WHEN y = 0 THEN 0 ELSE y - (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) + 2) // 4 END AS base, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS delta FROM cv WINDOW w AS (ORDER BY x)), "
    "st AS (SELECT a.r, CAST(0 AS BIGINT) AS c, a.v + b.v * 65536 AS s FROM ix a JOIN ix b ON a.r = b.r AND a.c = 0 AND b.c = 1 UNION ALL SELECT r, c + 1, 15700 * (s & 65535) + (s >> 16) FROM st WHERE c < 63) "
    "SELECT r, c, base + ((delta * (s & 2047) + 1024) >> 12) AS v FROM ix JOIN st USING (r, c) JOIN tb ON tb.x = ix.v"
)
def dithered_curve(spark, d):
    """The sequence is run step by step in SQL, and by powers here."""
    return curves.dithered(ix(spark, d), squares(spark), 64)


SPLINE = [(0, 0), (400, 700), (900, 1100), (1500, 1400), (65535, 65535)]


def _spline_sql(points: list, v: str = "v") -> str:
    out = ""
    for x, a, b, c, e in reversed(curves.spline(points)):
        out += f" WHEN {v} >= {x!r}::DOUBLE THEN {a!r}::DOUBLE + ({v} - {x!r}::DOUBLE) * ({b!r}::DOUBLE + ({v} - {x!r}::DOUBLE) * ({c!r}::DOUBLE + ({v} - {x!r}::DOUBLE) * {e!r}::DOUBLE))"
    return _cut(f"CASE{out} END")


@query(f"WITH {IX} SELECT r, c, {_spline_sql(SPLINE)} AS v FROM ix")
def spline_curve(spark, d):
    """Coefficients come from one solution; a test compares it with the spline's definition."""
    return ix(spark, d).select("r", "c", curves.splined(F.col("v"), curves.spline(SPLINE)).alias("v"))


TABLES = [[[100 + 90 * k + 7 * i - 5 * j for k in range(16)] for j in (0, 1)] for i in (0, 1)]
_TARGETS = curves.shared_targets(TABLES)


@query(f"WITH {IX} SELECT r, c, CASE WHEN r < 200 AND c < 32 THEN {_spline_sql(_TARGETS[0][0])} WHEN r < 200 THEN {_spline_sql(_TARGETS[0][1])} WHEN c < 32 THEN {_spline_sql(_TARGETS[1][0])} ELSE {_spline_sql(_TARGETS[1][1])} END AS v FROM ix")
def quadrant_linearization(spark, d):
    return curves.quadrant_curves(ix(spark, d), _TARGETS, 200, 32)


@query(f"WITH {IX} SELECT r, c, CASE WHEN c >= 32 THEN {_cut('(v * 0.00025::DOUBLE + (0.01::DOUBLE + (31.0 - 25.0)::DOUBLE * 0.002::DOUBLE + 1.0)) * v + 3.0')} ELSE v END AS v FROM ix")
def right_half_curve(spark, d):
    return curves.right_half(ix(spark, d), 32, 0.00025, 0.01, 3.0, 0.002, 31.0, 25.0)


_FLAT = "g AS (SELECT y AS gy, x AS gx, 1 + ((y * 7 + x * 5) % 11) / 50.0::DOUBLE AS gain FROM range(0, 13) a(y), range(0, 5) b(x))"


@query(
    f"WITH {IX}, {_FLAT}, p AS (SELECT r, c, v, CAST(floor((r - 3) / 16) AS BIGINT) AS gy, CAST(floor((c - 2) / 12) AS BIGINT) AS gx FROM ix), "
    "q AS (SELECT p.*, (r - 3 - p.gy * 16) / 16.0::DOUBLE AS fy, (c - 2 - p.gx * 12) / 12.0::DOUBLE AS fx, a.gain AS a, b.gain AS b, s.gain AS s, t.gain AS t FROM p LEFT JOIN g a ON a.gy = p.gy AND a.gx = p.gx LEFT JOIN g b ON b.gy = p.gy AND b.gx = p.gx + 1 LEFT JOIN g s ON s.gy = p.gy + 1 AND s.gx = p.gx LEFT JOIN g t ON t.gy = p.gy + 1 AND t.gx = p.gx + 1) "
    f"SELECT r, c, coalesce({_cut('round(v * ((a + (b - a) * fx) + ((s + (t - s) * fx) - (a + (b - a) * fx)) * fy), 6)')}, v) AS v FROM q"
)
def flat_field(spark, d):
    nodes = spark.range(13 * 5).select(F.expr("id div 5").alias("gy"), F.expr("id % 5").alias("gx"))
    nodes = nodes.withColumn("gain", 1 + F.pmod(F.col("gy") * 7 + F.col("gx") * 5, F.lit(11)) / 50.0)
    return curves.flat_field(ix(spark, d), nodes, 3, 2, 16, 12)


@query(
    f"WITH {IX}, {_FLAT}, h AS (SELECT gy, gx, gain + k / 8.0::DOUBLE AS gain, CAST(k AS INTEGER) AS colour FROM g, (VALUES (0), (2)) z(k)), p AS (SELECT r, c, v, CAST(floor(r / 16) AS BIGINT) AS gy, CAST(floor(c / 16) AS BIGINT) AS gx, CASE WHEN r % 2 = 0 AND c % 2 = 0 THEN 0 WHEN r % 2 = 1 AND c % 2 = 1 THEN 2 END AS k FROM ix), "
    "q AS (SELECT p.*, (r - p.gy * 16) / 16.0::DOUBLE AS fy, (c - p.gx * 16) / 16.0::DOUBLE AS fx, a.gain AS a, b.gain AS b, s.gain AS s, t.gain AS t FROM p LEFT JOIN h a ON a.colour = k AND a.gy = p.gy AND a.gx = p.gx LEFT JOIN h b ON b.colour = k AND b.gy = p.gy AND b.gx = p.gx + 1 LEFT JOIN h s ON s.colour = k AND s.gy = p.gy + 1 AND s.gx = p.gx LEFT JOIN h t ON t.colour = k AND t.gy = p.gy + 1 AND t.gx = p.gx + 1) "
    f"SELECT r, c, coalesce({_cut('round(v * ((a + (b - a) * fx) + ((s + (t - s) * fx) - (a + (b - a) * fx)) * fy), 6)')}, v) AS v FROM q"
)
def flat_field_red_blue(spark, d):
    nodes = spark.range(13 * 5).select(F.expr("id div 5").alias("gy"), F.expr("id % 5").alias("gx"))
    nodes = nodes.withColumn("gain", 1 + F.pmod(F.col("gy") * 7 + F.col("gx") * 5, F.lit(11)) / 50.0)
    nodes = nodes.withColumn("colour", F.explode(F.array(F.lit(0), F.lit(2)))).withColumn("gain", F.col("gain") + F.col("colour") / 8.0)
    even = lambda c: F.pmod(F.col(c), F.lit(2)) == 0
    colour = F.when(even("r") & even("c"), 0).when(~even("r") & ~even("c"), 2)
    return curves.flat_field(ix(spark, d), nodes, 0, 0, 16, 16, colour)


def _table_sql(bits: int) -> str:
    top = (1 << bits) - 1
    return f"SELECT gamma, inverse, x, CAST(floor(round(pow(x / {top}::DOUBLE, CASE WHEN inverse THEN gamma ELSE 1 / gamma END) * 65535, 6)) AS BIGINT) AS y FROM range(0, {top + 1}) a(x), (VALUES (1.8::DOUBLE), (2.0::DOUBLE), (2.2::DOUBLE), (2.4::DOUBLE)) b(gamma), (VALUES (true), (false)) e(inverse)"


@query(_table_sql(8))
def gamma_tables_8bit(spark, d):
    return curves.tables(spark, 8, (1.8, 2.0, 2.2, 2.4))


@query(_table_sql(16))
def gamma_tables_16bit(spark, d):
    return curves.tables(spark, 16, (1.8, 2.0, 2.2, 2.4))


@query(
    f"WITH {IX}, e AS (SELECT max(r) + 1 AS h FROM ix), {near('ix', 'nw=-1:-1 sw=1:-1 ne=-1:1 se=1:1 a=2:-2 b=-2:-2 d=2:2 e=-2:2 w2=0:-2 e2=0:2')}, "
    "m AS (SELECT *, nw + sw + ne + se AS t, greatest(abs(nw * 4 - (nw + sw + ne + se)), abs(sw * 4 - (nw + sw + ne + se)), abs(ne * 4 - (nw + sw + ne + se)), abs(se * 4 - (nw + sw + ne + se))) AS far FROM nb) "
    "SELECT r, c, CASE WHEN c NOT IN (7, 20, 21) OR r < 2 OR r > h - 3 THEN v WHEN (r + c) % 2 = 1 THEN (t - CASE far WHEN abs(nw * 4 - t) THEN nw WHEN abs(sw * 4 - t) THEN sw WHEN abs(ne * 4 - t) THEN ne ELSE se END + 1) // 3 "
    "ELSE CAST(floor((a + b + d + m.e) * 0.0732233::DOUBLE + (w2 + e2) * 0.3535534::DOUBLE + 0.5) AS BIGINT) END AS v FROM m, e"
)
def bad_columns(spark, d):
    p = ix(spark, d)
    return sensor.bad_columns(p, [7, 20, 21], p.agg(F.max("r")).first()[0] + 1)


Y3 = "p AS (SELECT vec_id, CAST(floor((embedding[1] + 1) * 20000) AS BIGINT) AS y, CAST(floor((embedding[2] + 1) * 16383) AS BIGINT) AS cb, CAST(floor((embedding[3] + 1) * 16383) AS BIGINT) AS cr FROM e), q AS (SELECT *, cb - 16383 AS b, cr - 16383 AS r FROM p)"
Y3 = "e AS (SELECT vec_id, CAST(embedding[1:3] AS DOUBLE[]) AS embedding FROM embeddings), " + Y3


def ycc(spark, d):
    at = lambda i, k: F.floor((F.col("embedding")[i].cast("double") + 1) * k).cast("long")
    return read(spark, d, "embeddings").select("vec_id", at(0, 20000).alias("y"), at(1, 16383).alias("cb"), at(2, 16383).alias("cr"))


@query(f"WITH {Y3} SELECT vec_id, {_cut('round(y + r * 1.4::DOUBLE, 6)')} AS red, {_cut('round(y + b * -0.343::DOUBLE + r * -0.711::DOUBLE, 6)')} AS green, {_cut('round(y + b * 1.765::DOUBLE, 6)')} AS blue FROM q")
def luma_chroma(spark, d):
    return ycc(spark, d).select("vec_id", *(x.alias(n) for x, n in zip(sensor.luma_chroma(F.col("y"), F.col("cb"), F.col("cr")), ("red", "green", "blue"), strict=True)))


def _shifted(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {1 << n}::DOUBLE) AS BIGINT)"


def _small(version: int) -> str:
    if version == 1:
        parts = [_shifted(x, 14) for x in ("50 * (b * 4 + 9) + 22929 * (r * 4 + 9)", "-5640 * (b * 4 + 9) - 11751 * (r * 4 + 9)", "29040 * (b * 4 + 9) - 101 * (r * 4 + 9)")]
    else:
        parts = ["r", _shifted("-778 * b - r * 2048", 12), "b"]
    y = "y - 512" if version == 0 else "y"
    return f"WITH {Y3} SELECT vec_id, " + ", ".join(f"least(greatest({_shifted(f'({y} + {p}) * {g}', 8)}, 0), 65535) AS {n}" for p, g, n in zip(parts, (480, 256, 390), ("red", "green", "blue"), strict=True)) + " FROM q"


def _add_small(version: int) -> None:
    @query(_small(version), name=f"small_raw_v{version}")
    def run(spark, d):
        out = sensor.small_raw(version, F.col("y"), F.col("cb"), F.col("cr"), (480, 256, 390), 9)
        return ycc(spark, d).select("vec_id", *(x.alias(n) for x, n in zip(out, ("red", "green", "blue"), strict=True)))


for _v in (0, 1, 2):
    _add_small(_v)

MATRIX = [[0.9, -0.3, -0.1], [-0.4, 1.2, 0.2], [-0.1, 0.2, 0.7]]


def _balance(row: list[float]) -> str:
    s = " + ".join(f"{k!r}::DOUBLE * {v}" for k, v in zip(row, ("(x / y)", "1.0", "((1 - x - y) / y)"), strict=True))
    return f"CASE WHEN y > 0 AND {s} > 0 THEN round(1 / ({s}), 9) ELSE 0 END"


@query("WITH e AS (SELECT l_orderkey, l_linenumber, 0.2::DOUBLE + l_discount AS x, CAST(l_tax * 5 AS DOUBLE) AS y FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_balance(r)} AS {n}" for r, n in zip(MATRIX, ("red", "green", "blue"), strict=True)) + " FROM e")
def white_point_balance(spark, d):
    e = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(0.2) + F.col("l_discount")).alias("x"), (F.col("l_tax") * 5).cast("double").alias("y"))
    e = e.withColumn("y", F.nullif("y", F.lit(0.0)))
    out = sensor.white_from_xy(F.col("x"), F.col("y"), MATRIX)
    return rounded(e.select("l_orderkey", "l_linenumber", *(x.alias(n) for x, n in zip(out, ("red", "green", "blue"), strict=True))), 9, "red", "green", "blue")


@query(f"WITH {IX} SELECT r, c, CASE WHEN v // 8 < 256 THEN CAST(floor((v // 8) * (v // 8) / 3.969::DOUBLE + 0.5) AS BIGINT) << 2 ELSE v // 8 END AS v FROM ix")
def field_tone(spark, d):
    return ix(spark, d).select("r", "c", sensor.field_tone(F.expr("v div 8"), 2).alias("v"))


@query(f"WITH {IX} SELECT r, c, v * 4 + CASE WHEN r % 3 = 0 THEN 0 ELSE (v * 7) % 4 END AS v FROM ix")
def low_bits_joined(spark, d):
    p = ix(spark, d)
    return sensor.low_bits(p, p.filter("r % 3 <> 0").withColumn("v", F.pmod(F.col("v") * 7, F.lit(4))))


@query(f"WITH {IX} SELECT r // 4 * 2 + r % 4 // 2 AS r, c * 2 + r % 2 AS c, v FROM ix")
def planes_placed(spark, d):
    return sensor.placed_planes(ix(spark, d).select(F.expr("r % 4").alias("plane"), F.expr("r div 4").alias("r"), "c", "v"))


@query(f"WITH {IX} SELECT r, c, ('RGGB')[CAST(((r - 1) % 2 + 2) % 2 * 2 + ((c - 3) % 2 + 2) % 2 + 1 AS INTEGER)] AS colour FROM ix")
def pattern_colours(spark, d):
    return ix(spark, d).select("r", "c", sensor.colour_at("RGGB", 2, F.col("r"), F.col("c"), 1, 3).alias("colour"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 50000 GROUP BY 1")
def first_usable_frame(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return sensor.first_usable(o, "o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F") & (F.col("o_totalprice") > 50000)).drop("o_totalprice")


@query("WITH k AS (SELECT p_brand, p_type, min(p_partkey) AS p_partkey, list_position(['MEDIUM', 'SMALL', 'LARGE'], p_type) AS k FROM part GROUP BY p_brand, p_type) SELECT p_brand, arg_min(p_type, k) AS p_type, arg_min(p_partkey, k) AS p_partkey FROM k WHERE k > 0 GROUP BY p_brand")
def matrix_by_rank(spark, d):
    p = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))
    return sensor.by_rank(p, "p_brand", "p_type", ["MEDIUM", "SMALL", "LARGE"])


RECT = "e AS (SELECT l_orderkey, l_linenumber, l_partkey % 400 + 60 AS w, l_suppkey % 300 + 60 AS h, l_linenumber * 9 AS l, l_linenumber * 7 AS t FROM lineitem), f AS (SELECT *, w - 20 - l AS rw, h - 30 - t AS rh FROM e)"


@query(f"WITH {RECT} SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN rw END AS w, CASE WHEN ok THEN rh END AS h, CASE WHEN ok THEN w - l - rw END AS right_, CASE WHEN ok THEN h - t - rh END AS bottom, CASE WHEN ok AND l >= 10 AND t >= 5 AND rw <= 300 AND rh <= 200 THEN l - 10 END AS x_in, CASE WHEN ok AND l >= 10 AND t >= 5 AND rw <= 300 AND rh <= 200 THEN t - 5 END AS y_in FROM (SELECT *, rw >= 0 AND rh >= 0 AS ok FROM f)")
def rectangles(spark, d):
    e = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey % 400 + 60").alias("w"), F.expr("l_suppkey % 300 + 60").alias("h"), F.expr("l_linenumber * 9").alias("l"), F.expr("l_linenumber * 7").alias("t"))
    e = e.withColumn("q", sensor.from_borders(F.col("w"), F.col("h"), F.col("l"), F.col("t"), F.lit(20), F.lit(30)))
    off = sensor.border_offsets(F.col("q"), F.col("w"), F.col("h"))
    e = e.withColumn("o", F.struct(F.lit(10).alias("x"), F.lit(5).alias("y"), F.lit(300).alias("w"), F.lit(200).alias("h")))
    e = e.withColumn("i", sensor.adapted(F.col("q"), F.col("o")))
    return e.select("l_orderkey", "l_linenumber", F.col("q.w").alias("w"), F.col("q.h").alias("h"), off[2].alias("right_"), off[3].alias("bottom"), F.col("i.x").alias("x_in"), F.col("i.y").alias("y_in"))


PARTS = "z AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, l_linenumber, size, CAST(coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 3 THEN 5 ELSE 0 END AS BIGINT) AS start FROM z)"


@query(f"WITH {PARTS}, j AS (SELECT *, coalesce(lag(start + size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = start, true) AS joins FROM p), k AS (SELECT l_orderkey, bool_and(joins) AS one FROM j GROUP BY 1) SELECT l_orderkey, min(start) AS start, CAST(sum(size) AS BIGINT) AS size FROM p JOIN k USING (l_orderkey) WHERE one GROUP BY 1 UNION ALL SELECT l_orderkey, start, size FROM p JOIN k USING (l_orderkey) WHERE NOT one")
def byte_ranges(spark, d):
    from pyspark.sql import Window

    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    p = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("size"))
    gap = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 3), 5).otherwise(0)
    p = p.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + gap)
    return sensor.byte_ranges(p, "l_orderkey", "l_linenumber", "start", "size")


@query("SELECT l_orderkey, l_linenumber, printf('%02X %02X %02X', l_partkey % 256, l_suppkey % 256, l_linenumber % 256) AS lens FROM lineitem")
def composite_ids(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sensor.composite_id(F.expr("l_partkey % 256"), F.expr("l_suppkey % 256"), F.expr("l_linenumber % 256")).alias("lens"))


@query("SELECT event_id, CAST(trunc(round(value * 10000, 3)) AS BIGINT) AS n, 10000 AS d FROM events")
def fixed_rationals(spark, d):
    return read(spark, d, "events").select("event_id", sensor.rational(F.col("value"), 10000).alias("n"), F.lit(10000).alias("d"))


@query(f"WITH {IX}, m AS (SELECT r % 2 * 2 + c % 2 AS k, CAST(round(avg(v)) AS BIGINT) AS masked FROM ix WHERE c < 8 GROUP BY 1), f(k, camera, file) AS (VALUES (0, 10, 20), (1, NULL, 21), (2, NULL, NULL)) SELECT CAST(g.k AS INTEGER) AS k, coalesce(camera, file, masked, 0) AS level FROM range(0, 5) g(k) LEFT JOIN m USING (k) LEFT JOIN f USING (k)")
def level_priority(spark, d):
    masked = grid.crop(ix(spark, d), 0, 0, 8, 1 << 40).groupBy(grid.phase().alias("k")).agg(F.round(F.avg("v")).cast("long").alias("masked"))
    known = spark.createDataFrame([(0, 10, 20), (1, None, 21), (2, None, None)], "k int, camera int, file int")
    return spark.range(5).select(F.col("id").cast("int").alias("k")).join(masked, "k", "left").join(known, "k", "left").select("k", sensor.pick_level(F.col("camera"), F.col("file"), F.col("masked")).cast("long").alias("level"))


@query(
    "WITH d AS (SELECT s_suppkey, s_nationkey, s_acctbal AS low, s_acctbal + 900 AS high FROM supplier), f AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS q FROM customer) "
    "SELECT c_custkey, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS s_suppkey FROM f LEFT JOIN d ON s_nationkey = c_nationkey AND (q IS NULL OR q BETWEEN low AND high) GROUP BY 1"
)
def unique_range_lookup(spark, d):
    dim = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 900).alias("high"))
    f = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("q"))
    return lookup.unique_in_range(f, dim, "c_custkey", "nation", "q", "low", "high", "s_suppkey")


@query("SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS c_name FROM (SELECT o_orderkey, o_custkey * 2 AS k FROM orders) LEFT JOIN customer a ON a.c_custkey = k LEFT JOIN customer b ON b.c_custkey = k // 2 AND a.c_name IS NULL")
def lookup_retried(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return lookup.retried(o, c, "c_custkey", F.expr("c_custkey div 2"), "c_name").select("o_orderkey", "c_name")


@query("WITH p AS (SELECT o_orderkey, 'a.b/x.' || ['dng', 'Cr3', 'txt', 'NEF', 'dng/y', ''][o_orderkey % 6 + 1] AS path FROM orders) SELECT o_orderkey, coalesce(regexp_matches(path, '(?i)\\.(dng|cr3|nef)$'), false) AS ok FROM p")
def supported_files(spark, d):
    names = F.array(*map(F.lit, ("dng", "Cr3", "txt", "NEF", "dng/y", "")))
    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("a.b/x."), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("path"))
    return o.select("o_orderkey", lookup.supported(F.col("path")).alias("ok"))


@query("SELECT o_orderkey, CAST(f AS INTEGER) AS frame, CASE WHEN n = 1 THEN stem ELSE printf('%s_%04d', stem, f) END AS output FROM (SELECT o_orderkey, 'IMG' || o_orderkey AS stem, o_custkey % 4 AS n FROM orders), range(0, 4) t(f) WHERE f < n")
def frame_names(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("IMG"), F.col("o_orderkey")).alias("stem"), (F.col("o_custkey") % 4).alias("n"))
    return lookup.frames(o, "stem", "n").select("o_orderkey", "frame", "output")


@query(f"WITH {PX}, e AS (SELECT max(r) + 1 AS h FROM px), t AS (SELECT i AS r, j AS c, (2 * i + 1) * h // 126 AS sr, (2 * j + 1) * 64 // 46 AS sc FROM e, range(0, 63) a(i), range(0, 23) b(j)) SELECT t.r, t.c, v FROM t JOIN px ON px.r = sr AND px.c = sc")
def nearest_preview(spark, d):
    p = px(spark, d)
    return grid.nearest(p, p.agg(F.max("r")).first()[0] + 1, 64, 63, 23)
