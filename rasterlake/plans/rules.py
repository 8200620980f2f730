"""Queries of reading rules, levels, colour spaces and names, each with its DuckDB counterpart.

Rows of the driver's tables stand for images: their numbers are sizes, codes and levels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import colour
from rasterlake.operators import demosaic, grid, levels, lookup, rules

from .queries import ORACLE, PX, px, query, read, rounded, three, RGB3

_KEY = "l_orderkey, l_linenumber"
_HINT = lambda h: "CASE WHEN l_returnflag = 'A' THEN ['interlaced', 'swapped_wb', 'activearea_bug', 'little_endian'] WHEN l_returnflag = 'R' THEN ['msb32', 'easyshare_offset_hack'] END"


def lines(spark, d):
    """lineitem with hints by return flag; the third flag has none."""
    hints = F.when(F.col("l_returnflag") == "A", F.array(*map(F.lit, ("interlaced", "swapped_wb", "activearea_bug", "little_endian")))).when(F.col("l_returnflag") == "R", F.array(F.lit("msb32"), F.lit("easyshare_offset_hack")))
    return read(spark, d, "lineitem").withColumns({"hints": hints, "q": F.col("l_quantity").cast("long"), "price": F.floor("l_extendedprice").cast("long")})


_L = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem)"


@query(f"WITH {_L} SELECT {_KEY}, CASE WHEN q % 3 = 0 THEN '16le' WHEN l_linestatus = 'O' THEN '12be' ELSE '12be_unpacked' END AS layout FROM l")
def minolta_layouts(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", rules.minolta_layout(F.when(F.col("q") % 3 == 0, 16).otherwise(12), F.col("l_linestatus") == "O").alias("layout"))


@query(f"WITH {_L} SELECT {_KEY}, CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE q END AS red, CASE WHEN l_returnflag = 'A' THEN q ELSE price END AS green, CASE WHEN l_returnflag = 'A' THEN q ELSE l_suppkey END AS green2, CASE WHEN l_returnflag = 'A' THEN price ELSE l_partkey END AS blue FROM l")
def swapped_balances(spark, d):
    wb = rules.swapped_balance(F.col("hints"), F.array("q", "price", "l_suppkey", "l_partkey"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", *(wb[i].alias(n) for i, n in enumerate(("red", "green", "green2", "blue"))))


@query(
    f"WITH {_L}, k AS (SELECT *, q * 50 AS w, l_linenumber * 6 AS h FROM l) SELECT {_KEY}, CASE WHEN price >= w * h * 2 THEN CASE WHEN l_linestatus = 'O' THEN '12le_left_aligned' ELSE '12be_left_aligned' END WHEN price >= w * h // 10 * 16 THEN '12le_control' "
    "WHEN price >= w * h * 12 // 8 THEN CASE WHEN l_returnflag = 'A' THEN '12be_interlaced' ELSE '12be_msb32' END ELSE 'compressed' END AS layout, (((h + 1) // 2 * w * 3 // 2) // 2048 + 1) * 2048 - (h + 1) // 2 * w * 3 // 2 AS gap, CASE WHEN q % 2 = 0 THEN price * 4 ELSE price END AS white, CASE WHEN w >= 1500 THEN 'highres' ELSE '' END AS mode FROM k"
)
def olympus_layouts(spark, d):
    w, h = F.col("q") * 50, F.col("l_linenumber").cast("long") * 6
    return lines(spark, d).select("l_orderkey", "l_linenumber", rules.olympus_layout(F.col("price"), w, h, F.col("l_linestatus") == "O", F.col("hints")).alias("layout"), rules.olympus_gap(w, h).alias("gap"), rules.olympus_white(F.col("price"), F.when(F.col("q") % 2 == 0, 14).otherwise(12)).alias("white"), rules.camera_mode(w, F.lit(1500)).alias("mode"))


@query(
    f"WITH {_L}, k AS (SELECT *, 32768 + q % 7 AS comp, CASE l_suppkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 14 ELSE 10 END AS b FROM l) SELECT {_KEY}, CASE comp WHEN 32769 THEN CASE b WHEN 12 THEN '12le_unpacked' WHEN 14 THEN '14le_unpacked' END WHEN 32770 THEN CASE WHEN l_linenumber > 3 THEN 'srw1' WHEN b = 12 THEN CASE WHEN l_returnflag = 'A' THEN '12le' ELSE '12be' END WHEN b = 14 THEN '14le_unpacked' END WHEN 32772 THEN 'srw2' WHEN 32773 THEN 'srw3' END AS samsung, "
    "CASE WHEN comp = 32773 THEN '12be' WHEN comp = 32768 THEN '16be' WHEN comp = 32769 THEN 'compressed' END AS pentax, CASE WHEN q % 4 = 0 THEN CASE WHEN l_linestatus = 'O' THEN '16le' ELSE '16be' END WHEN q % 4 < 3 THEN 'compressed' END AS leaf, CASE WHEN l_linenumber > 5 THEN 'compressed' WHEN price >= q * 1200 * 2 THEN '12le_left_aligned' WHEN price >= q * 1200 * 3 // 2 THEN '12le_control' ELSE 'compressed' END AS panasonic FROM k"
)
def layouts_by_compression(spark, d):
    comp, b = F.lit(32768) + F.col("q") % 7, F.when(F.col("l_suppkey") % 3 == 0, 12).when(F.col("l_suppkey") % 3 == 1, 14).otherwise(10)
    areas, offsets = F.when(F.col("l_linenumber") > 3, 1), F.when(F.col("l_linenumber") > 5, 1)
    pentax = F.when(comp == 32768, 1).when(comp == 32769, 65535).otherwise(comp)
    leaf = F.when(F.col("q") % 4 == 0, 1).when(F.col("q") % 4 == 1, 7).when(F.col("q") % 4 == 2, 99).otherwise(5)
    return lines(spark, d).select("l_orderkey", "l_linenumber", rules.samsung_layout(comp, b, areas, F.col("hints")).alias("samsung"), rules.pentax_layout(pentax).alias("pentax"), rules.leaf_layout(leaf, F.col("l_linestatus") == "O").alias("leaf"), rules.panasonic_layout(offsets, F.col("price"), F.col("q") * 30, F.lit(40)).alias("panasonic"))


@query(f"WITH {_L} SELECT {_KEY}, CASE WHEN q % 2 = 0 THEN price // 4 ELSE price END * CASE WHEN l_linenumber = 3 THEN 2 ELSE 1 END AS black, CASE WHEN q % 2 = 0 THEN price // 4 ELSE price END AS white FROM l")
def sony_levels(spark, d):
    bits, ch = F.when(F.col("q") % 2 == 0, 12).otherwise(14), F.when(F.col("l_linenumber") == 3, 3).otherwise(1)
    return lines(spark, d).select("l_orderkey", "l_linenumber", rules.sony_levels(F.col("price"), bits, ch, True).alias("black"), rules.sony_levels(F.col("price"), bits, ch, False).alias("white"))


@query(f"WITH {_L} SELECT {_KEY}, CASE WHEN l_linenumber > 5 OR q % 5 = 0 THEN 1.0 ELSE q * 0.5 END::DOUBLE AS red, CASE WHEN q % 3 = 0 THEN price ELSE CAST(power(2, 10 + l_linenumber) AS BIGINT) - 1 END AS white, CASE WHEN q % 3 = 0 THEN price WHEN l_linenumber IN (2, 4, 6) THEN CAST(power(2, 10 + l_linenumber) AS BIGINT) - 1 END AS raf_white FROM l")
def canon_defaults(spark, d):
    wb = rules.canon_balance(F.when(F.col("l_linenumber") <= 5, F.array(F.col("q") * 0.5, F.lit(1.0), F.lit(2.0))), F.when(F.col("q") % 5 == 0, 130).when(F.col("q") % 5 == 1, 131))
    white, bits = F.when(F.col("q") % 3 == 0, F.col("price")), F.lit(10) + F.col("l_linenumber")
    return lines(spark, d).select("l_orderkey", "l_linenumber", wb[0].cast("double").alias("red"), rules.white_of_bits(white, bits, 16).alias("white"), rules.white_of_bits(white, bits, only=(12, 14, 16)).alias("raf_white"))


@query(
    f"WITH {_L}, k AS (SELECT *, 20 + q AS cl, 10 AS ct, 20 + q + 100 AS cr, 90 AS cb, q % 9 AS al, 4 AS at_, 110 + q AS ar, 120 AS ab FROM l), s AS (SELECT *, least(150, ar - 1) - al AS aw, least(100, ab - 1) - at_ AS ah, cr + 1 - cl AS cw, cb + 1 - ct AS ch FROM k), o AS (SELECT *, cl - al + cw > aw AS over FROM s) "
    f"SELECT {_KEY}, cl AS crop_x, cw AS crop_w, CASE WHEN NOT over THEN al WHEN l_returnflag = 'A' THEN cl END AS active_x, CASE WHEN NOT over THEN aw WHEN l_returnflag = 'A' THEN cw END AS active_w, CASE WHEN NOT over THEN ah WHEN l_returnflag = 'A' THEN ch END AS active_h FROM o"
)
def canon_areas(spark, d):
    q, n = F.col("q"), lambda x: F.lit(x).cast("long")
    crop = F.struct((q + 20).alias("left"), n(10).alias("top"), (q + 120).alias("right"), n(90).alias("bottom"))
    active = F.struct((q % 9).alias("left"), n(4).alias("top"), (q + 110).alias("right"), n(120).alias("bottom"))
    c, a = rules.canon_areas(crop, active, n(150), n(100), F.col("hints"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", c["x"].alias("crop_x"), c["w"].alias("crop_w"), a["x"].alias("active_x"), a["w"].alias("active_w"), a["h"].alias("active_h"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 <> 3 THEN 2.0 / p_size END AS red, CASE WHEN p_size % 4 <> 3 THEN 0.5::DOUBLE END AS blue, CASE WHEN p_size % 3 = 0 THEN p_name END AS artist FROM part")
def leaf_text(spark, d):
    """Text blocks that hold four numbers, or three, and an XMP tag, or none."""
    nums = F.concat_ws("\n", F.lit("2"), F.col("p_size"), F.lit("1"), F.when(F.col("p_size") % 4 != 3, F.lit("4")))
    text = F.concat(F.lit("head\0NeutObj_neutrals" + "." * 28), nums, F.lit("\n\0tail NeutObj_neutrals"))
    xmp = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<x><tiff:Artist>"), F.col("p_name"), F.lit("</tiff:Artist></x>"))).otherwise(F.lit("<x></x>"))
    wb = rules.leaf_balance(text)
    return read(spark, d, "part").select("p_partkey", wb[0].alias("red"), wb[2].alias("blue"), rules.xmp_tag(xmp, "Artist").alias("artist"))


@query(f"WITH {_L} SELECT {_KEY}, q + 80 AS width, l_suppkey + 70 AS height, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber > 1 AND price * 10 < 86016 THEN 86016 ELSE 94208 END WHEN l_linenumber > 1 THEN price * 10 END AS at FROM l")
def kodak_geometry(spark, d):
    zero = F.lit(0).cast("long")
    offsets = F.when(F.col("l_linenumber") > 1, F.array(*[F.col("price") * 4 if i == 4 else F.col("price") * 6 if i == 12 else zero for i in range(13)])).otherwise(F.array(zero))
    w, h, at = rules.kodak_geometry(F.col("q"), F.col("l_suppkey"), offsets, F.col("hints"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", w.alias("width"), h.alias("height"), at.cast("long").alias("at"))


@query(f"WITH {_L}, k AS (SELECT *, nullif(least(q, l_suppkey, price, l_partkey), 0) AS m FROM l) SELECT {_KEY}, round((q + 0.25) / m, 9) AS first, round((price + 0.75) / m, 9) AS third, round(price * 508.0 * 1.078 / 65536.0, 9)::DOUBLE AS epson_red, round(q * 382.0 * 1.173 / 65536.0, 9)::DOUBLE AS epson_blue FROM k")
def balances_by_constants(spark, d):
    four = rules.four_colour_balance(F.array(F.col("q") + 0.25, F.col("l_suppkey") + 0.5, F.col("price") + 0.75, F.col("l_partkey").cast("double")))
    e = rules.epson_balance(F.col("price"), F.col("q"))
    return rounded(lines(spark, d).select("l_orderkey", "l_linenumber", four[0].alias("first"), four[2].alias("third"), e[0].alias("epson_red"), e[2].alias("epson_blue")), 9, "first", "third", "epson_red", "epson_blue")


@query(
    f"WITH {_L} SELECT {_KEY}, CASE WHEN q % 6 = 5 THEN NULL WHEN l_linenumber = 7 THEN '12be_control' WHEN l_returnflag = 'R' THEN '12be_msb32' WHEN q % 2 = 1 THEN 'compressed' WHEN l_suppkey % 3 = 0 THEN CASE WHEN l_linestatus = 'O' THEN '16le' ELSE '16be' END "
    "WHEN l_suppkey % 3 = 1 THEN CASE WHEN l_linestatus = 'O' OR l_returnflag = 'A' THEN '14le' ELSE '14be' END ELSE CASE WHEN l_linestatus = 'O' OR l_returnflag = 'A' THEN '12le' ELSE '12be' END END AS layout FROM l"
)
def nikon_layouts(spark, d):
    bits = F.when(F.col("l_suppkey") % 3 == 0, 16).when(F.col("l_suppkey") % 3 == 1, 14).otherwise(12)
    model = F.when(F.col("l_linenumber") == 7, "NIKON D100").otherwise("other")
    return lines(spark, d).select("l_orderkey", "l_linenumber", rules.nikon_layout(F.when(F.col("q") % 6 == 5, 13), model, F.col("q") % 2 == 0, bits, F.col("l_linestatus") == "O", F.col("hints")).alias("layout"))


@query(
    f"WITH {_L} SELECT {_KEY}, CASE WHEN q % 3 = 0 THEN 1.0 / (q + 1) WHEN q % 3 = 1 THEN 2.5 END::DOUBLE AS red, list_sum(CASE WHEN l_linenumber = 1 THEN [255, 255, 255] WHEN l_linenumber = 2 THEN [q, q, q] ELSE [q, price, 7] END)::BIGINT AS white, CASE WHEN l_linenumber < 4 THEN price ELSE [q, price, 3, 4][l_linenumber - 3] END AS black FROM l"
)
def dng_levels(spark, d):
    q, p, n = F.col("q"), F.col("price"), F.col("l_linenumber")
    lit = lambda x: F.lit(x).cast("long")
    wb = rules.dng_balance(F.when(q % 3 == 0, F.array((q + 1).cast("double"))), F.when(q % 3 == 1, F.array(F.lit(2.5))))
    white = rules.dng_white(F.when(n == 2, F.array(q)).when(n > 2, F.array(q, p, lit(7))), F.lit(3), F.lit(8))
    black = rules.dng_black(F.when(n < 4, F.array(p)).otherwise(F.array(q, p, lit(3), lit(4))), F.lit(2), F.lit(2), F.lit(1), n - 4, F.lit(0))
    return lines(spark, d).select("l_orderkey", "l_linenumber", wb[0].alias("red"), F.aggregate(white, lit(0), lambda a, b: a + b).alias("white"), black.alias("black"))


@query(f"WITH {PX} SELECT r * 2 + c // 32 AS r, c % 32 AS c, v FROM px")
def double_lines(spark, d):
    return rules.double_line(px(spark, d), 64)


@query(
    "WITH t AS (SELECT event_id // 8 AS file, [51043, 51044, 51058, 37500, 50741, 271, 272, 306][event_id % 8 + 1] AS tag, CASE WHEN event_id % 8 = 4 THEN event_id // 8 % 2 ELSE event_id END AS value FROM events) "
    "SELECT file, tag, value, tag IN (51043, 51044, 51058) AS kept FROM t WHERE NOT (tag = 37500 AND file IN (SELECT file FROM t WHERE tag = 50741 GROUP BY file HAVING max(value) = 0))"
)
def tags_copied(spark, d):
    tag = F.element_at(F.array(*(F.lit(x).cast("int") for x in (51043, 51044, 51058, 37500, 50741, 271, 272, 306))), (F.col("event_id") % 8 + 1).cast("int"))
    t = read(spark, d, "events").select(F.expr("event_id div 8").alias("file"), tag.alias("tag"), F.expr("CASE WHEN event_id % 8 = 4 THEN event_id div 8 % 2 ELSE event_id END").alias("value"))
    safe = rules.safe_maker_notes(t, "file", "tag", "value")
    return rules.kept_tags(safe, "tag").withColumn("kept", F.lit(True)).unionAll(safe.filter(~F.col("tag").isin(*rules.KEPT_TAGS)).withColumn("kept", F.lit(False)))


@query("SELECT CAST(i AS INTEGER) AS code, CASE i " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rules.ILLUMINANTS.items()) + " END AS name, CAST(CASE WHEN i IN (" + ", ".join(map(str, rules.ILLUMINANTS)) + ") THEN i END AS INTEGER) AS again FROM range(0, 30) t(i)")
def illuminants(spark, d):
    name = rules.illuminant_name(F.col("id"))
    return spark.range(30).select(F.col("id").cast("int").alias("code"), name.alias("name"), rules.illuminant_code(name).alias("again"))


@query("SELECT i AS o, CASE WHEN i BETWEEN 1 AND 8 THEN i ELSE 1 END AS again FROM range(0, 10) t(i)")
def orientation_codes(spark, d):
    """Codes to flips and back: unknown ones become 1."""
    return spark.range(10).select(F.col("id").alias("o"), rules.orientation(*grid.flips(F.col("id"))).cast("long").alias("again"))


_PATTERNS = [("RGGB", 2), ("RGBE", 2), ("GGGG", 2), ("GGRGGBGGBGGRBRGRBGGGBGGRGGRGGBRBGBRG", 6), ("RGB", 1), ("GRBG", 2)]


@query("SELECT pattern, side, colours, kind FROM (VALUES ('RGGB', 2, 3, 'bayer'), ('RGBE', 2, 4, 'bayer'), ('GGGG', 2, 1, NULL), ('GGRGGBGGBGGRBRGRBGGGBGGRGGRGGBRBGBRG', 6, 3, 'xtrans'), ('RGB', 1, 3, NULL), ('GRBG', 2, 3, 'bayer')) t(pattern, side, colours, kind)")
def sensor_types(spark, d):
    t = spark.createDataFrame(_PATTERNS, "pattern string, side int")
    return t.select("pattern", "side", rules.unique_colours(F.col("pattern")).alias("colours"), rules.sensor_type(F.col("pattern"), F.col("side")).alias("kind"))


@query(f"WITH {_L} SELECT {_KEY}, l_returnflag = 'A' AS interlaced, CASE WHEN l_linenumber < 4 THEN q END AS width, CASE WHEN l_linenumber < 6 THEN CAST(price AS VARCHAR) END AS price FROM l")
def hints_and_params(spark, d):
    params = F.create_map(F.lit("width"), F.when(F.col("l_linenumber") < 4, F.col("q").cast("string")).otherwise(F.lit("none")), F.lit("price"), F.when(F.col("l_linenumber") < 6, F.col("price").cast("string")))
    return lines(spark, d).select("l_orderkey", "l_linenumber", rules.has_hint(F.col("hints"), "interlaced").alias("interlaced"), rules.param(params, "width", "long").alias("width"), rules.param(params, "price").alias("price"))


@query("SELECT c_mktsegment AS usage, min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY 1")
def first_inputs(spark, d):
    """Of the inputs of each usage the first counts."""
    return rules.first_of(read(spark, d, "customer").select(F.col("c_mktsegment").alias("usage"), "c_custkey", "c_name", F.col("c_custkey").alias("at")), "usage", "at").drop("at")


@query(
    "WITH n AS (SELECT s_suppkey AS lens_id, s_name AS key_name, s_nationkey % 5 AS mount, s_nationkey AS make, s_acctbal AS lo, s_acctbal + 2000 AS hi, s_suppkey % 7 AS ap FROM supplier), i AS (SELECT c_custkey AS image_id, CASE WHEN c_custkey % 3 = 0 THEN (SELECT min(s_name) FROM supplier) WHEN c_custkey % 11 = 0 THEN '' END AS key_name, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 130 END AS code, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey % 5 END AS mount, c_nationkey AS make, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS focal, 4 AS ap FROM customer), "
    "f AS (SELECT i.*, coalesce((SELECT min(lens_id) FROM n WHERE n.key_name = i.key_name AND i.key_name <> ''), (SELECT min(lens_id) FROM n WHERE n.lens_id = i.code)) AS first FROM i), k AS (SELECT f.image_id, count(n.lens_id) AS m, min(n.lens_id) AS one FROM f LEFT JOIN n ON (f.mount IS NULL OR f.mount = n.mount) AND f.make = n.make AND (f.focal IS NULL OR f.focal BETWEEN n.lo AND n.hi) AND f.ap >= n.ap WHERE f.first IS NULL GROUP BY 1) "
    "SELECT f.image_id, coalesce(f.first, CASE WHEN k.m = 1 THEN k.one END) AS lens_id FROM f LEFT JOIN k USING (image_id)"
)
def lens_resolved(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    lenses = s.select(F.col("s_suppkey").alias("lens_id"), F.col("s_name").alias("key_name"), F.col("s_suppkey").alias("code_a"), F.lit(None).cast("long").alias("code_b"), (F.col("s_nationkey") % 5).alias("mount"), F.col("s_nationkey").alias("make"), F.col("s_acctbal").alias("focal_min"), (F.col("s_acctbal") + 2000).alias("focal_max"), (F.col("s_suppkey") % 7).alias("aperture_min"))
    least = s.agg(F.min("s_name").alias("least"))
    k = F.col("c_custkey")
    images = c.join(F.broadcast(least)).select(k.alias("image_id"), F.when(k % 3 == 0, F.col("least")).when(k % 11 == 0, F.lit("")).alias("key_name"), F.when(k % 5 == 0, k % 130).alias("code_a"), F.lit(None).cast("long").alias("code_b"), F.when(k % 2 == 0, F.col("c_nationkey") % 5).alias("mount"), F.col("c_nationkey").alias("make"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("focal"), F.lit(4).alias("aperture"))
    return rules.lens(images, lenses)


@query(
    "WITH b AS (SELECT p_partkey, p_brand AS make, p_name AS model, p_name AS clean_model, p_size AS white, p_retailprice AS black FROM part), a AS (SELECT *, 0 AS i FROM b UNION ALL SELECT p_partkey, make, model || '-A', clean_model || ' A', white, black, 1 FROM b WHERE white % 2 = 0), m AS (SELECT *, 0 AS j, '' AS mode FROM a UNION ALL SELECT p_partkey, make, model, clean_model, 7, black, i, 1, 'dng' FROM a WHERE white % 3 = 0) "
    "SELECT make, model, mode, arg_max(clean_model, p_partkey * 4 + i * 2 + j) AS clean_model, arg_max(white, p_partkey * 4 + i * 2 + j) AS white, arg_max(black, p_partkey * 4 + i * 2 + j) AS black FROM m GROUP BY 1, 2, 3"
)
def cameras_overlaid(spark, d):
    p = read(spark, d, "part")
    modes = F.when(F.col("p_size") % 3 == 0, F.array(F.struct(F.lit("dng").alias("mode"), F.lit(7).alias("white"), F.lit(None).cast("double").alias("black"))))
    names = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.concat("p_name", F.lit("-A")).alias("model"), F.concat("p_name", F.lit(" A")).alias("clean_model"))))
    t = p.select(F.col("p_partkey").alias("at"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.col("p_name").alias("clean_model"), F.col("p_size").alias("white"), F.col("p_retailprice").alias("black"), modes.alias("modes"), names.alias("aliases"))
    return rules.cameras(t, ["white", "black"])


@query(f"WITH {RGB3}, k AS (SELECT vec_id, [x, y, z] AS p FROM e) SELECT vec_id, round(greatest(p[1] - 0.01, 0.0) / 0.98, 9) AS red, round(greatest(p[2] + 0.5, 0.0) / 2.5, 9) AS green, round(greatest(p[3] - 0.02, 0.0) / 0.88, 9) AS blue, round(p[1], 9) AS unchanged FROM k")
def rescale_by_component(spark, d):
    p = F.array(*(F.col(n) for n in "xyz"))
    e = three(spark, d)
    out = levels.rescale_components(p, [0.01, -0.5, 0.02], [0.99, 2.0, 0.9])
    same = levels.rescale_components(p, [0.01, -0.5], [0.99, 2.0, 0.9])
    return rounded(e.select("vec_id", *(out[i].alias(n) for i, n in enumerate(("red", "green", "blue"))), same[0].alias("unchanged")), 9, "red", "green", "blue", "unchanged")


@query(f"WITH {PX}, m AS (SELECT * FROM px WHERE (c < 4) OR (c BETWEEN 60 AND 63 AND r < 20)), b AS (SELECT (r % 2) * 2 + c % 2 AS p, avg(v) AS l FROM m GROUP BY 1) SELECT r, c, round(greatest(v - l, 0.0) / (1.0 - l), 9) AS v, 0.0::DOUBLE AS black, 1.0::DOUBLE AS white FROM px JOIN b ON b.p = (r % 2) * 2 + c % 2")
def masked_black_applied(spark, d):
    """Black levels are those of the masked areas; the scaled image has the levels 0 and 1."""
    x = px(spark, d)
    return rounded(levels.scaled(x, levels.masked_black(x, [(0, 0, 4, 1 << 40), (60, 0, 4, 20)]), 1.0), 9, "v")


@query(f"WITH {RGB3} SELECT vec_id, round(x, 7) AS x, round(y, 7) AS y, round(z, 7) AS z FROM e")
def lab_and_back(spark, d):
    """L*a*b* of samples as X, Y, Z, and back: the samples."""
    white = (0.95047, 1.0, 1.08883)
    e = three(spark, d)
    out = colour.lab_inverse(*colour.lab(*(F.col(n) for n in "xyz"), white), white)
    return e.select("vec_id", *(F.round(c, 7).alias(n) for c, n in zip(out, "xyz", strict=True)))


_F = lambda t: f"CASE WHEN {t} > power(6 / 29.0::DOUBLE, 3) THEN cbrt({t}) ELSE {t} * 841 / 108.0::DOUBLE + 4 / 29.0::DOUBLE END"


@query(
    f"WITH {RGB3}, t AS (SELECT vec_id, (0.4124564 * abs(x) + 0.3575761 * abs(y) + 0.1804375 * abs(z)) / 0.95047::DOUBLE AS tx, 0.2126729 * abs(x) + 0.7151522 * abs(y) + 0.0721750 * abs(z) AS ty, (0.0193339 * abs(x) + 0.1191920 * abs(y) + 0.9503041 * abs(z)) / 1.08883::DOUBLE AS tz FROM e), f AS (SELECT vec_id, {_F('tx')} AS fx, {_F('ty')} AS fy, {_F('tz')} AS fz FROM t) "
    "SELECT vec_id, round(116 * fy - 16, 6) AS l, round(500 * (fx - fy), 6) AS a, round(200 * (fy - fz), 6) AS b FROM f"
)
def rgb_lab(spark, d):
    out = colour.rgb_to_lab(*(F.abs(n) for n in "xyz"))
    return three(spark, d).select("vec_id", *(F.round(c, 6).alias(n) for c, n in zip(out, "lab", strict=True)))


@query(ORACLE["bilinear_rgb"].replace(PX, PX.replace("px AS (", "px AS (SELECT * FROM (") + " WHERE r BETWEEN 11 AND 90 AND c BETWEEN 5 AND 44)").replace("SELECT r, c,", "SELECT r - 11 AS r, c - 5 AS c,"))
def bilinear_of_region(spark, d):
    """A region is cut before the colours are reconstructed; its phase is that of the whole image."""
    return rounded(demosaic.region(px(spark, d), 5, 11, 40, 80), 9, "red", "green", "blue")


@query("SELECT '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS doc FROM nation")
def metadata_json(spark, d):
    return read(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("doc"))


@query("WITH w AS (SELECT CAST(max(length(p_brand)) AS INTEGER) AS w FROM part) SELECT p_brand AS make, '|' || rpad(p_brand, w, ' ') || ' | ' || string_agg(DISTINCT p_type, ', ' ORDER BY p_type) || ' |' AS line FROM part, w GROUP BY p_brand, w ORDER BY p_brand")
def catalogue_markdown(spark, d):
    return lookup.markdown(lookup.catalogue(read(spark, d, "part"), "p_brand", "p_type"), "p_brand", "models").select(F.col("p_brand").alias("make"), "line")


@query("SELECT DISTINCT o_orderpriority || '_' || o_orderstatus AS output FROM orders WHERE o_orderpriority || '_' || o_orderstatus NOT IN (SELECT o_orderpriority || '_F' FROM orders)")
def outputs_not_claimed(spark, d):
    o = read(spark, d, "orders")
    name = F.concat_ws("_", "o_orderpriority", "o_orderstatus")
    return lookup.unclaimed(o.select(name.alias("output")), o.select(F.concat(F.col("o_orderpriority"), F.lit("_F")).alias("output")), "output")


@query("SELECT p_partkey, round(least(greatest(p_size - 10, 0), 20)::DOUBLE, 3) AS both, round(least(p_size, 20)::DOUBLE, 3) AS top, CAST(ceil(log2(p_size)) AS INTEGER) AS bits FROM part")
def clips(spark, d):
    v = F.col("p_size").cast("double")
    return read(spark, d, "part").select("p_partkey", F.round(levels.clip(v - 10, 0.0, 20.0), 3).alias("both"), F.round(levels.clip(v, None, 20.0), 3).alias("top"), F.ceil(F.log2(v)).cast("int").alias("bits"))


@query("SELECT o_orderkey AS at, o_orderstatus AS stem, CAST(0 AS BIGINT) AS frame, CASE WHEN k = 1 THEN o_orderstatus ELSE o_orderstatus || '_' || (k - 1) END AS output FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders)")
def output_names(spark, d):
    return rules.free_names(read(spark, d, "orders").select(F.col("o_orderstatus").alias("stem"), F.col("o_orderkey").alias("at")), "stem", "at")
