"""Rules that decide how a camera file is read: layouts, levels, balances, areas, tags and names, as expressions over metadata rows.

A rule that has no answer gives null, where a reader would stop with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lookup

#: Light source codes and names.
ILLUMINANTS = {
    0: "Unknown", 1: "Daylight", 2: "Fluorescent", 3: "Tungsten", 4: "Flash", 9: "FineWeather", 10: "CloudyWeather", 11: "Shade", 12: "DaylightFluorescent",
    13: "DaylightWhiteFluorescent", 14: "CoolWhiteFluorescent", 15: "WhiteFluorescent", 17: "A", 18: "B", 19: "C", 20: "D55", 21: "D65", 22: "D75", 23: "D50", 24: "IsoStudioTungsten",
}
#: Tags of time codes, frame rate and T-stop, which a copy keeps; of maker notes, and of their safety.
KEPT_TAGS, MAKER_NOTE, MAKER_NOTE_SAFETY = (51043, 51044, 51058), 37500, 50741


def illuminant_name(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ILLUMINANTS.items() for x in kv)), code.cast("int"))


def illuminant_code(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in ILLUMINANTS.items() for x in (v, k))), name)


def orientation(transpose: Column, horizontal: Column, vertical: Column) -> Column:
    """Code 1 to 8 of flips that come before a transposition."""
    straight = F.when(horizontal & vertical, 3).when(horizontal, 2).when(vertical, 4).otherwise(1)
    turned = F.when(horizontal & vertical, 7).when(horizontal, 8).when(vertical, 6).otherwise(5)
    return F.when(transpose, turned).otherwise(straight)


def unique_colours(pattern: Column) -> Column:
    """Number of different letters of a colour pattern."""
    return F.size(F.array_distinct(F.split(pattern, "")))


def sensor_type(pattern: Column, side: Column) -> Column:
    """bayer for 2 x 2 patterns of three colours or more, xtrans for 6 x 6 ones, else null."""
    return F.when((side == 2) & (unique_colours(pattern) >= 3), "bayer").when(side == 6, "xtrans")


def has_hint(hints: Column, hint: str) -> Column:
    return F.coalesce(F.array_contains(hints, hint), F.lit(False))


def param(params: Column, name: str, kind: str = "string") -> Column:
    """A parameter as the kind asked for; null if it is missing or not of that kind."""
    return F.element_at(params, name).try_cast(kind)


def minolta_layout(bits: Column, packed: Column) -> Column:
    return F.when(bits == 16, "16le").when(packed, "12be").otherwise("12be_unpacked")


def swapped_balance(hints: Column, wb: Column) -> Column:
    """Balance values in the order red, green, green, blue; cameras with the hint store them as green, blue, red."""
    return F.when(has_hint(hints, "swapped_wb"), F.array(wb[2], wb[0], wb[0], wb[1])).otherwise(wb)


def olympus_layout(size: Column, width: Column, height: Column, little: Column, hints: Column) -> Column:
    """By the bytes that there are, the widest layout that they fill."""
    area = width * height
    twelve = F.when(has_hint(hints, "interlaced"), "12be_interlaced").otherwise("12be_msb32")
    left = F.when(little, "12le_left_aligned").otherwise("12be_left_aligned")
    return F.when(size >= area * 2, left).when(size >= F.floor(area / 10) * 16, "12le_control").when(size >= F.floor(area * 12 / 8), twelve).otherwise("compressed")


def olympus_gap(width: Column, height: Column) -> Column:
    """Bytes between the two fields of an interlaced image: the second starts at the next multiple of 2048."""
    first = F.floor(F.shiftright(height + 1, 1) * width * 3 / 2).cast("long")
    return (F.shiftright(first, 11) + 1) * 2048 - first


def olympus_white(white: Column, bits: Column) -> Column:
    return F.when(bits == 14, white * 4).otherwise(white)


def camera_mode(width: Column, highres_width: Column) -> Column:
    return F.when(width >= highres_width, "highres").otherwise("")


def samsung_layout(compression: Column, bits: Column, areas: Column, hints: Column) -> Column:
    unpacked = F.when(bits == 12, "12le_unpacked").when(bits == 14, "14le_unpacked")
    packed = F.when(bits == 12, F.when(has_hint(hints, "little_endian"), "12le").otherwise("12be")).when(bits == 14, "14le_unpacked")
    return F.when(compression == 32769, unpacked).when(compression == 32770, F.when(areas.isNull(), packed).otherwise("srw1")).when(compression == 32772, "srw2").when(compression == 32773, "srw3")


def pentax_layout(compression: Column) -> Column:
    return F.when(compression == 1, "16be").when(compression == 32773, "12be").when(compression == 65535, "compressed")


def leaf_layout(compression: Column, little: Column) -> Column:
    return F.when(compression == 1, F.when(little, "16le").otherwise("16be")).when(compression.isin(7, 99), "compressed")


def panasonic_layout(offsets: Column, available: Column, width: Column, height: Column) -> Column:
    """Files with the maker's own offsets are compressed; of others the bytes up to the file's end decide."""
    area = width * height
    return F.when(offsets.isNotNull(), "compressed").when(available >= area * 2, "12le_left_aligned").when(available >= F.floor(area * 3 / 2), "12le_control").otherwise("compressed")


def sony_levels(level: Column, bits: Column, channels: Column, black: bool) -> Column:
    """Levels of 14 bits as an image needs them: a quarter for 12 bits; black twice as high for luma and chroma."""
    v = F.when(bits == 12, F.shiftright(level, 2)).otherwise(level)
    return F.when(channels == 3, v * 2).otherwise(v) if black else v


def canon_balance(wb: Column, kind: Column) -> Column:
    """Three coefficients; all 1 if the file has none, or for kind 130, whose samples are balanced already."""
    return F.when(F.coalesce(kind == 130, F.lit(False)) | wb.isNull(), F.array(*[F.lit(1.0)] * 3)).otherwise(wb)


def white_of_bits(white: Column, bits: Column, default_bits: int | None = None, only: tuple[int, ...] = ()) -> Column:
    """A white level, else the largest sample of so many bits; only: of these numbers of bits."""
    b = bits if default_bits is None else F.coalesce(bits, F.lit(default_bits))
    top = (F.pow(F.lit(2.0), b) - 1).cast("long")
    return F.coalesce(white.cast("long"), F.when(b.isin(*only), top) if only else top)


def canon_areas(crop: Column, active: Column, width: Column, height: Column, hints: Column) -> tuple[Column, Column]:
    """Crop and active area (x, y, w, h) from inclusive borders (left, top, right, bottom) of the first and exclusive ones, one too large, of the second.

    The active area ends at the frame; where it cannot hold the crop it is the crop for cameras with the hint, else null.
    """
    rect = lambda a, r, b: F.struct(a["left"].alias("x"), a["top"].alias("y"), (r - a["left"]).alias("w"), (b - a["top"]).alias("h"))
    c = rect(crop, crop["right"] + 1, crop["bottom"] + 1)
    a = rect(active, F.least(width, active["right"] - 1), F.least(height, active["bottom"] - 1))
    over = c["x"] - a["x"] + c["w"] > a["w"]
    return c, F.when(~over, a).when(has_hint(hints, "activearea_bug"), c)


def leaf_balance(text: Column) -> Column:
    """Three coefficients from the text block NeutObj_neutrals: four numbers, one a line, up to a zero byte; else null."""
    lines = F.split(F.regexp_replace(F.regexp_extract(text, r"NeutObj_neutrals[\s\S]{28}([^\x00]*)\x00", 1), r"\n$", ""), "\n")
    n = F.transform(lines, lambda x: x.try_cast("double"))
    return F.when(F.size(n) == 4, F.array(*(n[0] / n[i] for i in (1, 2, 3))))


def xmp_tag(text: Column, tag: str) -> Column:
    found = F.regexp_extract(text, f"<tiff:{tag}>([\\s\\S]*?)</tiff:{tag}>", 1)
    return F.when(F.contains(text, F.lit(f"<tiff:{tag}>")) & F.contains(text, F.lit(f"</tiff:{tag}>")), found)


def kodak_geometry(width: Column, height: Column, offsets: Column, hints: Column) -> list[Column]:
    """Width, height and offset of the samples. Borders of 80 and 70; offsets 0x15000 and 0x17000 under the hint."""
    at = F.when(F.size(offsets) >= 13, offsets[4] + offsets[12])
    return [width + 80, height + 70, F.when(has_hint(hints, "easyshare_offset_hack"), F.when(at < 0x15000, 0x15000).otherwise(0x17000)).otherwise(at)]


def four_colour_balance(wb: Column) -> Column:
    """Four coefficients divided by the least of their whole parts; null if that is 0."""
    return F.transform(wb, lambda x: F.try_divide(x, F.array_min(F.transform(wb, lambda y: y.cast("int")))))


def epson_balance(red: Column, blue: Column) -> Column:
    """508 x 1.078 and 382 x 1.173, over 65536."""
    return F.array(red * 508.0 * 1.078 / 65536.0, F.lit(1.0), blue * 382.0 * 1.173 / 65536.0)


def nikon_layout(compression: Column, model: Column, uncompressed: Column, bits: Column, little: Column, hints: Column) -> Column:
    """High-efficiency compression (13, 14) is not read."""
    le = (little | has_hint(hints, "little_endian")) & ~has_hint(hints, "big_endian")
    end = lambda bits_, by: F.when(by, f"{bits_}le").otherwise(f"{bits_}be")
    plain = F.when(bits == 16, end(16, little)).when(bits == 14, end(14, le)).when(bits == 12, end(12, le))
    by_hint = F.when(model == "NIKON D100", "12be_control").when(has_hint(hints, "coolpixsplit"), "12be_interlaced_unaligned").when(has_hint(hints, "msb32"), "12be_msb32").when(has_hint(hints, "unpacked"), end(16, le))
    return F.when(F.coalesce(compression.isin(13, 14), F.lit(False)), None).otherwise(by_hint.when(uncompressed, plain).otherwise("compressed"))


def dng_balance(neutral: Column, from_xy: Column) -> Column:
    """Reciprocals of the neutral colour, else the balance of a white point, else null."""
    return F.coalesce(F.when(neutral.isNotNull(), F.transform(neutral, lambda x: 1 / x)), from_xy)


def dng_white(white: Column, channels: Column, bits: Column) -> Column:
    """White levels by channel: one value counts for all; without any, the largest sample."""
    top = F.array_repeat((F.pow(F.lit(2.0), bits) - 1).cast("long"), channels)
    return F.when(white.isNull() | (F.size(white) == 0), top).when((F.size(white) == 1) & (channels > 1), F.array_repeat(white[0], channels)).otherwise(white)


def dng_black(levels: Column, rows: Column, cols: Column, channels: Column, phase: Column, channel: Column) -> Column:
    """Black level of a phase (row by row) and channel: of the repeating pattern, or the only one; null without levels."""
    at = phase * channels + channel
    return F.when(F.size(levels) == rows * cols * channels, F.try_element_at(levels, (at + 1).cast("int"))).when(F.size(levels) == 1, levels[0])


def double_line(px: DataFrame, width: int) -> DataFrame:
    """Lines that hold two lines of half the width."""
    half = width // 2
    return px.select((F.col("r") * 2 + F.floor(F.col("c") / half)).cast("long").alias("r"), F.pmod(F.col("c"), F.lit(half)).cast("long").alias("c"), "v")


def kept_tags(tags: DataFrame, tag: str, allowed: tuple[int, ...] = KEPT_TAGS) -> DataFrame:
    return tags.filter(F.col(tag).isin(*allowed))


def safe_maker_notes(tags: DataFrame, file: str, tag: str, value: str) -> DataFrame:
    """Tags without the maker notes of files whose safety tag is 0: one aggregate by file, joined back to those rows only."""
    unsafe = tags.filter(F.col(tag) == MAKER_NOTE_SAFETY).groupBy(file).agg(F.max(value).alias("safe")).filter("safe = 0").select(file)
    notes = F.col(tag) == MAKER_NOTE
    return tags.filter(~notes).unionByName(tags.filter(notes).join(unsafe, file, "left_anti").select(*tags.columns))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


#: Rows of one stem beyond which it is numbered in SLICES parts, cut by order.
SLICE_ROWS, SLICES = 1_000_000, 64
#: Stems that could meet others, up to which they are broadcast.
FEW = 100_000


def _linked(stems: DataFrame) -> DataFrame:
    """stem, root: the stems whose names could meet those of another stem, with the shortest stem that they lead to.

    A name is its stem and one or two numbers at most, so two stems can only meet if one is the other and one or two numbers: each
    stem is followed along its own cuts, over stems that exist.
    """
    tail = F.regexp_extract("stem", r"((_\d+)+)$", 1)
    parts = stems.filter(F.col("stem").rlike(r"_\d+$")).select("stem", F.split(F.substring(tail, 2, 1 << 30), "_").alias("p"), F.length(tail).alias("n"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda j: F.struct(j.alias("j"), F.expr("left(stem, length(stem) - n)").alias("head"), j.alias("k")))).alias("x")
    rest = F.array_join(F.expr("transform(slice(p, 1, size(p) - x.j), y -> '_' || y)"), "")
    cuts = parts.select("stem", "p", cut).select("stem", F.col("x.j").alias("j"), F.concat("x.head", rest).alias("cut"))
    known = cuts.join(stems.select(F.col("stem").alias("cut")), "cut").groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("j", "cut"))).alias("js"))
    start = F.struct(F.lit(0).alias("j"), F.col("stem").alias("cut"))
    below = known.select("stem", F.aggregate("js", start, lambda a, x: F.when(x["j"] - a["j"] <= 2, x).otherwise(a))["cut"].alias("root")).filter("root <> stem")
    return below.unionByName(below.select(F.col("root").alias("stem"), "root")).distinct()


def _numbered(w: DataFrame) -> DataFrame:
    """w with k: the place of each row (from 0) among those of its stem and kind, by order. A stem with many rows is cut into slices, so that no task has them all."""
    key = ["stem", "several"]
    large = w.groupBy(*key).count().filter(F.col("count") > SLICE_ROWS).select(*key).collect()
    if not large:
        return w.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("at", "frames")) - 1)
    named = w.sparkSession.createDataFrame(large, "stem string, several boolean")
    rows = w.join(F.broadcast(named), [w.stem.eqNullSafe(named.stem), w.several == named.several], "left_semi")
    # the cuts are fixed here: they must be the same in the counts and in the rows
    many = rows.groupBy(*key).agg(F.percentile_approx("at", [i / SLICES for i in range(1, SLICES)], 10_000).alias("cuts")).collect()
    cuts = w.sparkSession.createDataFrame(many, "c_stem string, c_several boolean, cuts array<long>")
    sliced = w.join(F.broadcast(cuts), w.stem.eqNullSafe(F.col("c_stem")) & (w.several == F.col("c_several")), "left")
    below = F.size(F.filter("cuts", lambda c: c < F.col("at")))
    sliced = sliced.withColumn("slice", F.when(F.col("cuts").isNull() | F.col("at").isNull(), 0).otherwise(below)).drop("c_stem", "c_several")
    counts = sliced.filter("cuts is not null").groupBy(*key, "slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("stem").alias("c_stem"), F.col("several").alias("c_several"), F.col("slice").alias("c_slice"), before.alias("before"))
    on = sliced.stem.eqNullSafe(F.col("c_stem")) & (sliced.several == F.col("c_several")) & (sliced.slice == F.col("c_slice"))
    place = F.row_number().over(Window.partitionBy(*key, "slice").orderBy("at", "frames")) - 1
    # dealt by slice: a table that lies by stem would meet the window's need as it is, with each stem in one task
    out = sliced.drop("cuts").repartition(*key, "slice").withColumn("place", place).join(F.broadcast(counts), on, "left")
    return out.withColumn("k", F.col("place") + F.coalesce("before", F.lit(0)))


def free_names(wanted: DataFrame, stem: str, order: str, frames: str | None = None) -> DataFrame:
    """The lowest suffix _k that leaves every frame's output name free, claimed in order.

    A stem whose names can meet no other stem's is numbered by its rows' places. Stems that could meet (one is the other and a number or two), and those
    with more than 1000 frames, are claimed name by name, by each such family in one task, in which every search goes on where the last one ended.
    """
    import pyarrow as pa

    w = wanted.select(F.col(stem).alias("stem"), F.col(order).cast("long").alias("at"), (F.col(frames) if frames else F.lit(1)).cast("long").alias("frames"))
    w = w.filter("frames > 0").withColumn("several", F.col("frames") > 1)
    stems = w.groupBy("stem").agg(F.max("frames").alias("most"))
    linked = _linked(stems.select("stem"))
    linked = linked.unionByName(stems.filter("most > 1000").select("stem", F.col("stem").alias("root"))).groupBy("stem").agg(F.min("root").alias("root"))
    schema = "stem string, at long, frame long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, claimed, least, out = None, set(), {}, []
        for batch in batches:
            for root, name, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if root != family:
                    family, claimed, least = root, set(), {}
                # what is claimed stays claimed: no k below the last one is free; for several frames, none whose first name is claimed
                first = least.get((name, 0), 0) if n > 1 else 0
                while n > 1 and (f"{name}_{first}" if first else name) + "_0000" in claimed:
                    first += 1
                k = max(least.get((name, n), 0), first)
                while True:
                    base = f"{name}_{k}" if k else name
                    names = [base] if n == 1 else [f"{base}_{i:04d}" for i in range(n)]
                    if claimed.isdisjoint(names):
                        break
                    k += 1
                claimed.update(names)
                least[name, n] = k + 1
                if n > 1:
                    least[name, 0] = first
                for i, x in enumerate(names):
                    out.append((name, at, i, x))
                    if len(out) == 10_000:
                        yield made(out)
                        out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["stem", "at", "frame", "output"])

    few = linked.limit(FEW + 1).count()
    if few <= FEW:
        linked = F.broadcast(linked)
    met = w.join(linked, "stem").select("root", "stem", "at", "frames").repartition("root").sortWithinPartitions("root", "at", "stem", "frames").mapInArrow(run, schema)
    alone = _numbered(w.join(linked, "stem", "left_anti") if few else w)
    base = F.when(F.col("k") == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("k")))
    alone = alone.withColumn("base", base).select("stem", "at", "several", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("frame"))
    alone = alone.select("stem", "at", "frame", F.when(F.col("several"), F.concat("base", F.lit("_"), F.lpad(F.col("frame").cast("string"), 4, "0"))).otherwise(F.col("base")).alias("output"))
    return (alone.unionByName(met) if few else alone).select(F.col("stem").alias(stem), F.col("at").alias(order), "frame", "output")


def cameras(tables: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (make, model, mode, clean_model, columns) of camera tables: the base and every mode, which replaces the columns it sets, under every name.

    tables: make, model, clean_model, columns, modes (array of structs mode + columns), aliases (array of structs model + clean_model), at. Of equal
    keys the last one (by at, then by alias and mode) counts.
    """
    base = F.array(F.struct(F.lit("").alias("mode"), *(F.lit(None).cast(dict(tables.dtypes)[c]).alias(c) for c in columns)))
    own = F.array(F.struct("model", "clean_model"))
    none = lambda c, like: F.when(F.col(c).isNull(), F.slice(like, 1, 0)).otherwise(F.col(c))
    t = tables.withColumns({"names": F.concat(own, none("aliases", own)), "kinds": F.concat(base, none("modes", base))})
    t = t.select("at", "make", *columns, F.posexplode("names").alias("i", "name"), "kinds").select("at", "i", "make", "name", *columns, F.posexplode("kinds").alias("j", "kind"))
    rows = t.select("at", "i", "j", "make", F.col("name.model").alias("model"), F.col("kind.mode").alias("mode"), F.col("name.clean_model").alias("clean_model"), *(F.coalesce(F.col(f"kind.{c}"), F.col(c)).alias(c) for c in columns))
    return rows.groupBy("make", "model", "mode").agg(F.max_by(F.struct("clean_model", *columns), F.struct("at", "i", "j")).alias("x")).select("make", "model", "mode", "x.*")


def lens(images: DataFrame, lenses: DataFrame) -> DataFrame:
    """image_id, lens_id (or null): by exact name, else the first maker's code, else the second, else the only lens that fits all that is known.

    images: image_id, key_name, code_a, code_b, mount, make, focal, aperture; lenses: lens_id (their order), key_name, code_a, code_b, mount, make, focal_min,
    focal_max, aperture_min. The first three are equi-joins against the first lens of each key. The last one counts ranges, without pairs, for the images
    that are left only.
    """
    out, found = images, []
    for k in ("key_name", "code_a", "code_b"):
        first = lenses.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != "")).groupBy(k).agg(F.min("lens_id").alias(f"by_{k}"))
        out = out.join(first, k, "left")
        found.append(f"by_{k}")
    out = out.withColumn("first", F.coalesce(*found)).drop(*found)
    # a lens stands under its mount and make, each of them and neither; an image looks under what it knows
    known = F.struct(F.col("mount").isNotNull().alias("by_mount"), F.col("make").isNotNull().alias("by_make"), "mount", "make")
    facts = out.filter("first is null").select("image_id", known.alias("key"), F.col("focal").alias("at"), F.col("aperture").alias("most"))
    kinds = [(m, k) for m in (True, False) for k in (True, False)]
    none = lambda c: F.lit(None).cast(dict(lenses.dtypes)[c])
    under = F.array(*(F.when((F.col("mount").isNotNull() | F.lit(not m)) & (F.col("make").isNotNull() | F.lit(not k)), F.struct(F.lit(m).alias("by_mount"), F.lit(k).alias("by_make"), (F.col("mount") if m else none("mount")).alias("mount"), (F.col("make") if k else none("make")).alias("make"))) for m, k in kinds))
    refs = lenses.select("lens_id", F.explode(under).alias("key"), F.col("focal_min").alias("low"), F.col("focal_max").alias("high"), F.col("aperture_min").alias("least"))
    rest = lookup.only_fit(facts, refs, "image_id", "lens_id", False, True)
    return out.filter("first is not null").select("image_id", F.col("first").alias("lens_id")).unionAll(rest)
