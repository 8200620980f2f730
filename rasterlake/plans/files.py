"""Image files written from the sample grid and read again: one small image per line, its samples as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import bits, ciphers
from rasterlake.sinks import images
from rasterlake.sources import blocks, containers, segments

from .queries import ORACLE, QUERIES, read

SIDE = 8


def written(spark, d, write: Callable[[np.ndarray], bytes]) -> DataFrame:
    """path, content: every line of the grid as an image eight samples wide, of counts from 0 to 4095. No shuffle.

    Null lines are left out; a null sample is 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for line in batch["line"]:
                x = np.array([0 if v is None else v for v in line], np.int64)
                made.append(write(np.pad(x, (0, -len(x) % SIDE)).reshape(-1, SIDE, 1)))
            yield pd.DataFrame({"path": batch["vec_id"].astype(str), "content": made})

    line = F.transform("embedding", lambda v: F.coalesce(F.floor((v.cast("double") + 1) * 1000).cast("long").bitwiseAND(4095), F.lit(0).cast("long")))
    return read(spark, d, "embeddings").filter("embedding is not null").select("vec_id", line.alias("line")).mapInPandas(run, "path string, content binary")


def samples(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """r, c, v of every sample, by line and place in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decode(x).ravel() for x in batch["content"]]
            yield pd.DataFrame({"r": batch["path"].astype("int64"), "vs": got})

    return files.mapInPandas(run, "r long, vs array<long>").select("r", F.posexplode("vs").alias("c", "v")).select("r", F.col("c").cast("long").alias("c"), "v")


_SAMPLES = "SELECT vec_id AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 1000) AS BIGINT) & 4095 AS v FROM embeddings"


def _both(name: str, write: Callable[[np.ndarray], bytes], decode: Callable[[bytes], np.ndarray]) -> None:
    QUERIES[name] = lambda spark, d: samples(written(spark, d, write), decode)
    ORACLE[name] = _SAMPLES


for _order in bits.ORDERS:
    _both(f"packed_{_order}", lambda x, o=_order: bits.pack(x, 12, o), lambda b, o=_order: bits.unpack(b, 12, o, SIDE, len(b) * 2 // 3 // SIDE))
for _p in range(1, 8):
    _both(f"lossless_jpeg_p{_p}", lambda x, p=_p: bits.ljpeg_encode(x, 12, p), bits.ljpeg_decode)
_both("deflate_float", lambda x: bits.deflate_floats(x.astype(np.float32), 32), lambda b: bits.inflate_floats(b, SIDE, SIDE, 1, 32).astype(np.int64))
_both("tiff_strips", lambda x: images.tiff(x, rows=3), containers.tiff_image)
_both("tiff_lossless_tiles", lambda x: images.tiff(x, tile=16, lossless=True), containers.tiff_image)
_both("original_embedded", lambda x: images.embed(images.tiff(x))[0], lambda b: containers.tiff_image(images.extract(b)))


def tiff_tag_rows(spark, d) -> DataFrame:
    """Entries of every file, by tag."""
    found = containers.tiff_tags(written(spark, d, lambda x: images.tiff(x, rows=3)))
    return found.groupBy("tag").agg(F.count("*").alias("n"), F.sum("count").alias("n_values"))


QUERIES["tiff_tag_rows"] = tiff_tag_rows
ORACLE["tiff_tag_rows"] = "WITH e AS (SELECT len(embedding) // 8 AS h FROM embeddings WHERE embedding IS NOT NULL) SELECT CAST(tag AS INTEGER) AS tag, count(*) AS n, CAST(sum(CASE WHEN tag IN (273, 279) THEN ceil(h / 3.0) ELSE 1 END) AS BIGINT) AS n_values FROM e, (VALUES (256), (257), (258), (259), (262), (273), (277), (278), (279), (339)) t(tag) GROUP BY tag"


def file_kinds(spark, d) -> DataFrame:
    """Files by kind, from leading bytes alone."""
    return written(spark, d, lambda x: images.tiff(x)).groupBy(containers.kind(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


QUERIES["file_kinds"] = file_kinds
ORACLE["file_kinds"] = "SELECT 'tiff' AS kind, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL"


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    """The image's samples in lines of another width, after their number."""
    flat = np.concatenate([[x.size], x.ravel()])
    return np.pad(flat, (0, -len(flat) % width)).reshape(-1, width)


def _unpadded(x: np.ndarray) -> np.ndarray:
    return x.ravel()[1 : 1 + x.flat[0]]


_both("tiff_lzw", lambda x: images.tiff(x, rows=5, lzw=True), containers.tiff_image)
for _order in ("lsb", "msb"):
    _both(f"controlled_{_order}", lambda x, o=_order: segments.pack_controlled(_padded(x, 10), o, 170), lambda b, o=_order: _unpadded(segments.unpack_controlled(b, o, 10, len(b) // 16)))
_both("two_fields", lambda x: bytes([len(_padded(x, 10))]) + segments.pack_fields(_padded(x, 10)), lambda b: _unpadded(segments.unpack_fields(b[1:], 10, b[0])))

_EXTRA = ((271, 2, " Maker "), (272, 2, "One"), (274, 3, [6]), (306, 2, "2024:02:29 12:00:00"), (33434, 5, [1, 250]), (33437, 5, [28, 10]), (34855, 3, [400]), (37386, 5, [50, 0]), (42036, 2, "50mm"))


def _jpeg(x: np.ndarray) -> bytes:
    exif = segments.segment(0xFFE1, segments.EXIF + images.tiff(x[:1], extra=_EXTRA))
    return b"\xff\xd8" + segments.segment(0xFFE0, b"JFIF\0") + exif + segments.segment(0xFFE1, segments.XMP + b"<x/>") + segments.segment(0xFFDB, bytes(x.size)) + b"\xff\xd9"


def jpeg_segments(spark, d) -> DataFrame:
    """Segments of a file for each line of the grid."""
    found = segments.jpeg_rows(written(spark, d, _jpeg))
    return found.filter("holds is null").groupBy("place", "name").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


QUERIES["jpeg_segments"] = jpeg_segments
ORACLE["jpeg_segments"] = "WITH e AS (SELECT count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS s FROM embeddings WHERE embedding IS NOT NULL) SELECT CAST(k AS INTEGER) AS place, name, n, CASE k WHEN 1 THEN n * 5 WHEN 4 THEN s ELSE 0 END AS bytes FROM e, (VALUES (0, 'start'), (1, 'app0'), (4, 'other'), (5, 'end')) t(k, name)"


def exif_records(spark, d) -> DataFrame:
    """Records of the files that JPEG segments hold."""

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [segments.exif_of(c) for c in batch["content"]]})

    held = written(spark, d, _jpeg).mapInPandas(inner, "path string, content binary")
    got = segments.exif_records(containers.tiff_tags(held))
    return got.select(F.col("path").cast("long").alias("vec_id"), "make", "model", "modify_date", "lens_model", "artist", "orientation", "exposure_time", "f_number", "iso", "focal_length", "flash")


QUERIES["exif_records"] = exif_records
ORACLE["exif_records"] = "SELECT vec_id, 'Maker' AS make, 'One' AS model, '2024:02:29 12:00:00' AS modify_date, '50mm' AS lens_model, CAST(NULL AS VARCHAR) AS artist, 6.0::DOUBLE AS orientation, 0.004::DOUBLE AS exposure_time, 2.8::DOUBLE AS f_number, 400.0::DOUBLE AS iso, CAST(NULL AS DOUBLE) AS focal_length, CAST(NULL AS DOUBLE) AS flash FROM embeddings WHERE embedding IS NOT NULL"


def ciff_entries(spark, d) -> DataFrame:
    """Entries of a file for each line of the grid: a text, a value in the record, and a heap with the samples."""
    made = written(spark, d, lambda x: segments.ciff([(0x0805, b"a text"), (0x5029, bytes(8)), (0x300A, [(0x2005, x.astype("<u2").tobytes())])]))
    return segments.ciff_rows(made).groupBy("heap", "tag", "type").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


QUERIES["ciff_entries"] = ciff_entries
ORACLE["ciff_entries"] = "WITH e AS (SELECT count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) * 2 AS s FROM embeddings WHERE embedding IS NOT NULL) SELECT heap, CAST(tag AS INTEGER) AS tag, CAST(tag & 14336 AS INTEGER) AS type, n, n * k + m * s AS bytes FROM e, (VALUES ('', 2053, 6, 0), ('', 4137, 8, 0), ('', 12298, 16, 1), ('/12298', 8197, 0, 1)) t(heap, tag, k, m)"


def _of_line(found: DataFrame, c) -> DataFrame:
    """Samples of the files by the grid's line and their place in it."""
    return found.select(F.col("path").cast("long").alias("r"), c.cast("long").alias("c"), F.col("v").cast("long").alias("v"))


def lines_decoded(spark, d) -> DataFrame:
    """Each line of the images is a row, decoded by itself."""
    made = written(spark, d, lambda x: bits.pack(x, 12, "msb"))
    return _of_line(blocks.decoded(blocks.strips(made, 12), lambda part, line: bits.unpack(part, 12, "msb", SIDE, 1)), F.col("r") * SIDE + F.col("c"))


def strips_decoded(spark, d) -> DataFrame:
    """Three lines at a time, dealt to all tasks."""
    made = written(spark, d, lambda x: b"head" + bits.pack(x, 12, "lsb"))
    cut = blocks.dealt(blocks.strips(made, 12, 3, start=4))
    return _of_line(blocks.decoded(cut, lambda part, line: bits.unpack(part, 12, "lsb", SIDE, len(part) // 12)), F.col("r") * SIDE + F.col("c"))


def chunks_decoded(spark, d) -> DataFrame:
    """Runs of ten samples, whatever their lines."""
    made = written(spark, d, lambda x: bits.pack(x, 12, "msb"))
    return _of_line(blocks.decoded(blocks.chunks(made, 15), lambda part, line: bits.unpack(part, 12, "msb", len(part) * 2 // 3, 1)), F.col("r") * 10 + F.col("c"))


def tiles_decoded(spark, d) -> DataFrame:
    """Lossless JPEG tiles of a TIFF, each a row, dealt to all tasks."""
    made = written(spark, d, lambda x: images.tiff(x, tile=16, lossless=True))
    return _of_line(blocks.tiff_samples(blocks.dealt(blocks.tiff_blocks(made))), F.col("r") * SIDE + F.col("c"))


for _f in (lines_decoded, strips_decoded, chunks_decoded, tiles_decoded):
    QUERIES[_f.__name__], ORACLE[_f.__name__] = _f, _SAMPLES


def cubes_undone(spark, d) -> DataFrame:
    """Bytes of the order keys, ciphered as cubes modulo 249."""
    byte = F.col("o_orderkey") % 249
    return read(spark, d, "orders").select("o_orderkey", ciphers.cube_root(byte * byte * byte % 249).cast("long").alias("byte"), ciphers.cube_root(F.lit(249) + F.col("o_orderkey") % 7).cast("long").alias("high"))


QUERIES["cubes_undone"] = cubes_undone
ORACLE["cubes_undone"] = "SELECT o_orderkey, CAST(o_orderkey % 249 AS BIGINT) AS byte, CAST(249 + o_orderkey % 7 AS BIGINT) AS high FROM orders"


def stepped_stream(spark, d) -> DataFrame:
    """Key stream of the lines of each order, by place: the exclusive or with 0."""
    x = read(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", ciphers.by_steps(F.lit(0), F.col("l_linenumber") - 1, F.col("l_orderkey") % 256, F.col("l_suppkey") % 256).alias("key"))


QUERIES["stepped_stream"] = stepped_stream
ORACLE["stepped_stream"] = "SELECT l_orderkey, l_linenumber, CAST((l_suppkey % 256 + (l_orderkey % 256) * list_sum(list_transform(range(0, CAST(l_linenumber AS BIGINT)), lambda k: 96 + k))) % 256 AS BIGINT) AS key FROM lineitem"


def position_tags(spark, d) -> DataFrame:
    """Position of every supplier, from tag rows: degrees, minutes and seconds."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_suppkey").cast("double").alias("k"))
    one = lambda tag, kind, numbers, text: F.struct(F.lit("0/34853.0").alias("directory"), F.lit(tag).alias("tag"), F.lit(kind).alias("type"), numbers.cast("array<double>").alias("numbers"), text.cast("string").alias("text"), F.lit(None).cast("binary").alias("raw"))
    rows = [one(1, 2, F.lit(None), F.lit("S")), one(2, 5, F.array("k", F.lit(4), F.col("k") * 3, F.lit(8), F.lit(7), F.lit(0)), F.lit(None)), one(5, 1, F.array(F.lit(1)), F.lit(None))]
    got = segments.position_records(s.select("path", F.explode(F.array(*rows)).alias("t")).select("path", "t.*"))
    return got.select(F.col("path").cast("long").alias("s_suppkey"), "latitude_ref", F.col("latitude")[0].alias("degrees"), F.col("latitude")[1].alias("minutes"), F.col("latitude")[2].alias("seconds"), F.col("altitude_ref")[0].alias("altitude_ref"), "map_datum")


QUERIES["position_tags"] = position_tags
ORACLE["position_tags"] = "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, 'S' AS latitude_ref, s_suppkey / 4.0::DOUBLE AS degrees, s_suppkey * 3 / 8.0::DOUBLE AS minutes, CAST(NULL AS DOUBLE) AS seconds, 1.0::DOUBLE AS altitude_ref, CAST(NULL AS VARCHAR) AS map_datum FROM supplier"
