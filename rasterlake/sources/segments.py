"""JPEG segments, CIFF heaps, line layouts with control bytes or two fields, and EXIF records as one row a file."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import bits

#: Markers by name; others are "other".
MARKERS = {0xFFD8: "start", 0xFFD9: "end", 0xFFE0: "app0", 0xFFE1: "app1", 0xFFDA: "scan"}
EXIF, XMP = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0"
#: CIFF types that hold entries, and where an entry's data are.
HEAPS, IN_HEAP, IN_RECORD, MAX_DEPTH = (0x2800, 0x3000), 0x0000, 0x4000, 10
#: EXIF tags of texts and of numbers.
TEXTS = {
    "make": 271, "model": 272, "modify_date": 306, "artist": 315, "copyright": 33432, "date_time_original": 36867, "create_date": 36868, "offset_time": 36880, "offset_time_original": 36881, "offset_time_digitized": 36882,
    "sub_sec_time": 37520, "sub_sec_time_original": 37521, "sub_sec_time_digitized": 37522, "owner_name": 42032, "serial_number": 42033, "lens_make": 42035, "lens_model": 42036, "lens_serial_number": 42037,
}
NUMBERS = {
    "orientation": 274, "exposure_time": 33434, "f_number": 33437, "exposure_program": 34850, "iso": 34855, "sensitivity_type": 34864, "recommended_exposure_index": 34866, "iso_speed": 34867, "shutter_speed": 37377,
    "aperture": 37378, "brightness": 37379, "exposure_bias": 37380, "max_aperture": 37381, "subject_distance": 37382, "metering_mode": 37383, "light_source": 37384, "flash": 37385, "focal_length": 37386, "image_number": 37393,
    "color_space": 40961, "flash_energy": 41483, "exposure_mode": 41986, "white_balance": 41987, "scene_capture_type": 41990, "subject_distance_range": 41996,
}


def jpeg_segments(content: bytes | None) -> list[tuple[int, str, int, int, str | None]]:
    """(marker, name, start and length of the payload, holds) in order; holds is exif or xmp for app1.

    Empty if the file does not begin with a start marker; ends at the end marker, after the scan header, or where a segment is cut.
    """
    data, out, at = content or b"", [], 0
    while at + 2 <= len(data):
        marker = int.from_bytes(data[at : at + 2], "big")
        if not out and marker != 0xFFD8:
            return []
        name = MARKERS.get(marker, "other")
        if name in ("start", "end"):
            out.append((marker, name, at + 2, 0, None))
            at += 2
            if name == "end":
                break
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            break
        body = data[at + 4 : at + 2 + size]
        holds = None if name != "app1" else "exif" if body.startswith(EXIF) else "xmp" if body.startswith(XMP) else None
        out.append((marker, name, at + 4, size - 2, holds))
        at += 2 + size
        if name == "scan":
            break
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", marker, len(body) + 2) + body


def exif_of(content: bytes | None) -> bytes | None:
    """The TIFF file that the first EXIF segment holds."""
    found = next((s for s in jpeg_segments(content) if s[4] == "exif"), None)
    return content[found[2] + len(EXIF) : found[2] + found[3]] if found else None


def ciff_entries(content: bytes | None) -> list[tuple[str, int, int, int, int]]:
    """(heap, tag, type, start and length of the data) of every entry; heaps below are named by their tags.

    Heaps and entries that do not lie in the file are left out, and so are heaps below the tenth level.
    """
    data = content or b""
    if len(data) < 18 or data[6:14] != b"HEAPCCDR":
        return []
    e = "<" if data[:2] == b"II" else ">"
    out, todo = [], [("", struct.unpack_from(e + "I", data, 2)[0], len(data), 1)]
    while todo:
        name, start, end, depth = todo.pop(0)
        if not start + 4 <= end <= len(data):
            continue
        at = start + struct.unpack_from(e + "I", data, end - 4)[0]
        if at + 2 > end:
            continue
        for p in range(at + 2, at + 2 + 10 * struct.unpack_from(e + "H", data, at)[0], 10):
            if p + 10 > end:
                break
            code, size, place = struct.unpack_from(e + "HII", data, p)
            tag, kind, where = code & 0x3FFF, code & 0x3800, code & 0xC000
            first, size = (start + place, size) if where == IN_HEAP else (p + 2, 8)
            if where not in (IN_HEAP, IN_RECORD) or first + size > len(data):
                continue
            out.append((name, tag, kind, first, size))
            if kind in HEAPS and depth < MAX_DEPTH:
                todo.append((f"{name}/{tag}", first, first + size, depth + 1))
    return out


def ciff(entries: list[tuple[int, bytes | list]]) -> bytes:
    """A little-endian CIFF file of (code, data) entries; a list is a heap of further entries. Data of 8 bytes may lie in the record."""

    def heap(items: list) -> bytes:
        body, table = b"", b""
        for code, value in items:
            raw = heap(value) if isinstance(value, list) else value
            if code & 0xC000 == IN_RECORD:
                table += struct.pack("<H8s", code, raw)
            else:
                table += struct.pack("<HII", code, len(raw), len(body))
                body += raw
        return body + struct.pack("<H", len(items)) + table + struct.pack("<I", len(body))

    return struct.pack("<2sI8s", b"II", 14, b"HEAPCCDR") + heap(entries)


def rows(files: DataFrame, parse: Callable[[bytes], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """path, place and the columns of parse, a row for each part of files (path, content): no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, i, *x) for p, c in zip(batch["path"], batch["content"], strict=True) for i, x in enumerate(parse(c))], columns=["path", "place", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, place int, {schema}")


def jpeg_rows(files: DataFrame) -> DataFrame:
    return rows(files, jpeg_segments, ["marker", "name", "start", "length", "holds"], "marker int, name string, start long, length long, holds string")


def ciff_rows(files: DataFrame) -> DataFrame:
    return rows(files, ciff_entries, ["heap", "tag", "type", "start", "length"], "heap string, tag int, type int, start long, length long")


def unpack_controlled(data: bytes, order: str, width: int, height: int) -> np.ndarray:
    """12-bit lines in which a control byte follows each ten samples; samples beyond the last whole ten of a line are 0."""
    per_line = width * 12 // 8 + (width + 2) // 10
    raw = np.frombuffer(data, np.uint8)[: height * per_line].reshape(height, per_line)
    tens = width // 10
    packed = np.ascontiguousarray(raw[:, : tens * 16].reshape(height, tens, 16)[:, :, :15])
    out = np.zeros((height, width), np.int64)
    out[:, : tens * 10] = bits.unpack(packed.tobytes(), 12, order, tens * 10, height)
    return out


def pack_controlled(samples: np.ndarray, order: str, control: int = 0) -> bytes:
    """The bytes that unpack_controlled() reads; the width is a multiple of ten."""
    h, w = samples.shape
    packed = np.frombuffer(bits.pack(samples, 12, order), np.uint8).reshape(h, w // 10, 15)
    return np.pad(packed, ((0, 0), (0, 0), (0, 1)), constant_values=control).tobytes()


def field_start(width: int, height: int, align: int) -> int:
    """First byte of the second field: the even lines come first; aligned fields leave a gap even after a whole block."""
    size = (height + 1) // 2 * width * 12 // 8
    return (size // align + 1) * align if align > 1 else size


def unpack_fields(data: bytes, width: int, height: int, align: int = 2048) -> np.ndarray:
    """12-bit lines, high bit first, whose even lines come before the odd ones."""
    half = (height + 1) // 2
    out = np.zeros((height, width), np.int64)
    out[::2] = bits.unpack(data, 12, "msb", width, half)
    out[1::2] = bits.unpack(data[field_start(width, height, align) :], 12, "msb", width, height - half)
    return out


def pack_fields(samples: np.ndarray, align: int = 2048) -> bytes:
    h, w = samples.shape
    return bits.pack(samples[::2], 12, "msb").ljust(field_start(w, h, align), b"\0") + bits.pack(samples[1::2], 12, "msb")


def exif_records(tags: DataFrame) -> DataFrame:
    """One row a file from tag rows: texts without outer blanks, rationals as quotients (null over 0), first values of others.

    Of a tag in several directories the last directory's counts. Files without such tags are left out. Partial maxima are
    combined before the shuffle, which is by path alone.
    """
    wanted = {**TEXTS, **NUMBERS}
    n = F.col("numbers")
    quotient = F.when(F.try_element_at(n, F.lit(2)) != 0, F.try_element_at(n, F.lit(1)) / F.try_element_at(n, F.lit(2)))
    value = F.when(F.col("type").isin(5, 10), quotient).otherwise(F.try_element_at(n, F.lit(1)))
    t = tags.filter(F.col("tag").isin(list(wanted.values()))).select("path", "tag", "directory", F.trim("text").alias("text"), value.alias("number"))
    last = lambda tag, c: F.max_by(c, F.when(F.col("tag") == tag, F.col("directory")))
    return t.groupBy("path").agg(*(last(k, "text").alias(a) for a, k in TEXTS.items()), *(last(k, "number").alias(a) for a, k in NUMBERS.items()))


#: Names of position tags 0 to 31 (directory of tag 34853).
POSITION = (
    "version_id", "latitude_ref", "latitude", "longitude_ref", "longitude", "altitude_ref", "altitude", "time_stamp", "satellites", "status", "measure_mode",
    "dop", "speed_ref", "speed", "track_ref", "track", "img_direction_ref", "img_direction", "map_datum", "dest_latitude_ref", "dest_latitude",
    "dest_longitude_ref", "dest_longitude", "dest_bearing_ref", "dest_bearing", "dest_distance_ref", "dest_distance", "processing_method", "area_information", "date_stamp", "differential", "h_positioning_error",
)
#: Of these, texts, and values of raw bytes.
POSITION_TEXTS, POSITION_BYTES = {n for n in POSITION if n.endswith("_ref") and n != "altitude_ref"} | {"satellites", "status", "measure_mode", "map_datum", "date_stamp"}, {"processing_method", "area_information"}


def position_records(tags: DataFrame) -> DataFrame:
    """One row a file from tag rows: its position tags, texts as they are, rationals as quotients (null over 0), others as arrays.

    Files without such tags are left out; of a repeated tag the last directory's counts. Combined before the shuffle by path.
    """
    n = F.col("numbers")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(n) / 2) - 1, F.lit(0)).cast("int")), lambda i: F.when(F.get(n, i * 2 + 1) != 0, F.get(n, i * 2) / F.get(n, i * 2 + 1)))
    t = tags.filter(F.col("directory").contains("/34853.") & F.col("tag").between(0, 31)).withColumn("value", F.when(F.col("type").isin(5, 10), pairs).otherwise(n))
    last = lambda k, c: F.max_by(c, F.when(F.col("tag") == k, F.col("directory")))
    pick = lambda name: "text" if name in POSITION_TEXTS else "raw" if name in POSITION_BYTES else "value"
    return t.groupBy("path").agg(*(last(k, pick(name)).alias(name) for k, name in enumerate(POSITION)))
