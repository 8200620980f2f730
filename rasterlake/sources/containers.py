"""Container files: kind by leading bytes, TIFF directories as flat rows, image strips and tiles, and ISO boxes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import bits, lzw

#: Kind, place and leading bytes (hex); the first that fits names the kind.
MAGIC = (
    ("mrw", 0, "004D524D"), ("raf", 0, "46554A4946494C4D"), ("ari", 0, "41525249"), ("qtk", 0, "716B746B"), ("qtk", 0, "716B746E"), ("ciff", 6, "4845415043434452"),
    ("jfif", 0, "FFD8FF"), ("x3f", 0, "464F5662"), ("crx", 4, "6674797063727820"), ("tiff", 0, "49492A00"), ("tiff", 0, "4D4D002A"), ("tiff", 0, "49495200"), ("tiff", 0, "4949524F"), ("tiff", 0, "49495253"), ("tiff", 0, "49495500"),
)
#: Bytes and struct letter of TIFF types 1 to 13.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}
#: Tags that hold the places of further directories.
SUB_TAGS = (330, 34665, 34853, 40965)
MAX_ENTRIES = 4096
#: Box types that hold boxes.
BOXES = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta")


def kind(content: Column) -> Column:
    """Kind of a file; null if unknown or empty."""
    tests = [F.when(F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic, F.lit(name)) for name, at, magic in MAGIC]
    return F.coalesce(*tests)


def tags(content: bytes | None) -> list[tuple]:
    """(directory, tag, type, count, numbers, text, raw) of every entry; directories are numbered along the chain, those below as
    parent/tag.number. Rationals are two numbers. Entries that point outside the file are left out; loops are read once."""
    data = content or b""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        return []
    e = "<" if data[:2] == b"II" else ">"
    out, seen, todo, chained = [], set(), [("0", struct.unpack_from(e + "I", data, 4)[0])], 0
    while todo:
        name, at = todo.pop(0)
        if at in seen or not 0 < at <= len(data) - 2:
            continue
        seen.add(at)
        n = struct.unpack_from(e + "H", data, at)[0]
        if n > MAX_ENTRIES:
            continue
        for i in range(n):
            p = at + 2 + 12 * i
            if p + 12 > len(data):
                break
            tag, kind_, count = struct.unpack_from(e + "HHI", data, p)
            size, letter = TYPES.get(kind_, (1, "s"))
            start = p + 8 if size * count <= 4 else struct.unpack_from(e + "I", data, p + 8)[0]
            raw = data[start : start + size * count]
            if len(raw) < size * count:
                continue
            numbers = None if letter == "s" else [float(v) for v in struct.unpack(e + letter * count, raw)]
            out.append((name, tag, kind_, count, numbers, raw.split(b"\0")[0].decode("latin-1") if kind_ == 2 else None, raw))
            if tag in SUB_TAGS and numbers:
                todo += [(f"{name}/{tag}.{k}", int(v)) for k, v in enumerate(numbers)]
        if "/" not in name and at + 6 + 12 * n <= len(data):
            chained += 1
            todo.append((str(chained), struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0]))
    return out


TAG_SCHEMA = "path string, directory string, tag int, type int, count long, numbers array<double>, text string, raw binary"


def tiff_tags(files: DataFrame) -> DataFrame:
    """One row per entry of files (path, content), which stay whole within a task: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *t) for path, content in zip(batch["path"], batch["content"], strict=True) for t in tags(content)]
            yield pd.DataFrame(rows, columns=["path", "directory", "tag", "type", "count", "numbers", "text", "raw"])

    return files.select("path", "content").mapInPandas(run, TAG_SCHEMA)


def tiff_layout(content: bytes, directory: str = "0") -> tuple[dict, list[tuple]]:
    """What a directory's blocks share, and (row, column, start, length) of each strip or tile, line by line."""
    found = {t[1]: t for t in tags(content) if t[0] == directory}
    one = lambda tag, other: int(found[tag][4][0]) if tag in found else other
    w, h = one(256, 0), one(257, 0)
    tiled = 324 in found
    bw, bh = (one(322, w), one(323, h)) if tiled else (w, min(one(278, h), h))
    shared = {"height": h, "width": w, "block_height": bh, "block_width": bw, "tiled": tiled, "channels": one(277, 1), "depth": one(258, 1), "compression": one(259, 1), "predictor": one(317, 1), "real": one(339, 1) == 3, "little": content[:2] == b"II"}
    places, sizes = (found[t][4] if t in found else [] for t in ((324, 325) if tiled else (273, 279)))
    across = -(-w // bw) if bw else 1
    return shared, [(i // across * bh, i % across * bw, int(at), int(size)) for i, (at, size) in enumerate(zip(places, sizes, strict=True))]


def tiff_block(part: bytes, top: int, height: int, width: int, block_height: int, block_width: int, tiled: bool, channels: int, depth: int, compression: int, predictor: int, real: bool, little: bool, left: int = 0) -> np.ndarray:
    """lines x samples x channels of one strip or tile, cut to the image: uncompressed, LZW (5), lossless JPEG (7) or deflate (8)."""
    rows, cols = block_height if tiled else min(block_height, height - top), block_width
    if compression == 7:
        block = bits.ljpeg_decode(part)
    elif compression == 8 and predictor == 3:
        block = bits.inflate_floats(part, cols, rows, channels, depth)
    elif compression in (1, 5, 8):
        part = zlib.decompress(part) if compression == 8 else lzw.decode(part) if compression == 5 else part
        block = bits.floats(part, depth, little) if real else np.frombuffer(part, ("<" if little else ">") + f"u{depth // 8}") if depth in (8, 16, 32) else bits.unpack(part, depth, "msb", cols * channels, rows, -(-cols * channels * depth // 8))
    else:
        raise ValueError(f"compression {compression} is not supported")
    return block.reshape(rows, cols, channels)[: height - top, : width - left]


def tiff_image(content: bytes, directory: str = "0") -> np.ndarray:
    """height x width x channels of a directory, put together from its blocks."""
    shared, blocks = tiff_layout(content, directory)
    out = np.zeros((shared["height"], shared["width"], shared["channels"]), np.float64 if shared["real"] else np.int64)
    for top, left, at, size in blocks:
        block = tiff_block(content[at : at + size], top, left=left, **shared)
        out[top : top + len(block), left : left + block.shape[1]] = block
    return out


def boxes(content: bytes | None) -> list[tuple[str, int, int]]:
    """(path, start, length) of every ISO box, parents first; a box that does not fit its parent ends the list there."""
    data, out, todo = content or b"", [], [("", 0, len(content or b""))]
    while todo:
        name, at, end = todo.pop(0)
        while at + 8 <= end:
            size, what = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            size = end - at if size == 0 else size
            if size < head or at + size > end:
                break
            path = f"{name}/{what.decode('latin-1')}"
            out.append((path, at, size))
            if what in BOXES:
                todo.append((path, at + head, at + size))
            at += size
    return out


def iso_boxes(files: DataFrame) -> DataFrame:
    """One row per box of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(path, *b) for path, content in zip(batch["path"], batch["content"], strict=True) for b in boxes(content)], columns=["path", "box", "start", "length"])

    return files.select("path", "content").mapInPandas(run, "path string, box string, start long, length long")
