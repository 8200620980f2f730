"""Image files and embedded originals as bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake import attach
from rasterlake.functions import bits, numeric
from rasterlake.functions import lzw as codec

BLOCK = 1 << 16


def pnm(samples: np.ndarray, top: int = 65535) -> bytes:
    """PGM of one channel, PPM of three; samples above 255 take two bytes, high byte first."""
    h, w, n = samples.shape
    return f"P{5 if n == 1 else 6} {w} {h} {top}\n".encode() + samples.astype(">u2" if top > 255 else "u1").tobytes()


def tiff(samples: np.ndarray, tile: int = 0, lossless: bool = False, rows: int = 256, lzw: bool = False, extra: tuple = ()) -> bytes:
    """A little-endian TIFF of 16-bit integers or 32-bit floats: strips of so many rows, or square tiles whose edges repeat.

    extra: further entries (tag, type, values): type 2 is text, 3 and 4 are whole numbers, 5 is a flat list of rationals.
    """
    h, w, n = samples.shape
    real = samples.dtype.kind == "f"
    if tile:
        padded = np.pad(samples, ((0, -h % tile), (0, -w % tile), (0, 0)), "edge")
        parts = [padded[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        parts = [samples[r : r + rows] for r in range(0, h, rows)]
    data = [bits.ljpeg_encode(p, 16) if lossless else zlib.compress(p.astype("<f4").tobytes()) if real else codec.encode(p.astype("<u2").tobytes()) if lzw else p.astype("<u2").tobytes() for p in parts]
    places = 8 + np.cumsum([0, *map(len, data)])
    shape = [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places[:-1]), (325, 4, [len(x) for x in data])] if tile else [(273, 4, places[:-1]), (278, 4, [rows]), (279, 4, [len(x) for x in data])]
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [32 if real else 16] * n), (259, 3, [7 if lossless else 8 if real else 5 if lzw else 1]), (262, 3, [2 if n == 3 else 1]), (277, 3, [n]), (339, 3, [3 if real else 1] * n), *shape, *extra]
    body = b"".join(data)
    body += bytes(len(body) % 2)
    start = 8 + len(body)
    head, more, after = struct.pack("<H", len(entries)), b"", start + 2 + 12 * len(entries) + 4
    for tag, kind, values in sorted(entries, key=lambda x: x[0]):
        raw = values.encode("latin-1") + b"\0" if kind == 2 else struct.pack("<" + {3: "H", 4: "I", 5: "I"}[kind] * len(values), *map(int, values))
        head += struct.pack("<HHI", tag, kind, len(raw) // {2: 1, 3: 2, 4: 4, 5: 8}[kind]) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(more)))
        more += raw if len(raw) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, start) + body + head + bytes(4) + more


def _grid(samples: pa.Table, names: list[str]) -> np.ndarray:
    """height x width x channels of rows (r, c, ...); a missing or null sample is 0."""
    r, c = samples["r"].to_numpy(), samples["c"].to_numpy()
    out = np.zeros((r.max(initial=-1) + 1, c.max(initial=-1) + 1, len(names)), np.int64)
    for i, n in enumerate(names):
        out[r, c, i] = samples[n].combine_chunks().fill_null(0).to_numpy()
    return out


def developed(rgb: DataFrame, names: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """image_id, content: each image as a 16-bit TIFF with LZW strips; colours run from 0 to 1, and what is beyond is cut.

    An image is put together by one task, as a file is.
    """

    def write(samples: pa.Table) -> pa.Table:
        return pa.table({"image_id": samples["image_id"].slice(0, 1), "content": [tiff(_grid(samples, list(names)), lzw=True)]})

    attach(rgb.sparkSession)
    whole = rgb.select("image_id", "r", "c", *(numeric.saturate(F.col(n) * 65535).alias(n) for n in names)).dropna(subset=["r", "c"])
    return whole.groupBy("image_id").applyInArrow(write, f"image_id {rgb.schema['image_id'].dataType.simpleString()}, content binary")


def digests(px: DataFrame) -> DataFrame:
    """image_id, md5: of each image's samples as 16-bit numbers, low byte first, line by line; a missing sample is 0."""

    def digest(samples: pa.Table) -> pa.Table:
        return pa.table({"image_id": samples["image_id"].slice(0, 1), "md5": [hashlib.md5(_grid(samples, ["v"]).astype("<u2").tobytes()).hexdigest()]})

    attach(px.sparkSession)
    whole = px.select("image_id", "r", "c", F.col("v").cast("long").alias("v")).dropna(subset=["r", "c"])
    return whole.groupBy("image_id").applyInArrow(digest, f"image_id {px.schema['image_id'].dataType.simpleString()}, md5 string")


def embed(original: bytes) -> tuple[bytes, bytes]:
    """An original in deflated blocks of 64 KiB behind their count and ends (big-endian), and its MD5."""
    blocks = [zlib.compress(original[i : i + BLOCK]) for i in range(0, len(original), BLOCK)]
    first = 4 * (len(blocks) + 2)
    ends = [first + sum(map(len, blocks[:i])) for i in range(len(blocks) + 1)]
    return struct.pack(f">I{len(ends)}I", len(original), *ends) + b"".join(blocks), hashlib.md5(original).digest()


def extract(embedded: bytes, digest: bytes | None = None) -> bytes:
    """The original; an error if its length or MD5 differs."""
    size = struct.unpack_from(">I", embedded)[0]
    n = -(-size // BLOCK)
    ends = struct.unpack_from(f">{n + 1}I", embedded, 4)
    out = b"".join(zlib.decompress(embedded[a:b]) for a, b in zip(ends, ends[1:], strict=False))
    if len(out) != size or digest and hashlib.md5(out).digest() != digest:
        raise ValueError("the embedded original is damaged")
    return out
