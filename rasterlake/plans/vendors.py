"""Queries of raw files whose bytes are put together here by plain integers, apart from the package's own writers."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.sinks import dng as sink
from rasterlake.sources import dng, vendor

from . import convert
from .files import _SAMPLES
from .queries import ORACLE, QUERIES, query, read

#: 96 bytes from which every layout is read, 4 lines of 8 samples.
_BYTES = bytes((i * 37 + 11) % 256 for i in range(96))


def _high(b: bytes, n: int, i: int) -> int:
    return int.from_bytes(b, "big") >> (8 * len(b) - n * (i + 1)) & ((1 << n) - 1)


def _low(b: bytes, n: int, i: int) -> int:
    return int.from_bytes(b, "little") >> n * i & ((1 << n) - 1)


def _turned(b: bytes, size: int) -> bytes:
    return b"".join(b[i : i + size][::-1] for i in range(0, len(b), size))


_EXPECTED: dict[str, Callable[[int], int]] = {
    "8bit": lambda i: _BYTES[i], "16le": lambda i: _low(_BYTES, 16, i), "16be": lambda i: _high(_BYTES, 16, i), "12le": lambda i: _low(_BYTES, 12, i), "12be": lambda i: _high(_BYTES, 12, i),
    "12be_msb16": lambda i: _high(_turned(_BYTES, 2), 12, i), "12be_msb32": lambda i: _high(_turned(_BYTES, 4), 12, i), "10le_lsb16": lambda i: _high(_turned(_BYTES, 2), 10, i), "14le": lambda i: _low(_BYTES, 14, i), "14be": lambda i: _high(_BYTES, 14, i),
    "12le_unpacked": lambda i: _low(_BYTES, 16, i) & 4095, "12be_unpacked": lambda i: _high(_BYTES, 16, i) & 4095, "14le_unpacked": lambda i: _low(_BYTES, 16, i) & 16383, "14be_unpacked": lambda i: _high(_BYTES, 16, i) & 16383,
    "12le_left_aligned": lambda i: _low(_BYTES, 16, i) >> 4, "12be_left_aligned": lambda i: _high(_BYTES, 16, i) >> 4, "12le_16bitaligned": lambda i: _high(_BYTES[i // 8 * 12 : i // 8 * 12 + 12], 12, i % 8),
    "12be_interlaced_unaligned": lambda i: _high(_BYTES, 12, (i // 16 + 2 * (i // 8 % 2)) * 8 + i % 8),
}


@query("SELECT layout, CAST(i AS INTEGER) AS i, CAST(v AS BIGINT) AS v FROM (VALUES " + ", ".join(f"('{k}', {i}, {f(i)})" for k, f in _EXPECTED.items() for i in range(32)) + ") t(layout, i, v)")
def packed_layouts(spark, d):
    """Every layout over one fixed input."""
    rows = [(k, i, int(v)) for k in _EXPECTED for i, v in enumerate(vendor.decode(k, _BYTES, 8, 4).ravel())]
    return spark.createDataFrame(rows, "layout string, i int, v long")


def _bits12(x: list[int]) -> bytes:
    total = 0
    for v in x:
        total = total << 12 | v
    return total.to_bytes(len(x) * 12 // 8, "big")


def _tiff(x: list[int], data: bytes, extra: list[tuple[int, int, int, int]]) -> bytes:
    """A big-endian directory, then the samples."""
    entries = sorted([(256, 3, 1, 8 << 16), (257, 3, 1, len(x) // 8 << 16), *extra])
    at = 8 + 2 + 12 * (len(entries) + 1) + 4
    entries = sorted([*entries, (273, 4, 1, at)])
    return b"MM\0*\0\0\0\x08" + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + bytes(4) + data


def _ari(x):
    head = bytearray(128)
    head[:4], head[8:12], head[20:28], head[100:112] = b"ARRI", struct.pack("<I", 128), struct.pack("<II", 8, len(x) // 8), struct.pack("<3f", 2, 1, 1.5)
    return bytes(head) + _turned(_bits12(x), 4)


def _mrw(x, packed: bool):
    prd = b"\0PRD" + struct.pack(">I", 24) + bytes(8) + struct.pack(">HH", len(x) // 8, 8) + bytes(4) + bytes([12 if packed else 16]) + bytes(7)
    wbg = b"\0WBG" + struct.pack(">I", 12) + bytes(4) + struct.pack(">4H", 512, 256, 256, 384)
    blocks = prd + wbg + b"\0PAD" + struct.pack(">I", 24) + bytes(24)
    return b"\0MRM" + struct.pack(">I", len(blocks)) + blocks + (_bits12(x) if packed else struct.pack(f">{len(x)}H", *(v | 0x9000 for v in x)))


WRITERS: dict[str, Callable[[list[int]], bytes]] = {
    "ari": _ari, "mrw": lambda x: _mrw(x, True), "mrw_unpacked": lambda x: _mrw(x, False), "mef": lambda x: _tiff(x, _bits12(x), [(33422, 1, 4, 0x00010102)]),
    "3fr": lambda x: _tiff(x, struct.pack(f"<{len(x)}H", *x), [(50717, 3, 1, 4095 << 16)]), "naked": lambda x: _turned(_bits12(x), 2),
}


def _read(kind: str, content: bytes) -> np.ndarray:
    if kind == "naked":
        return vendor.naked(content, vendor.Camera(8, len(content) * 8 // 12 // 8, len(content)))["samples"]
    camera = vendor.Camera(hints=frozenset({"uncompressed"}))
    return vendor.READERS[kind.partition("_")[0]](content, camera)["samples"]


def files(spark, d, write: Callable[[list[int]], bytes]) -> DataFrame:
    """path, content: every line of the grid as an image eight samples wide, counts from 0 to 4095; null samples are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, convert.BATCH_ROWS):
                part = batch.slice(at, convert.BATCH_ROWS)
                content = pa.array((write(line.as_py()) for line in part.column(1)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), content], ["path", "content"])

    line = F.transform("embedding", lambda v: F.coalesce(F.floor((v.cast("double") + 1) * 1000).cast("long").bitwiseAND(4095), F.lit(0).cast("long")))
    return read(spark, d, "embeddings").filter("embedding is not null").select("vec_id", line.alias("line")).mapInArrow(run, "path string, content binary")


def exploded(lines: DataFrame) -> DataFrame:
    """r (the file), c (place in it) and v of lines (path, r, vs) eight samples wide."""
    got = lines.select(F.col("path").cast("long").alias("f"), "r", F.posexplode("vs").alias("c", "v"))
    return got.select(F.col("f").alias("r"), (F.col("r") * 8 + F.col("c")).cast("long").alias("c"), "v")


def _frame(kind: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(p, r, v) for p, c in zip(batch["path"], batch["content"], strict=True) for r, v in enumerate(_read(kind, c))]
            yield pd.DataFrame(got, columns=["path", "r", "vs"])

    return lambda spark, d: exploded(files(spark, d, WRITERS[kind]).mapInPandas(run, "path string, r long, vs array<long>"))


for _kind in WRITERS:
    QUERIES[f"{_kind.replace('3fr', 'tfr')}_frame"], ORACLE[f"{_kind.replace('3fr', 'tfr')}_frame"] = _frame(_kind), _SAMPLES


def _dng(x: list[int], tile: int = 0) -> bytes:
    return sink.write(np.array(x, np.int64).reshape(-1, 8, 1), 14, "RGGB", [10.0, 11.0, 12.0, 13.0], [4095], [2.0, 1.0, 1.6], [0, 1, 8, 4], np.eye(3), "Maker Model", tile)


@query(_SAMPLES)
def dng_pixels(spark, d):
    """Samples of lossless JPEG tiles, written and read again."""
    return exploded(dng.frames(files(spark, d, lambda x: _dng(x, 16))).filter("error is null"))


@query("SELECT vec_id AS path, '0/330.0' AS directory, CAST(8 AS INTEGER) AS width, CAST(len(embedding) // 8 AS INTEGER) AS height, 'RGGB' AS pattern, 46.0::DOUBLE AS black, CAST(2 AS INTEGER) AS black_rows, 4095.0::DOUBLE AS white, 13.0::DOUBLE AS crop, 4.6::DOUBLE AS wb, 'Maker Model' AS model FROM embeddings WHERE embedding IS NOT NULL")
def dng_fields(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    f = dng.frames(files(spark, d, _dng)).filter("r = 0")
    return f.select(F.col("path").cast("long").alias("path"), "directory", "width", "height", "pattern", total("black").alias("black"), "black_rows", F.col("white")[0].alias("white"), total("crop").alias("crop"), F.round(total("wb"), 4).alias("wb"), "model")


@query("SELECT CASE vec_id % 4 WHEN 0 THEN 'mrw' WHEN 1 THEN 'dng' WHEN 2 THEN 'txt' ELSE 'mef' END AS kind, count(*) AS total, count(*) FILTER (vec_id % 4 < 2) AS done, CASE vec_id % 4 WHEN 2 THEN 'files of kind ''txt'' are not read' WHEN 3 THEN 'no directory holds tag 33422' END AS message FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL")
def convert_jobs(spark, d):
    """Good files of two kinds, one of an unknown kind and one damaged; no file stops the others."""
    kind = F.expr("CASE CAST(path AS LONG) % 4 WHEN 0 THEN 'mrw' WHEN 1 THEN 'dng' WHEN 2 THEN 'txt' ELSE 'mef' END")
    mixed = files(spark, d, WRITERS["mrw"]).filter("CAST(path AS LONG) % 4 <> 1").unionByName(files(spark, d, _dng).filter("CAST(path AS LONG) % 4 = 1"))
    mixed = mixed.withColumn("k", kind).select(F.concat_ws(".", "path", "k").alias("path"), F.when(F.col("k").isin("mrw", "dng"), F.col("content")).otherwise(F.lit(b"II*\0")).alias("content"))
    jobs = convert.to_dng(mixed, tile=16).withColumn("kind", F.substring_index("path", ".", -1))
    return jobs.groupBy("kind").agg(F.count("*").alias("total"), F.count_if("ok").alias("done"), F.max("message").alias("message"))


@query(_SAMPLES)
def converted_pixels(spark, d):
    """Files of another kind, converted to DNG and read again."""
    made = convert.to_dng(files(spark, d, WRITERS["ari"]), tile=16).select(F.regexp_replace("path", r"\..*", "").alias("path"), "content")
    return exploded(dng.frames(made).filter("error is null"))
