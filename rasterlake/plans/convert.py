"""Conversion of raw files to DNG as a batch plan: one row in, one row out, whatever happens to a file."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterlake.sinks import dng as sink
from rasterlake.sources import dng, vendor

#: Bytes of files in one batch on its way to Spark, and files.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024
SCHEMA = "path string, output string, ok boolean, message string, content binary"


def one(path: str, content: bytes, cameras: dict[int, vendor.Camera], pattern: str = "RGGB", tile: int = 256) -> bytes:
    """The DNG of one file: by leading bytes or extension, else by its size, which names a camera."""
    end = path.rpartition(".")[2].lower()
    if content[:4] == b"\0MRM":
        got = vendor.mrw(content)
    elif content[:4] == b"ARRI":
        got = vendor.ari(content)
    elif end == "dng":
        got = dng.image(content)
    elif end in vendor.READERS and end != "naked":
        got = vendor.READERS[end](content)
    elif len(content) in cameras:
        got = vendor.naked(content, cameras[len(content)])
    else:
        raise ValueError(f"files of kind {end!r} are not read")
    x = got["samples"]
    x = x if x.ndim == 3 else x[:, :, None]
    depth = 16
    white = [int(v) for v in got.get("white") or [max(1, int(x.max()))] * x.shape[2]]
    wb = [v for v in (got.get("wb") or [])[:3] if v and np.isfinite(v)]
    crop = [int(v) for v in got["crop"]] if got.get("crop") else None
    return sink.write(x, depth, got.get("pattern") or (pattern if x.shape[2] == 1 else ""), [float(v) for v in got.get("black") or [0.0]], white, wb if len(wb) == 3 else None, crop, model=got.get("model") or "unknown", tile=tile)


def to_dng(files: DataFrame, cameras: dict[int, vendor.Camera] | None = None, tile: int = 256) -> DataFrame:
    """path, output, ok, message and content (the DNG, or null) of files (path, content); a file that fails does not stop the others."""
    known = cameras or {}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "output", "ok", "message", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one file's bytes at a time
                path, content, done, message = path.as_py(), content.as_py(), None, None
                try:
                    done = one(path or "", content or b"", known, tile=tile)
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                    message = str(e) or type(e).__name__
                rows.append((path, re.sub(r"\.[^./]*$", "", path or "") + ".dng", done is not None, message, done))
                held += len(done or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
