"""DNG files: the raw directory, its levels, areas and colours, and its samples, linearised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import containers

#: Tags of DNG and TIFF that are read.
SUBFILE, WIDTH, HEIGHT, DEPTH, PHOTOMETRIC, CHANNELS, MODEL = 254, 256, 257, 258, 262, 277, 50708
PATTERN_SIZE, PATTERN, TABLE, BLACK_SIZE, BLACK, WHITE, CROP_AT, CROP, NEUTRAL, WHITE_XY, ACTIVE = 33421, 33422, 50712, 50713, 50714, 50717, 50719, 50720, 50728, 50729, 50829
#: Photometric codes of one grey channel, a colour pattern, and linear channels.
GREY, MOSAIC, LINEAR = 1, 32803, 34892


def directories(content: bytes) -> dict[str, dict[int, tuple]]:
    out: dict[str, dict[int, tuple]] = {}
    for t in containers.tags(content):
        out.setdefault(t[0], {})[t[1]] = t
    return out


def _pairs(t: tuple | None) -> list[float] | None:
    """Values of an entry; rationals (two numbers each) are divided out."""
    if t is None or t[4] is None:
        return None
    v = t[4]
    return [a / b if b else float("nan") for a, b in zip(v[::2], v[1::2], strict=True)] if t[2] in (5, 10) else list(v)


def raw_directory(dirs: dict[str, dict[int, tuple]]) -> str:
    """The first directory that is a full image (subfile type 0) of a pattern, linear channels or grey."""
    for name, d in dirs.items():
        kind = int((_pairs(d.get(PHOTOMETRIC)) or [0])[0])
        if SUBFILE in d and not d[SUBFILE][4][0] and kind in (GREY, MOSAIC, LINEAR) and WIDTH in d:
            return name
    raise ValueError("dng: no raw directory")


def image(content: bytes) -> dict:
    """samples (height x width x channels, or height x width for one channel) after the linearisation table, levels, areas and colours."""
    dirs = directories(content)
    name = raw_directory(dirs)
    d, root = dirs[name], dirs.get("0", {})
    get = lambda tag: _pairs(d.get(tag))
    samples = containers.tiff_image(content, name)
    n, depth, table = samples.shape[2], int(get(DEPTH)[0]), get(TABLE)
    if table:
        lut = np.array(table, np.int64)
        samples = lut[np.minimum(samples, len(lut) - 1)]
    size = [int(x) for x in get(BLACK_SIZE) or [1, 1]]
    rows, cols = size if len(size) == 2 else (1, 1)  # some files hold one number
    white = get(WHITE) or [float((1 << depth) - 1)] * n
    crop, at, active = get(CROP), get(CROP_AT), get(ACTIVE)
    return {
        "samples": samples[:, :, 0] if n == 1 else samples, "directory": name, "width": samples.shape[1], "height": samples.shape[0], "channels": n, "bits": depth, "kind": int(get(PHOTOMETRIC)[0]),
        "pattern": "".join("RGBCMYW"[int(x)] for x in get(PATTERN) or []), "black": get(BLACK) or [0.0], "black_rows": rows, "black_cols": cols, "white": white * n if len(white) == 1 and n > 1 else white,
        "crop": [*(at or [0.0, 0.0]), *crop] if crop else None, "active": [active[1], active[0], active[3] - active[1], active[2] - active[0]] if active else None,
        "wb": [1 / x if x else float("inf") for x in _pairs(root.get(NEUTRAL)) or []] or None, "white_xy": _pairs(root.get(WHITE_XY)), "model": root[MODEL][5] if MODEL in root else None,
    }


FIELDS = {"directory": "string", "width": "int", "height": "int", "channels": "int", "bits": "int", "kind": "int", "pattern": "string", "black": "array<double>", "black_rows": "int", "black_cols": "int", "white": "array<double>", "crop": "array<double>", "active": "array<double>", "wb": "array<double>", "white_xy": "array<double>", "model": "string"}
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}


#: Samples of one batch on its way to Spark, and rows: neither many small files nor a large one are held at once.
BATCH_SAMPLES, BATCH_ROWS = 1 << 19, 4096


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: path, r, samples, fields (or None), error."""
    path, r, vs, fields, error = zip(*rows, strict=True)
    flat = pa.array(np.concatenate([v for v in vs if v is not None] or [np.zeros(0, np.int64)])).cast(pa.int64())
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in vs)])
    lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([v is None for v in vs]))
    own = [pa.array([None if f is None else f[k] for f in fields], _TYPES[t]) for k, t in FIELDS.items()]
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(r, pa.int64()), lines, *own, pa.array(error, pa.string())], ["path", "r", "vs", *FIELDS, "error"])


def frames(files: DataFrame) -> DataFrame:
    """One row per line of files (path, content): path, r, vs (its samples), and the file's fields on line 0 only; no shuffle.

    A file that cannot be read gives one row with its error.
    """

    def lines(batch: pa.RecordBatch) -> Iterator[tuple]:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            try:
                got = image(content.as_py())
                samples = got.pop("samples").reshape(got["height"], -1)
            except (ValueError, KeyError, IndexError, TypeError) as e:
                yield path.as_py(), None, None, None, str(e) or type(e).__name__
                continue
            for r, v in enumerate(samples):
                yield path.as_py(), r, v, None if r else got, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, samples = [], 0
        for batch in batches:
            for row in lines(batch):
                rows.append(row)
                samples += 0 if row[2] is None else len(row[2])
                if samples >= BATCH_SAMPLES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, samples = [], 0
        if rows:
            yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, "path string, r long, vs array<long>, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()) + ", error string")
