"""DNG files: a small preview in the first directory, the raw samples below it, and a camera's levels and colours."""

from __future__ import annotations

import struct

import numpy as np

from rasterlake.functions import bits

#: Struct letters and bytes of the TIFF types that are written.
LETTERS = {1: "B", 3: "H", 4: "I", 5: "I", 7: "B", 10: "i"}
#: Version 1.6 of the format, readable from 1.1 on.
VERSION, BACKWARD = (1, 6, 0, 0), (1, 1, 0, 0)


def _entry(tag: int, kind: int, values) -> tuple[int, int, int, bytes]:
    raw = values.encode("latin-1", "replace") + b"\0" if kind == 2 else struct.pack("<" + LETTERS[kind] * len(values), *map(int, values))
    return tag, kind, len(raw) if kind == 2 else len(values) // (2 if kind in (5, 10) else 1), raw


def directory(entries: list[tuple[int, int, int, bytes]], at: int, following: int = 0) -> bytes:
    """A directory that begins at a place, with the values that do not fit its entries behind it."""
    entries = sorted(entries)
    head, more, after = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in entries:
        head += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", after + len(more)))
        more += raw + bytes(len(raw) % 2) if len(raw) > 4 else b""
    return head + struct.pack("<I", following) + more


def rationals(values, denominator: int = 10_000) -> list[int]:
    return [x for v in values for x in (round(v * denominator), denominator)]


def write(samples: np.ndarray, depth: int, pattern: str, black: list[float], white: list[int], wb: list[float] | None = None, crop: list[int] | None = None, matrix: np.ndarray | None = None, model: str = "unknown", tile: int = 0, orientation: int = 1) -> bytes:
    """samples: height x width x channels, stored as lossless JPEG tiles (of a multiple of 16) or as one plain 16-bit strip.

    black: levels of the repeating pattern (1, or as many as its letters); wb: red, green, blue; crop: x, y, width, height.
    """
    h, w, n = samples.shape
    side = int(len(pattern) ** 0.5) if pattern else 0
    preview = samples[:: max(1, h // 64), :: max(1, w // 64), 0].astype(float)
    preview = np.clip(preview / max(1, max(white)) * 255, 0, 255).astype(np.uint8)
    if tile:
        padded = np.pad(samples, ((0, -h % tile), (0, -w % tile), (0, 0)), "edge")
        parts = [bits.ljpeg_encode(padded[r : r + tile, c : c + tile], depth) for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        parts = [samples.astype("<u2").tobytes()]
    body, places = preview.tobytes(), []
    body += bytes(len(body) % 2)
    for p in parts:
        places.append(8 + len(body))
        body += p + bytes(len(p) % 2)
    stored = [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, [len(p) for p in parts])] if tile else [(273, 4, places), (278, 4, [h]), (279, 4, [len(parts[0])])]
    raw = [(254, 4, [0]), (256, 4, [w]), (257, 4, [h]), (258, 3, [depth if tile else 16] * n), (259, 3, [7 if tile else 1]), (262, 3, [32803 if pattern else 34892]), (277, 3, [n]), (284, 3, [1]), *stored, (50714, 5, rationals(black)), (50717, 4, white)]
    if pattern:
        raw += [(33421, 3, [side, side]), (33422, 1, ["RGBCMYW".index(x) for x in pattern]), (50713, 3, [side, side] if len(black) > 1 else [1, 1])]
    if crop:
        raw += [(50719, 4, crop[:2]), (50720, 4, crop[2:])]
    at = 8 + len(body)
    below = directory([_entry(*e) for e in raw], at)
    root = [(254, 4, [1]), (256, 4, [preview.shape[1]]), (257, 4, [preview.shape[0]]), (258, 3, [8]), (259, 3, [1]), (262, 3, [1]), (273, 4, [8]), (274, 3, [orientation]), (277, 3, [1]), (278, 4, [preview.shape[0]]), (279, 4, [preview.size]), (330, 4, [at]), (50706, 1, VERSION), (50707, 1, BACKWARD), (50708, 2, model)]
    if wb:
        root.append((50728, 5, rationals([1 / x for x in wb], 1_000_000)))
    if matrix is not None:
        root += [(50721, 10, rationals(np.asarray(matrix).ravel())), (50778, 3, [21])]
    start = at + len(below)
    return struct.pack("<2sHI", b"II", 42, start) + body + below + directory([_entry(*e) for e in root], start)
