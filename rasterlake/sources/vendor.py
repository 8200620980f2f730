"""Raw files whose samples are packed or lossless JPEG: where the samples lie and in which layout, by kind of file.

A reader gives a dictionary: samples (height x width), and what the file says of wb, black and white. Files that are too short,
or that lack an entry, raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from rasterlake.functions import bits

from . import containers, segments


def _words(kind: str, shift: int = 0, mask: int = 0xFFFF) -> Callable:
    return lambda data, w, h: (np.frombuffer(data, kind, w * h).astype(np.int64) >> shift & mask).reshape(h, w)


def _bits(n: int, order: str, row_bytes: Callable[[int], int] = lambda w: 0) -> Callable:
    return lambda data, w, h: bits.unpack(data, n, order, w, h, row_bytes(w))


#: Layouts by name: (bits a sample, reader). Names are those of operators.rules.
LAYOUTS: dict[str, tuple[float, Callable[[bytes, int, int], np.ndarray]]] = {
    "8bit": (8, _words("u1")), "16le": (16, _words("<u2")), "16be": (16, _words(">u2")),
    "12le": (12, _bits(12, "lsb")), "12be": (12, _bits(12, "msb")), "12be_msb16": (12, _bits(12, "msb16")), "12be_msb32": (12, _bits(12, "msb32")),
    "10le_lsb16": (10, _bits(10, "msb16")), "14le": (14, _bits(14, "lsb")), "14be": (14, _bits(14, "msb")),
    "12le_unpacked": (16, _words("<u2", 0, 0xFFF)), "12be_unpacked": (16, _words(">u2", 0, 0xFFF)), "14le_unpacked": (16, _words("<u2", 0, 0x3FFF)), "14be_unpacked": (16, _words(">u2", 0, 0x3FFF)),
    "12le_left_aligned": (16, _words("<u2", 4)), "12be_left_aligned": (16, _words(">u2", 4)),
    "12le_16bitaligned": (12, _bits(12, "msb", lambda w: (w * 12 // 8 + 1) // 2 * 2)),
    "12le_control": (12, lambda data, w, h: segments.unpack_controlled(data, "lsb", w, h)), "12be_control": (12, lambda data, w, h: segments.unpack_controlled(data, "msb", w, h)),
    "12be_interlaced": (12, lambda data, w, h: segments.unpack_fields(data, w, h)), "12be_interlaced_unaligned": (12, lambda data, w, h: segments.unpack_fields(data, w, h, 1)),
}


def decode(layout: str, data: bytes, width: int, height: int) -> np.ndarray:
    """height x width samples; an error if the data are too short."""
    size, read = LAYOUTS[layout]
    if not 0 < width <= 65535 or not 0 < height <= 65535 or 8 * len(data) < size * width * height:
        raise ValueError(f"{layout}: {len(data)} bytes do not hold {width} x {height} samples")
    return read(data, width, height)


@dataclass(frozen=True)
class Camera:
    """What a camera table knows of a file that does not say so itself."""

    width: int = 0
    height: int = 0
    filesize: int = 0
    hints: frozenset[str] = field(default_factory=frozenset)


def ari(data: bytes, camera: Camera = Camera()) -> dict:
    """Fixed places: offset 8, width 20, height 24, balance 100 (three floats), all little-endian."""
    if len(data) < 112:
        raise ValueError("ari: no header")
    at, (w, h) = struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<II", data, 20)
    return {"samples": decode("12le" if "little-endian" in camera.hints else "12be_msb32", data[at:], w, h), "wb": list(struct.unpack_from("<3f", data, 100))}


def mrw(data: bytes, camera: Camera = Camera()) -> dict:
    """Blocks of tag and length, big-endian. PRD holds the size (at 16) and the kind of packing (at 24), WBG the balance (at 12)."""
    if len(data) < 8:
        raise ValueError("mrw: no header")
    end, at, w, h, packed, wb = struct.unpack_from(">I", data, 4)[0] + 8, 8, 0, 0, False, [0] * 4
    while at + 20 < min(end, len(data)):
        tag, size = data[at + 1 : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        if tag == b"PRD":
            h, w = struct.unpack_from(">HH", data, at + 16)
            packed = data[at + 24] == 12
        elif tag == b"WBG":
            wb = list(struct.unpack_from(">4H", data, at + 12))
        at += size + 8
    wb = [wb[2], wb[0], wb[0], wb[1]] if "swapped_wb" in camera.hints else wb
    return {"samples": decode("12be" if packed else "12be_unpacked", data[end:], w, h), "wb": [float(x) for x in wb]}


def naked(data: bytes, camera: Camera) -> dict:
    """Samples alone; the camera is known by the file's size."""
    n = camera.filesize * 8 // max(1, camera.width * camera.height)
    layout = "12le_16bitaligned" if "12le_16bitaligned" in camera.hints else {10: "10le_lsb16", 12: "12be_msb16"}.get(n)
    if layout is None:
        raise ValueError(f"naked: {n} bits a sample are not known")
    return {"samples": decode(layout, data, camera.width, camera.height)}


def _directory(data: bytes, wanted: int) -> dict[int, list[float]]:
    """Numbers of the first directory that holds the wanted tag, by tag."""
    all_tags = containers.tags(data)
    name = next((t[0] for t in all_tags if t[1] == wanted), None)
    if name is None:
        raise ValueError(f"no directory holds tag {wanted}")
    return {t[1]: t[4] for t in all_tags if t[0] == name and t[4]}


def _strips(layout: str, wanted: int) -> Callable:
    def read(data: bytes, camera: Camera = Camera()) -> dict:
        d = _directory(data, wanted)
        if not {256, 257, 273} <= d.keys():
            raise ValueError("no size or place of the samples")
        return {"samples": decode(layout, data[int(d[273][0]) :], int(d[256][0]), int(d[257][0])), "white": d.get(50717), "black": d.get(50714, [None])[:1] if 50714 in d else None}

    return read


#: Packed samples at the first strip of the directory with a colour pattern (33422).
mef, erf = _strips("12be", 33422), _strips("12be_control", 33422)


def tfr(data: bytes, camera: Camera = Camera()) -> dict:
    """The directory with a white level (50717): 16-bit samples under the hint, else lossless JPEG over the whole frame."""
    if "uncompressed" in camera.hints:
        return _strips("16le", 50717)(data)
    d = _directory(data, 50717)
    w, h = int(d[256][0]), int(d[257][0])
    got = bits.ljpeg_decode(data[int(d[273][0]) :]).reshape(h, w)
    return {"samples": got, "white": d[50717], "black": d.get(50714)}



READERS: dict[str, Callable] = {"ari": ari, "mrw": mrw, "mef": mef, "erf": erf, "3fr": tfr, "fff": tfr, "naked": naked}
