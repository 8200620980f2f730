"""LZW, JPEG segments, CIFF heaps, line layouts and EXIF records: round trips, hand-made and damaged input."""

import numpy as np
import pytest

from rasterlake.functions import lzw
from rasterlake.sinks import images
from rasterlake.sources import containers, segments

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 5000, RNG.bytes(40_000), bytes(RNG.integers(0, 3, 100_000, np.uint8)), b"abc" * 7000])
def test_lzw(data):
    assert lzw.decode(lzw.encode(data)) == data


def test_lzw_by_hand():
    """Clear, 7, 258 (7 7), end: nine bits each."""
    code = "".join(f"{c:09b}" for c in (256, 7, 258, 257)).ljust(40, "0")
    assert lzw.decode(bytes(int(code[i : i + 8], 2) for i in range(0, 40, 8))) == b"\7\7\7"
    with pytest.raises(ValueError):
        lzw.decode(b"\x80\x3f\xff\xff")


def test_lzw_tiff():
    x = RNG.integers(0, 300, (70, 50, 3))
    assert (containers.tiff_image(images.tiff(x, rows=16, lzw=True)) == x).all()


@pytest.mark.parametrize("order", ["lsb", "msb"])
def test_controlled(order):
    x = RNG.integers(0, 4096, (7, 30))
    made = segments.pack_controlled(x, order, 99)
    assert len(made) == 7 * 48 and made[15] == 99
    assert (segments.unpack_controlled(made, order, 30, 7) == x).all()


@pytest.mark.parametrize("shape", [(1, 10), (7, 30), (300, 64)])
def test_fields(shape):
    x = RNG.integers(0, 4096, shape)
    for align in (1, 2048):
        assert (segments.unpack_fields(segments.pack_fields(x, align), shape[1], shape[0], align) == x).all()


def test_jpeg_segments():
    assert segments.jpeg_segments(None) == segments.jpeg_segments(b"") == segments.jpeg_segments(b"\xff\xe0\0\2") == []
    whole = b"\xff\xd8" + segments.segment(0xFFE1, segments.EXIF + b"II*\0") + segments.segment(0xFFDA, b"x") + b"rest"
    assert [(s[1], s[3], s[4]) for s in segments.jpeg_segments(whole)] == [("start", 0, None), ("app1", 10, "exif"), ("scan", 1, None)]
    assert segments.exif_of(whole) == b"II*\0" and segments.exif_of(b"\xff\xd8\xff\xd9") is None
    assert [s[1] for s in segments.jpeg_segments(whole[:8])] == ["start"]


def test_ciff():
    made = segments.ciff([(0x0805, b"text"), (0x5029, b"12345678"), (0x300A, [(0x2005, b"abc"), (0x2807, [])])])
    got = [(h, t, made[a : a + n]) for h, t, k, a, n in segments.ciff_entries(made) if k not in segments.HEAPS]
    assert got == [("", 0x0805, b"text"), ("", 0x1029, b"12345678"), ("/12298", 0x2005, b"abc")]
    assert segments.ciff_entries(None) == segments.ciff_entries(made[:20]) == []


def test_exif(spark):
    extra = ((271, 2, " Maker "), (33434, 5, [1, 250]), (37386, 5, [50, 0]), (34855, 3, [400]))
    files = spark.createDataFrame([("a", bytearray(images.tiff(np.zeros((2, 2, 1), int), extra=extra))), ("b", None)], "path string, content binary")
    got = [r.asDict() for r in segments.exif_records(containers.tiff_tags(files)).collect()]
    assert len(got) == 1 and (got[0]["make"], got[0]["exposure_time"], got[0]["focal_length"], got[0]["iso"], got[0]["flash"]) == ("Maker", 0.004, None, 400.0, None)
