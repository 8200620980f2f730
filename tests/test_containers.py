"""Codecs, containers and writers: round trips, plain versions and damaged input."""

import numpy as np
import pytest

from rasterlake.functions import bits
from rasterlake.sinks import images
from rasterlake.sources import containers

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("order", bits.ORDERS)
@pytest.mark.parametrize("depth", [1, 10, 12, 14, 16])
def test_packed(order, depth):
    x = RNG.integers(0, 1 << depth, (5, 16))
    assert (bits.unpack(bits.pack(x, depth, order), depth, order, 16, 5) == x).all()


def test_packed_by_hand():
    assert bits.unpack(b"\x12\x34\x56", 12, "msb", 2, 1).tolist() == [[0x123, 0x456]]
    assert bits.unpack(b"\x12\x34\x56", 12, "lsb", 2, 1).tolist() == [[0x412, 0x563]]
    assert bits.unpack(b"\x12\x34\x56\x00\xab\xcd\xef", 12, "msb", 2, 2, 4).tolist() == [[0x123, 0x456], [0xABC, 0xDEF]]
    assert bits.unpack(b"\xff", 8, "msb", 2, 1).tolist() == [[255, 0]]


def test_floats():
    codes = np.arange(65536)
    assert np.array_equal(bits.widen(codes, 5, 10), codes.astype(np.uint16).view(np.float16).astype(float), equal_nan=True)
    x = RNG.normal(size=(6, 8, 3)).astype(np.float32)
    for step in (1, 2, 4):
        assert (bits.inflate_floats(bits.deflate_floats(x, 32, step), 8, 6, 3, 32, step) == x).all()


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg(predictor):
    for x in (RNG.integers(0, 65536, (7, 9, 2)), RNG.integers(500, 520, (4, 5, 1)), np.zeros((1, 1, 1), int), np.array([[0, 32768, 0, 65535]]).reshape(1, 4, 1)):
        assert (bits.ljpeg_decode(bits.ljpeg_encode(x, 16, predictor)) == x).all()
    with pytest.raises(ValueError):
        bits.ljpeg_decode(bits.ljpeg_encode(RNG.integers(0, 65536, (9, 9, 1)), 16)[:60])


def test_tiff(spark):
    x = RNG.integers(0, 65536, (70, 50, 3))
    for made in (images.tiff(x), images.tiff(x, rows=16), images.tiff(x, tile=32), images.tiff(x[..., :1], tile=32, lossless=True)):
        got = containers.tiff_image(made)
        assert (got == x[..., : got.shape[2]]).all()
    y = RNG.normal(size=(9, 4, 1)).astype(np.float32)
    assert (containers.tiff_image(images.tiff(y)) == y).all()
    files = spark.createDataFrame([("a", bytearray(images.tiff(x))), ("b", bytearray(b"II*\0")), ("c", None), ("d", bytearray(images.tiff(x)[:-40]))], "path string, content binary")
    rows = containers.tiff_tags(files)
    assert {(r["tag"], *r["numbers"]) for r in rows.filter("path = 'a' and tag in (256, 257)").collect()} == {(256, 50.0), (257, 70.0)}
    assert rows.filter("path in ('b', 'c')").count() == 0
    assert [r["kind"] for r in files.select(containers.kind(files.content).alias("kind")).collect()] == ["tiff", "tiff", None, "tiff"]


def test_boxes(spark):
    box = lambda name, data: (len(data) + 8).to_bytes(4, "big") + name + data
    content = box(b"ftyp", b"crx ") + box(b"moov", box(b"trak", box(b"tkhd", b"12")) + box(b"mvhd", b""))
    assert [b[0] for b in containers.boxes(content)] == ["/ftyp", "/moov", "/moov/trak", "/moov/mvhd", "/moov/trak/tkhd"]
    assert containers.boxes(content[:-1])[0][0] == "/ftyp" and containers.boxes(None) == []
    files = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray())], "path string, content binary")
    assert containers.iso_boxes(files).count() == 5 and files.select(containers.kind(files.content).alias("k")).first()["k"] == "crx"


def test_pnm_and_originals():
    assert images.pnm(np.array([[[1], [515]]])) == b"P5 2 1 65535\n\x00\x01\x02\x03"
    for n in (0, 1, 65536, 200_001):
        x = RNG.bytes(n)
        assert images.extract(*images.embed(x)) == x
    with pytest.raises(ValueError):
        images.extract(images.embed(b"abc")[0], b"x" * 16)
