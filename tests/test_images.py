"""Stencils in tiles, images told apart by an id, and blocks of coded files, against loops and edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import bits, ciphers
from rasterlake.operators import demosaic, grid, levels, lossless
from rasterlake.plans import develop
from rasterlake.sinks import images
from rasterlake.sources import blocks, containers, segments

from .test_operators import by_gradients, dense, plane


def stack(spark, planes):
    rows = [(k, int(r), int(c), float(v)) for k, a in planes.items() for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id string, r long, c long, v double")


def test_neighbours_beyond_tiles(spark):
    a = np.random.default_rng(2).random((grid.TILE + 9, grid.TILE * 2 + 5))
    got = grid.neighbours(plane(spark, a), {"nw": (-2, -3), "e": (0, 1)})
    want = np.full_like(a, np.nan)
    want[2:, 3:] = a[:-2, :-3]
    assert np.array_equal(dense(got, "v", a.shape), a) and got.count() == a.size
    found = {(x["r"], x["c"]): x["nw"] for x in got.collect()}
    assert all((v is None and np.isnan(want[at])) or v == want[at] for at, v in found.items())
    with pytest.raises(ValueError):
        grid.neighbours(plane(spark, a), {"far": (0, grid.TILE)})


def test_neighbours_of_odd_rows(spark):
    rows = [("x", 0, 0, 1.0), ("x", 0, 0, 5.0), ("x", 0, 1, None), ("x", None, 2, 7.0), (None, 0, 0, 2.0), (None, 0, 1, 3.0), ("y", -1, 0, 4.0), ("y", 0, 0, 6.0)]
    px = spark.createDataFrame(rows, "image_id string, r long, c long, v double")
    got = {(x["image_id"], x["r"], x["c"]): (x["v"], x["e"], x["n"]) for x in grid.neighbours(px, {"e": (0, 1), "n": (-1, 0)}).collect()}
    assert got == {("x", 0, 0): (5.0, None, None), (None, 0, 0): (2.0, 3.0, None), (None, 0, 1): (3.0, None, None), ("y", -1, 0): (4.0, None, None), ("y", 0, 0): (6.0, None, 4.0)}
    assert not grid.neighbours(px.limit(0), {"e": (0, 1)}).count()
    extra = grid.neighbours(px.withColumn("e", px.v).withColumn("tile_r", px.v), {"e": (0, 1)})
    assert extra.columns == ["image_id", "r", "c", "v", "e"] and extra.count() == 5


def test_images_do_not_see_each_other(spark):
    rng = np.random.default_rng(3)
    planes = {"a": rng.random((13, 12)), "b": rng.random((13, 12))}
    got = develop.develop(stack(spark, planes), 1.0, 13, 12, np.eye(3), steps={"demosaic"}).cache()
    for k, a in planes.items():
        one = got.filter(got.image_id == k)
        for i, name in enumerate(("red", "green", "blue")):
            assert np.allclose(dense(one, name, a.shape), by_gradients(a)[:, :, i], rtol=0, atol=1e-12)
    black = levels.masked_black(stack(spark, planes), [(0, 0, 2, 13)])
    assert {(x["image_id"], x["phase"]): round(x["level"], 12) for x in black.collect()} == {(k, p): round(a[p // 2 :: 2, p % 2 : 2 : 2].mean(), 12) for k, a in planes.items() for p in range(4)}
    classes = lossless.histogram_by_component(lossless.residuals(grid.integers(stack(spark, planes)), 1), 2)
    assert {tuple(x) for x in classes.groupBy("image_id").sum("n").collect()} == {("a", 156), ("b", 156)}


def test_other_phases(spark):
    """Each pattern is RGGB seen from one line or one sample further on; away from edges both give the same colours."""
    a = np.random.default_rng(4).random((18, 18))
    want = by_gradients(a)
    for pattern, (dr, dc) in demosaic.AHEAD.items():
        part = a[dr : dr + 17, dc : dc + 17]
        got = demosaic.ppg(plane(spark, part), 17, 17, pattern).cache()
        for k, name in enumerate(("red", "green", "blue")):
            assert np.allclose(dense(got, name, part.shape)[5:12, 5:12], want[dr + 5 : dr + 12, dc + 5 : dc + 12, k], rtol=0, atol=1e-12)


def test_wide_patterns(spark):
    a, pattern = np.random.default_rng(5).random((7, 8)), [[0, 1, 1], [1, 2, 1], [1, 1, 0]]
    got = develop.develop(plane(spark, a), 1.0, 7, 8, np.eye(3), steps={"demosaic"}, pattern=pattern)
    for k, name in enumerate(("red", "green", "blue")):
        for (r, c), v in np.ndenumerate(dense(got, name, a.shape)):
            near = [a[y, x] for y in range(max(r - 2, 0), min(r + 3, 7)) for x in range(max(c - 2, 0), min(c + 3, 8)) if pattern[y % 3][x % 3] == k]
            assert abs(v - np.mean(near)) < 1e-12


def test_chroma_lines(spark):
    a = np.arange(40, dtype=float).reshape(8, 5) ** 2
    want = a.copy()
    for r in (1, 4):
        want[r] = (a[r - 1] + a[r + 1] + 1) // 2
    assert np.array_equal(dense(demosaic.chroma_lines(plane(spark, a).selectExpr("r", "c", "cast(v as long) v")), "v", a.shape), want)


def test_files_of_developed_images(spark):
    rgb = spark.createDataFrame([(1, 0, 0, 0.5, -1.0, 2.0), (1, 1, 2, None, 1.0, 0.25), (2, 0, 0, 1.0, 0.0, 0.0)], "image_id int, r long, c long, red double, green double, blue double")
    got = {x["image_id"]: containers.tiff_image(bytes(x["content"])) for x in images.developed(rgb).collect()}
    assert got[1].shape == (2, 3, 3) and got[1][0, 0].tolist() == [32767, 0, 65535] and got[1][1, 2].tolist() == [0, 65535, 16383] and got[1][0, 1].tolist() == [0, 0, 0]
    assert got[2].tolist() == [[[65535, 0, 0]]]
    assert not images.developed(rgb.limit(0)).count()
    px = spark.createDataFrame([(7, 0, 1, 258), (7, 0, 0, 1)], "image_id long, r long, c long, v long")
    assert [tuple(x) for x in images.digests(px).collect()] == [(7, hashlib.md5(b"\x01\x00\x02\x01").hexdigest())]


def test_blocks(spark):
    files = spark.createDataFrame([("a", bytearray(range(7))), ("b", bytearray()), ("c", None), ("d", bytearray(b"\x09"))], "path string, content binary")
    codec = lambda part, line: np.frombuffer(part, np.uint8).astype(np.int64).reshape(-1, 2) + 100 * line
    got = sorted(tuple(x) for x in blocks.decoded(blocks.dealt(blocks.strips(files, 2, 2, start=1)), codec).collect())
    assert got == [("a", 0, 0, 1), ("a", 0, 1, 2), ("a", 1, 0, 3), ("a", 1, 1, 4), ("a", 2, 0, 205), ("a", 2, 1, 206)]
    assert sorted((x["path"], x["line"], bytes(x["part"])) for x in blocks.chunks(files, 5).collect()) == [("a", 0, bytes(range(5))), ("a", 1, b"\x05\x06"), ("d", 0, b"\x09")]
    assert not blocks.tiff_blocks(files).count()
    samples = np.random.default_rng(6).integers(0, 60000, (21, 19, 3))
    tiled = spark.createDataFrame([("t", bytearray(images.tiff(samples, tile=16, lossless=True))), ("s", bytearray(images.tiff(samples, rows=4)))], "path string, content binary")
    out = np.zeros((2, *samples.shape), np.int64)
    for x in blocks.tiff_samples(blocks.dealt(blocks.tiff_blocks(tiled))).collect():
        out["st".index(x["path"]), x["r"], x["c"], x["channel"]] = x["v"]
    assert (out == samples).all()


def units(y, cb, cr, tall, two_lines):
    """Differences of a subsampled frame in the order of its code, by the definition of each sample's predecessor."""
    h, w = y.shape
    out = []
    for r in range(0, h, tall):
        for c in range(0, w, 2):
            places = [(r + i, c + j) for i in range(tall) for j in (0, 1)]
            above = y[r - tall, 0] if r else 2048
            for k, (i, j) in enumerate(places):
                if two_lines and k:
                    before = y[r, 0] if (i, j) == (r + 1, 0) else y[i, j - 1]
                elif two_lines:
                    before = y[r, c - 1] if c else above
                else:
                    before = y[places[k - 1]] if k else y[r + tall - 1, c - 1] if c else above
                out.append(y[i, j] - before)
            for x in (cb, cr):
                out.append(x[r // tall, c // 2] - (x[r // tall, c // 2 - 1] if c else x[r // tall - 1, 0] if r else 2048))
    return out


def coded(diffs, h, w, sampling):
    """A lossless JPEG with one table of 17 codes of five bits."""
    stream = "".join(f"{abs(int(d)).bit_length():05b}" + (f"{int(d) if d > 0 else int(d) + (1 << abs(int(d)).bit_length()) - 1:0{abs(int(d)).bit_length()}b}" if d else "") for d in diffs)
    stream += "1" * (-len(stream) % 8)
    body = bytes(int(stream[i : i + 8], 2) for i in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")
    segment = lambda marker, x: bytes([255, marker]) + (len(x) + 2).to_bytes(2, "big") + x
    frame = bytes([12]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, sampling, 0, 2, 17, 0, 3, 17, 0])
    table = bytes([0, 0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17))
    return b"\xff\xd8" + segment(0xC3, frame) + segment(0xC4, table) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 1, 0, 0])) + body + b"\xff\xd9"


@pytest.mark.parametrize("tall,two_lines", [(1, False), (2, False), (2, True)])
def test_subsampled_frames(tall, two_lines):
    rng = np.random.default_rng(7)
    y, cb, cr = rng.integers(0, 4096, (6, 8)), rng.integers(0, 4096, (6 // tall, 4)), rng.integers(0, 4096, (6 // tall, 4))
    got = bits.ljpeg_decode(coded(units(y, cb, cr, tall, two_lines), 6, 8, 0x20 + tall), two_lines)
    assert (got[:, :, 0] == y).all()
    for k, x in ((1, cb), (2, cr)):
        assert all(got[r, c, k] == x[r // tall, c // 2] for r in range(6) for c in range(8))


def test_ciphers(spark):
    data = np.random.default_rng(8).integers(0, 256, 1003, np.uint8).tobytes()
    pad, key = [0] * 128, 123456789
    for p in range(127):
        if p < 4:
            key = (key * 48828125 + 1) % 2**32
            pad[p] = key if p < 3 else (key * 2) % 2**32 | (pad[0] ^ pad[2]) >> 31
        else:
            pad[p] = ((pad[p - 4] ^ pad[p - 2]) * 2) % 2**32 | (pad[p - 3] ^ pad[p - 1]) >> 31
    ring = [int.from_bytes(x.to_bytes(4, "big"), "little") for x in pad[:127]]
    want = b""
    for i in range(0, 1000, 4):
        ring.append(ring[-127] ^ ring[-63])
        want += (int.from_bytes(data[i : i + 4], "little") ^ ring[-1]).to_bytes(4, "little")
    assert ciphers.by_words(data, 123456789) == want and ciphers.by_words(want, 123456789) == data[:1000] and ciphers.by_words(b"abc", 1) == b""
    assert ciphers.serial_number("12a\x009") == 127 and ciphers.serial_number("") == 0
    rows, grown, step = [], 0xA7, 0xC1
    for i in range(1300):
        grown += step * (0x60 + i)
        rows.append((i, i % 256, (i % 256) ^ (grown & 255)))
    df = spark.createDataFrame(rows, "i long, plain long, coded long")
    assert not df.filter(ciphers.by_steps(df.coded, df.i, F.lit(0xC1), F.lit(0xA7)) != df.plain).count()


def test_positions(spark):
    names = "path string, directory string, tag int, type int, count long, numbers array<double>, text string, raw binary"
    rows = [("a", "0/34853.0", 2, 5, 3, [48.0, 1.0, 30.0, 2.0, 5.0, 0.0], None, b""), ("a", "0/34853.0", 1, 2, 2, None, "N", b"N\0"), ("a", "0/34853.0", 27, 7, 2, None, None, b"xy"), ("a", "0", 2, 5, 1, [1.0, 1.0], None, b""), ("b", "0", 1, 2, 2, None, "S", b""), ("c", "0/34853.0", 5, 1, 1, [1.0], None, b"\1")]
    got = {x["path"]: x for x in segments.position_records(spark.createDataFrame(rows, names)).collect()}
    assert set(got) == {"a", "c"} and got["a"]["latitude"] == [48.0, 15.0, None] and got["a"]["latitude_ref"] == "N" and bytes(got["a"]["processing_method"]) == b"xy"
    assert got["a"]["longitude"] is None and got["c"]["altitude_ref"] == [1.0]
