"""Curves and sensor rules against plain versions, with empty tables and edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import curves, grid, lookup, rules, sensor


@pytest.mark.parametrize("seed", [0, 1, 65536, curves.MODULUS, 2 * curves.MODULUS, (1 << 32) - 1, *random.Random(1).sample(range(1 << 32), 6)])
def test_dither_state(spark, seed):
    want, x = [], seed
    for _ in range(40):
        want.append(x)
        x = 15700 * (x & 65535) + (x >> 16)
    places = spark.createDataFrame([(c, pow(curves.MULTIPLIER, c, curves.MODULUS)) for c in range(40)], "c long, p long")
    got = places.orderBy("c").select(curves.dither_state(F.lit(seed).cast("long"), F.col("c"), F.col("p")).alias("x"))
    assert [r["x"] for r in got.collect()] == want


def test_spline():
    points = [(0, 0), (10, 30), (25, 35), (60, 100)]
    s = curves.spline(points)
    at = lambda k, t, n: [s[k][1] + t * (s[k][2] + t * (s[k][3] + t * s[k][4])), s[k][2] + t * (2 * s[k][3] + 3 * t * s[k][4]), 2 * s[k][3] + 6 * t * s[k][4]][n]
    for k, ((x, y), (x2, y2)) in enumerate(zip(points, points[1:], strict=False)):
        assert at(k, 0, 0) == pytest.approx(y) and at(k, x2 - x, 0) == pytest.approx(y2)
        if k:
            gap = x - points[k - 1][0]
            assert at(k - 1, gap, 1) == pytest.approx(at(k, 0, 1)) and at(k - 1, gap, 2) == pytest.approx(at(k, 0, 2))
    assert at(0, 0, 2) == pytest.approx(0) and at(2, 35, 2) == pytest.approx(0)


def test_empty(spark):
    px = spark.createDataFrame([], "r long, c long, v long")
    curve = spark.createDataFrame([(0, 0), (1, 5)], "x long, y long")
    gains = spark.createDataFrame([], "gy long, gx long, gain double")
    for out in (curves.dithered(px, curve, 4), curves.flat_field(px, gains, 0, 0, 4, 4), sensor.bad_columns(px, [1], 4), sensor.low_bits(px, px), curves.quadrant_curves(px, [[[(0, 0), (65535, 65535)]] * 2] * 2, 1, 1)):
        assert not out.count()
    assert not curves.from_knots(spark.createDataFrame([], "i long, y long"), 4).count()
    one = spark.createDataFrame([(0, 0, 7)], "r long, c long, v long")
    assert curves.flat_field(one, gains, 0, 0, 4, 4).first()["v"] == 7


def test_cut(spark):
    x = spark.createDataFrame([(-1.7,), (-70000.0,), (1.7,), (70000.0,), (None,)], "x double")
    assert [r[0] for r in x.select(curves.cut(F.col("x"), -5, 65535)).collect()] == [-1, -5, 1, 65535, None]


def test_byte_ranges(spark):
    parts = spark.createDataFrame([(1, 0, 8, 4), (1, 1, 12, 4), (2, 0, 8, 4), (2, 1, 13, 1)], "f long, i long, at long, n long")
    assert sorted(map(tuple, sensor.byte_ranges(parts, "f", "i", "at", "n").collect())) == [(1, 8, 8), (2, 8, 4), (2, 13, 1)]


def test_nearest(spark):
    px = spark.createDataFrame([(r, c, 100 * r + c) for r in range(11) for c in range(7)], "r long, c long, v long")
    for th, tw in ((11, 7), (4, 3), (1, 1), (10, 2)):
        got = {(r["r"], r["c"]): r["v"] for r in grid.nearest(px, 11, 7, th, tw).collect()}
        assert got == {(i, j): 100 * ((2 * i + 1) * 11 // (2 * th)) + (2 * j + 1) * 7 // (2 * tw) for i in range(th) for j in range(tw)}
    assert grid.fitted(3000, 4000, 768, 1024) == (768, 1024) and grid.fitted(5, 4, 768, 1024) == (5, 4)


def test_unique_in_range(spark):
    dim = spark.createDataFrame([("m", 10, 20, 2.0, "a"), ("m", 15, None, 4.0, "b"), ("k", 1, 9, None, "c")], "g string, low int, high int, f double, name string")
    facts = spark.createDataFrame([(1, "m", 12, 2.8), (2, "m", 18, 5.0), (3, "m", 18, 3.0), (4, "k", None, None), (5, "x", 5, 1.0), (6, None, 5, 1.0)], "id int, g string, at int, stop double")
    got = {r["id"]: r["name"] for r in lookup.unique_in_range(facts, dim, "id", "g", "at", "low", "high", "name", ("stop", "f")).collect()}
    assert got == {1: "a", 2: None, 3: "a", 4: "c", 5: None, 6: None}


def ranges(rng, n):
    """Rows of ranges (g, low, high, f, id) and facts (id, g, at, stop) with equal bounds, empty ranges, nulls and zeros of both signs."""
    some = lambda values, share=0.1: None if rng.random() < share else values[rng.integers(len(values))]
    at, stops = [-0.0, 0.0, *map(float, range(-60, 60))], [1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0]
    dim = []
    for i in range(n):
        low = some(at)
        dim.append((some(["m", "k", "n"]), low, None if rng.random() < 0.1 else (low or 0.0) + float(rng.integers(-1, 9)), some(stops), i))
    return dim, [(i, some(["m", "k", "x", "n"]), some(at), some([1.0, 3.0, *stops])) for i in range(400)]


def test_ranges_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(lookup, "RUN", 7)
    dim, facts = ranges(np.random.default_rng(3), 60)
    d = spark.createDataFrame([(*x[:4], f"v{x[4]}", x[4] if x[4] % 9 else None) for x in dim], "g string, low double, high double, f double, name string, code int")
    f = spark.createDataFrame([*facts, (1, "m", 3.0, 4.0)], "id int, g string, at double, stop double")

    def fit(x, stop):
        return [r for r in dim if x[1] is not None and x[1] == r[0] and (x[2] is None or ((r[1] is None or x[2] >= r[1]) and (r[2] is None or x[2] <= r[2]))) and (not stop or x[3] is None or r[3] is None or x[3] >= r[3])]

    for value, stop in (("name", True), ("name", False), ("code", True), ("code", False)):
        want = {}
        for x in [*facts, (1, "m", 3.0, 4.0)]:
            want.setdefault(x[0], []).extend(v for r in fit(x, stop) if (v := f"v{r[4]}" if value == "name" else r[4] if r[4] % 9 else None) is not None)
        out = lookup.unique_in_range(f, d, "id", "g", "at", "low", "high", value, ("stop", "f") if stop else None)
        assert dict(out.dtypes)[value] == dict(d.dtypes)[value] and out.count() == len(want)
        assert {r["id"]: r[value] for r in out.collect()} == {k: v[0] if len(v) == 1 else None for k, v in want.items()}


def test_many_in_range_make_no_pairs(spark):
    """Every range holds every place: 400 million pairs."""
    d = spark.range(20_000).select(F.col("id").alias("v"), F.lit(1).alias("g"), F.lit(0).alias("low"), F.lit(9).alias("high"), (F.col("id") % 5).alias("f"))
    f = spark.range(20_000).select("id", F.lit(1).alias("g"), (F.col("id") % 12).alias("at"), F.when(F.col("id") % 2 == 0, F.lit(3)).alias("stop"))
    refs, facts = d.select(F.col("g").alias("key"), "low", "high", F.col("v").alias("x"), F.col("f").alias("least")), f.select(F.col("g").alias("key"), "at", F.col("stop").alias("most"))
    got = lookup.fits(facts, refs, True, True).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in got} == {20_000: 8334, 16_000: 8334, 0: 3332}


def test_lens_without_pairs(spark):
    rng = np.random.default_rng(4)
    some = lambda values, share=0.2: None if rng.random() < share else values[rng.integers(len(values))]
    lenses = [(i, some(["a", "b", ""], 0.9), some([1, 2, 3], 0.9), None, some([0, 1]), some([7, 8, 9]), some([10.0, 20.0, 30.0]), some([20.0, 35.0, 50.0]), some([1.4, 2.8, 4.0, 5.6])) for i in range(40)]
    images = [(i, some(["a", "b", "c", ""], 0.8), some([1, 2, 9], 0.8), None, some([0, 1, 2]), some([7, 8, 9]), some([10.0, 15.0, 20.0, 35.0, 60.0]), some([1.0, 1.4, 3.0, 4.0, 8.0])) for i in range(600)]
    cols = "key_name string, code_a int, code_b int, mount int, make int, "
    out = rules.lens(spark.createDataFrame(images, f"image_id int, {cols}focal double, aperture double"), spark.createDataFrame(lenses, f"lens_id int, {cols}focal_min double, focal_max double, aperture_min double"))
    want = {}
    for i in images:
        first = next((x[0] for k in (1, 2) for x in lenses if i[k] not in (None, "") and x[k] == i[k]), None)
        fit = [x[0] for x in lenses if (i[4] is None or i[4] == x[4]) and (i[5] is None or i[5] == x[5]) and (i[6] is None or (x[6] is not None and x[7] is not None and x[6] <= i[6] <= x[7])) and (i[7] is None or (x[8] is not None and i[7] >= x[8]))]
        want[i[0]] = first if first is not None else fit[0] if len(fit) == 1 else None
    assert sum(v is not None for v in want.values()) > 50
    assert out.count() == len(want) and {r["image_id"]: r["lens_id"] for r in out.collect()} == want
