"""Image operators beyond SQL, and the package without its optional part."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterlake.functions import colour
from rasterlake.operators import grid, layouts, levels, lookup, lossless, rules
from rasterlake.plans import convert, develop
from rasterlake.sinks import dng
from rasterlake.sources import dng as dng_source
from rasterlake.sources import files
from rasterlake.streaming import ingest


def plane(spark, a):
    return spark.createDataFrame([(int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(a)], "r long, c long, v double")


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x["r"], x["c"]] = x[name]
    return out


def test_rotate(spark):
    a = np.arange(12.0).reshape(3, 4)
    for turns, want in (("90cw", np.rot90(a, -1)), ("90ccw", np.rot90(a)), ("180", a[::-1, ::-1]), ("transpose", a.T)):
        assert (dense(grid.rotate(plane(spark, a), 3, 4, turns), "v", want.shape) == want).all()


def test_code_lengths():
    got = lossless.code_lengths({0: 10, 1: 5, 2: 1, 3: 0})
    assert set(got) == {0, 1, 2} and sum(2.0**-n for n in got.values()) < 1


def test_levels_and_colour(spark):
    a = np.random.default_rng(0).random((8, 10))
    px = plane(spark, a)
    black = {r["phase"]: r["level"] for r in levels.black_levels(px).collect()}
    assert abs(black[1] - a[::2, 1::2].mean()) < 1e-12
    assert np.allclose(colour.normalize_rows(np.array([[1.0, 1], [1, -1]])), [[0.5, 0.5], [0, 0]])
    assert develop.develop(px, 1.0, 8, 10, np.eye(3), crop=(2, 2, 4, 4)).count() == 16


def by_gradients(v):
    """Red, green and blue of an RGGB mosaic, by loops over samples."""
    h, w = v.shape
    kind = lambda y, x: 1 if (y + x) % 2 else 0 if y % 2 == 0 else 2
    out = np.zeros((h, w, 3))
    inner = [(y, x) for y in range(3, h - 3) for x in range(3, w - 3)]
    for y, x in np.ndindex(h, w):
        near = [(b, a) for b in range(max(y - 1, 0), min(y + 2, h)) for a in range(max(x - 1, 0), min(x + 2, w))]
        for k in range(3):
            out[y, x, k] = v[y, x] if k == kind(y, x) else np.mean([v[p] for p in near if kind(*p) == k])
    g = out[:, :, 1]
    for y, x in inner:
        if kind(y, x) != 1:
            tries = []
            for dy, dx in ((-1, 0), (0, 1), (0, -1), (1, 0)):
                near, back, far = v[y + dy, x + dx], v[y - dy, x - dx], v[y + 2 * dy, x + 2 * dx]
                tries.append((2 * abs(v[y, x] - far) + abs(near - back), (3 * near + back + v[y, x] - far) / 4))
            g[y, x] = min(tries, key=lambda t: t[0])[1]

    def transit(a, m, b):
        l1, l2, l3 = g[a], g[m], g[b]
        return v[a] + (v[b] - v[a]) * (l2 - l1) / (l3 - l1) if l1 < l2 < l3 or l1 > l2 > l3 else (v[a] + v[b]) / 2 + (2 * l2 - l1 - l3) / 4

    for y, x in inner:
        k = kind(y, x)
        if k == 1:
            out[y, x, kind(y, x + 1)] = transit((y, x - 1), (y, x), (y, x + 1))
            out[y, x, kind(y + 1, x)] = transit((y - 1, x), (y, x), (y + 1, x))
        else:
            slope = []
            for dx in (1, -1):
                a, b = (y - 1, x + dx), (y + 1, x - dx)
                slope.append((abs(v[a] - v[b]) + abs(v[y - 2, x + 2 * dx] - v[y, x]) + abs(v[y, x] - v[y + 2, x - 2 * dx]) + abs(g[a] - g[y, x]) + abs(g[y, x] - g[b]), a, b))
            _, a, b = slope[0] if slope[0][0] < slope[1][0] else slope[1]
            out[y, x, 2 - k] = transit(a, (y, x), b)
    return out


def test_develop_reconstructs_by_gradients(spark):
    a = np.random.default_rng(1).random((13, 12))
    a[5:9, 4:8] = np.add.outer(np.arange(4), np.arange(4)) / 8
    got, want = develop.develop(plane(spark, a), 1.0, 13, 12, np.eye(3), steps={"demosaic"}), by_gradients(a)
    assert got.count() == a.size
    for k, name in enumerate(("red", "green", "blue")):
        assert np.allclose(dense(got, name, a.shape), want[:, :, k], rtol=0, atol=1e-12)


def test_overlay_and_names(spark):
    base = spark.createDataFrame([("m", 1, 2)], "make string, a int, b int")
    modes = spark.createDataFrame([("m", "raw", None, 5)], "make string, mode string, a int, b int")
    assert {tuple(r) for r in lookup.overlay(base, modes, ["make"], ["a", "b"]).collect()} == {("m", "", 1, 2), ("m", "raw", 1, 5)}
    wanted = [(1, "x", 1), (2, "x_1", 1), (3, "x", 1), (4, "y", 2), (5, "y", 2), (6, "y_1_0001", 1), (7, "x", 1), (8, "x_1", 1)]
    names = spark.createDataFrame(wanted, "i int, stem string, n int")
    got = {}
    for r in rules.free_names(names, "stem", "i", "n").orderBy("i", "frame").collect():
        got.setdefault(r["i"], []).append(r["output"])
    assert got == {1: ["x"], 2: ["x_1"], 3: ["x_2"], 4: ["y_0000", "y_0001"], 5: ["y_1_0000", "y_1_0001"], 6: ["y_1_0001_1"], 7: ["x_3"], 8: ["x_1_1"]}
    assert not rules.free_names(names.limit(0), "stem", "i").count()


def claimed_names(wanted):
    """Every row's names, looked for from the bare stem on; by at, then stem, then frames."""
    taken, out = set(), []
    for at, stem, n in sorted(wanted):
        k, names = 0, None
        while names is None or not taken.isdisjoint(names):
            base = f"{stem}_{k}" if k else stem
            names, k = [base] if n == 1 else [f"{base}_{i:04d}" for i in range(n)], k + 1
        taken.update(names)
        out += [(at, stem, i, x) for i, x in enumerate(names)]
    return sorted(out)


def test_names_that_could_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    stems = ["x", "x_1", "x_1_2", "x_1_2_3_4", "x_7_8_9", "y", "y_0001", "y_1_0000", "z", "_1", "w_5", "w_5_0001_0002_2"]
    wanted = [(i, stems[int(s)], int(n)) for i, (s, n) in enumerate(zip(rng.integers(0, len(stems), 600), rng.choice([1, 1, 1, 2, 3, 0], 600), strict=True))]
    wanted += [(1000 + i, "many", 1002 if i == 3 else 1) for i in range(1005)]
    rows = spark.createDataFrame(wanted, "i long, stem string, n int")
    names = lambda: sorted((r["i"], r["stem"], r["frame"], r["output"]) for r in rules.free_names(rows, "stem", "i", "n").collect())
    assert names() == claimed_names(wanted)
    monkeypatch.setattr(rules, "SLICE_ROWS", 10)
    monkeypatch.setattr(rules, "FEW", 2)
    assert names() == claimed_names(wanted)


def test_many_of_one_name(spark, monkeypatch):
    n = 30_000
    monkeypatch.setattr(rules, "SLICE_ROWS", 5_000)
    got = rules.free_names(spark.range(n).select(F.lit("x").alias("stem"), F.expr("(id * 7919) % 30000 div 2").alias("at")), "stem", "at")
    assert got.count() == got.select("output").distinct().count() == n
    number = F.coalesce(F.regexp_extract("output", r"_(\d+)$", 1).try_cast("long"), F.lit(0))
    assert not got.filter(F.floor(number / 2) != F.col("at")).count()


class Step:
    """Stands for a table: gives the function that would run in Python."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_files_pass_in_small_batches(monkeypatch):
    monkeypatch.setattr(dng_source, "BATCH_SAMPLES", 1000)
    monkeypatch.setattr(dng_source, "BATCH_ROWS", 30)
    monkeypatch.setattr(convert, "BATCH_BYTES", 1 << 14)
    image = np.arange(50 * 60, dtype=np.int64).reshape(50, 60, 1)
    small = dng.write(image[:3, :2], 16, "RGGB", [2], [4000], model="m")
    contents = [dng.write(image, 16, "RGGB", [2], [4000], model="m"), b"no image", None, *[small] * 200]
    given = pa.RecordBatch.from_arrays([pa.array([f"{i}.dng" for i in range(len(contents))]), pa.array(contents, pa.binary())], ["path", "content"])
    out = list(dng_source.frames(Step())(iter([given])))
    assert all(b.num_rows <= 30 and sum(map(len, filter(None, b.column(2).to_pylist()))) <= 1060 for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["vs"] for r in rows[:50]] == image[:, :, 0].tolist() and [r["r"] for r in rows[:50]] == list(range(50))
    assert rows[0]["width"] == 60 and rows[0]["model"] == "m" and rows[1]["width"] is None and len(rows) == 50 + 2 + 600
    assert all(r["error"] and r["vs"] is None and r["r"] is None for r in rows[50:52]) and not any(r["error"] for r in rows[52:])
    jobs = list(convert.to_dng(Step(), tile=16)(iter([given])))
    assert len(jobs) > 5 and max(b.nbytes for b in jobs[1:]) < 1 << 15
    assert [r["ok"] for b in jobs for r in b.to_pylist()] == [True, False, False, *[True] * 200]


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.CR2").write_bytes(b"1")
    (tmp_path / "in/b.txt").write_bytes(b"2")
    image = np.arange(48, dtype=np.int64).reshape(6, 8, 1)
    (tmp_path / "in/c.DNG").write_bytes(dng.write(image, 14, "RGGB", [2], [1000], model="m"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), convert.to_dng)
    got = {r["path"].rpartition("/")[2]: (r["kind"], r["ok"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).select("path", "kind", "ok", "content").collect()}
    assert {k: v[:2] for k, v in got.items()} == {"a.CR2": ("converted", False), "b.txt": ("original", True), "c.DNG": ("converted", True)}
    assert bytes(got["b.txt"][2]) == b"2" and got["a.CR2"][2] is None
    assert (dng_source.image(bytes(got["c.DNG"][2]))["samples"] == image[:, :, 0]).all()


def test_folders_and_toml_tables(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.toml").write_text('[[cameras]]\nmodel = "x"\n[[cameras]]\nmodel = "y"\n')
    (tmp_path / "b/c.toml").write_text('[[cameras]]\nmodel = "z"\n[[lenses]]\nname = "l"\n')
    (tmp_path / "b/d.NEF").write_bytes(b"1")
    assert [r["row"] for r in files.toml_tables(spark, str(tmp_path), "cameras").collect()] == ['{"model": "x"}', '{"model": "y"}', '{"model": "z"}']
    assert [r["path"][-5:] for r in files.scan(spark, str(tmp_path)).collect()] == ["d.NEF"]
    assert files.scan(spark, str(tmp_path), only_supported=False).count() == 3 and not files.scan(spark, str(tmp_path), recursive=False).count()


def test_taken_at(spark):
    rows = [("2024:02:29 12:00:00", 2, "+05:00"), ("2024:02:29 12:00:00", None, "-01:30"), ("2024:02:29 12:00:00", None, None), ("29.2.2024", 1, None), (None, None, "")]
    df = spark.createDataFrame(rows, "t string, h int, o string")
    got = [r["s"] for r in df.select(F.date_format(layouts.taken_at(df.t, df.h, df.o), "HH:mm").alias("s")).collect()]
    assert got == ["10:00", "13:30", "12:00", None, None]
