"""Reference-table lookups: exact, missing, ordered fallback, keyed unions and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(facts: DataFrame, dim: DataFrame, on: Column) -> DataFrame:
    """Inner equi-join; Spark broadcasts the table only if its size is under the session's limit."""
    return facts.join(dim, on)


def missing(facts: DataFrame, dim: DataFrame, on: Column) -> DataFrame:
    """Facts without a reference row."""
    return facts.join(dim, on, "left_anti")


def resolve(facts: DataFrame, key: str, candidates: list[DataFrame], value: str) -> DataFrame:
    """First rule that gives exactly one distinct value for a key; candidates: (key, value) by rule, in order."""
    out = facts
    names = []
    for i, c in enumerate(candidates):
        one = c.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(f"v{i}")).filter("n = 1").drop("n")
        out = out.join(one, key, "left")
        names.append(f"v{i}")
    rule = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(i + 1)) for i, n in enumerate(names)))
    return out.withColumn(value, F.coalesce(*names)).withColumn("rule", rule).drop(*names)


def last_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key, the last by order: an aggregation, so that no key is sorted in one place."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def merge(left: DataFrame, right: DataFrame, key: str, value: str, override: bool = False) -> DataFrame:
    """Full merge by key: the left value stays, or with override the right one replaces it."""
    a, b = left.select(key, F.col(value).alias("a")), right.select(key, F.col(value).alias("b"))
    return a.join(b, key, "full").select(key, (F.coalesce("b", "a") if override else F.coalesce("a", "b")).alias(value))


def catalogue(rows: DataFrame, group: str, model: str) -> DataFrame:
    """Models of each group, sorted and joined, with their number."""
    return rows.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(model)), ", ").alias("models"), F.count_distinct(model).alias("n_models"))


def rollup(rows: DataFrame, make: str, model: str) -> DataFrame:
    """Counts by make and model, with totals."""
    return rows.rollup(make, model).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def overlay(base: DataFrame, modes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Base rows, and a row per mode that replaces only the columns that it sets."""
    m = modes.select(*key, "mode", *(F.col(c).alias(f"m_{c}") for c in columns))
    joined = base.join(m, key).select(*key, "mode", *(F.coalesce(f"m_{c}", c).alias(c) for c in columns))
    return base.select(*key, F.lit("").alias("mode"), *columns).unionByName(joined)


def summary(jobs: DataFrame, group: str, ok: Column, order: str, message: str) -> DataFrame:
    """Totals, successes, failures and the first failure's message."""
    return jobs.groupBy(group).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"), F.min_by(F.when(~ok, F.col(message)), F.when(~ok, F.col(order))).alias("first_error"))


def unclaimed(wanted: DataFrame, claimed: DataFrame, name: str) -> DataFrame:
    """Each wanted name once, without those that are claimed."""
    return wanted.select(name).distinct().join(claimed.select(name), name, "left_anti")


def markdown(rows: DataFrame, group: str, text: str) -> DataFrame:
    """Adds line, a table row with the group padded to the widest, in order of the groups."""
    width = rows.agg(F.max(F.length(group)).alias("width"))
    padded = F.concat(F.lit("|"), F.rpad(F.col(group), F.col("width"), F.lit(" ")), F.lit(" | "), F.col(text), F.lit(" |"))
    return rows.crossJoin(F.broadcast(width)).withColumn("line", padded).drop("width").orderBy(group)


#: Ends of ranges that meet in one task.
RUN = 16_384


def _levels(points: DataFrame, refs: DataFrame, open: bool) -> tuple[DataFrame, DataFrame]:
    """Points and references with lv, bl: blocks of levels, so that a point shares one block with each reference whose least it reaches, and none with others.

    The levels below a point's are cut into blocks by the bits of their number; a reference is in the block of each size that has its level. Block -1 has all.
    """
    seen = refs.select(F.col("least").alias("level"), F.lit(1).alias("is")).unionByName(points.select(F.col("most").alias("level"), F.lit(0).alias("is")))
    seen = seen.filter("level is not null").groupBy("level").agg(F.max("is").alias("is"))
    ranks = seen.select("level", F.sum("is").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)).alias("rank"))
    first = F.lit(1 if open else 0)  # an open reference has a level below all others
    top = refs.agg((F.floor(F.log2(F.count_distinct("least") + 1)) + 1).cast("int").alias("top"))
    p = points.join(ranks, F.col("most") == F.col("level"), "left").withColumn("p", F.coalesce(F.col("rank") + first, F.lit(0)))
    own = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda j: F.col("p").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), j)) != 0)
    p = p.withColumn("lv", F.explode(F.when(F.col("most").isNull(), F.array(F.lit(-1))).otherwise(own)))
    p = p.withColumn("bl", F.when(F.col("lv") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(p, lv)") - 1)).drop("level", "rank", "p")
    r = refs.join(ranks, F.col("least") == F.col("level"), "left").withColumn("r", F.coalesce(F.col("rank") - 1 + first, F.lit(0))).crossJoin(F.broadcast(top))
    every = F.array(F.lit(-1))
    sizes = F.sequence(F.lit(-1), F.col("top"))
    r = r.withColumn("lv", F.explode(sizes if open else F.when(F.col("least").isNull(), every).otherwise(sizes)))
    r = r.withColumn("bl", F.when(F.col("lv") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(r, lv)"))).drop("level", "rank", "r", "top")
    asked = p.select("key", "lv", "bl").distinct()
    return p, r.join(asked, ["key", "lv", "bl"], "left_semi")


def fits(facts: DataFrame, refs: DataFrame, open: bool, leveled: bool) -> DataFrame:
    """facts with n, the references of their key that fit, and x, that reference if n is 1 (else of no meaning).

    facts: key, at and, if leveled, most; a null at or most fits everything. refs: key, low, high, x (long) and, if leveled, least; null bounds are open, or if
    not ``open`` fit a null only. No pairs are made: ends of ranges are sorted within their key and counted up, with an exclusive or of x beside the count, and
    each different point takes the last end before it. Runs of ends, with the points between them, are dealt to tasks.
    """
    asked = ["at", "most"] if leveled else ["at"]
    points = facts.filter("key is not null").select("key", *asked).distinct()
    p, r = _levels(points, refs, open) if leveled else (points, refs)
    keys = ["key", "lv", "bl"] if leveled else ["key"]
    whole = r.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"))
    free = p.filter("at is null").join(whole, keys).select("key", *asked, "n", "x")
    bounded = r.filter("low <= high" if not open else "low is null or high is null or low <= high")
    end = lambda side, after, n: bounded.select(*keys, F.col(side).alias("v"), F.lit(after).alias("after"), F.lit(n).cast("long").alias("n"), "x")
    ends = end("low", 0, 1).unionByName(end("high", 2, -1).filter("v is not null")).groupBy(*keys, "v", "after").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))
    order = Window.partitionBy(*keys).orderBy("v", "after")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(*keys, "v", "after", F.sum("n").over(upto).alias("n"), F.bit_xor("x").over(upto).alias("x"), (F.row_number().over(order) - 1).alias("i"))
    place = lambda v, after: F.struct(v.alias("v"), after.alias("after"))
    starts = ends.filter(F.col("i") % RUN == 0).groupBy(*keys).agg(F.sort_array(F.collect_list(place(F.col("v"), F.col("after")))).alias("starts"))
    p = p.filter("at is not null").join(F.broadcast(starts), keys)  # one start for RUN ends
    p = p.withColumn("run", F.size(F.filter("starts", lambda s: (s["v"].isNull()) | (s["v"] < F.col("at")) | ((s["v"] == F.col("at")) & (s["after"] == 0)))) - 1).filter("run >= 0")
    p = p.select(*keys, "run", F.col("at").alias("v"), F.lit(1).alias("after"), *asked)
    both = p.unionByName(ends.select(*keys, F.floor(F.col("i") / RUN).cast("int").alias("run"), "v", "after", "n", "x"), allowMissingColumns=True).repartition(*keys, "run")
    last = Window.partitionBy(*keys, "run").orderBy("v", "after").rowsBetween(Window.unboundedPreceding, 0)
    held = both.select("key", *asked, "after", F.last("n", True).over(last).alias("n"), F.last("x", True).over(last).alias("x")).filter("after = 1").drop("after")
    got = free.unionByName(held).groupBy("key", *asked).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))
    got = got.select(F.col("key").alias("k"), *(F.col(c).alias(f"p_{c}") for c in asked), F.col("n").alias("_n"), F.col("x").alias("_x"))
    on = F.col("key") == F.col("k")
    for c in asked:
        on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return facts.join(got, on, "left").withColumns({"n": F.coalesce("_n", F.lit(0)), "x": F.col("_x")}).drop("k", "_n", "_x", *(f"p_{c}" for c in asked))


def only_fit(facts: DataFrame, refs: DataFrame, fact_id: str, value: str, open: bool, leveled: bool) -> DataFrame:
    """fact_id, value of the only reference that fits, as in fits() (refs: value, of any type, for x); null if none or several do. Nulls are no values."""
    kind = dict(refs.dtypes)[value]
    r, whole = refs.filter(F.col(value).isNotNull() & F.col("key").isNotNull()), kind in ("tinyint", "smallint", "int", "bigint")
    numbers = r.select(value).distinct().select(value, F.row_number().over(Window.orderBy(value)).cast("long").alias("x"))
    r = r.withColumn("x", F.col(value).cast("long")).drop(value) if whole else r.join(numbers, value).drop(value)
    found = fits(facts, r, open, leveled).groupBy(fact_id).agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") == 1, F.col("x"))).alias("x"))
    found = found.select(fact_id, F.when(F.col("n") == 1, F.col("x")).alias("x"))
    return found.select(fact_id, F.col("x").cast(kind).alias(value)) if whole else found.join(numbers, "x", "left").select(fact_id, value)


def unique_in_range(facts: DataFrame, dim: DataFrame, fact_id: str, group: str, at: str, low: str, high: str, value: str, least: tuple[str, str] | None = None) -> DataFrame:
    """fact_id, value of the only reference row of the fact's group whose range holds ``at``; null if none or several do.

    least: (fact column, reference column) that the fact must reach. A null in the fact is a wildcard, a null bound is open.
    """
    d = dim.select(F.col(group).alias("key"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(value).alias("value"), *([F.col(least[1]).alias("least")] if least else []))
    f = facts.select(fact_id, F.col(group).alias("key"), F.col(at).alias("at"), *([F.col(least[0]).alias("most")] if least else []))
    return only_fit(f, d, fact_id, "value", True, bool(least)).withColumnRenamed("value", value)


def retried(facts: DataFrame, dim: DataFrame, key: str, patched: Column, value: str) -> DataFrame:
    """The value of the key, else that of the patched key; dim has one row a key."""
    a = dim.select(F.col(key).alias("k1"), F.col(value).alias("v1"))
    b = dim.select(F.col(key).alias("k2"), F.col(value).alias("v2"))
    f = facts.withColumn("patched", patched)
    f = f.join(a, F.col(key) == F.col("k1"), "left").join(b, F.col("v1").isNull() & (F.col("patched") == F.col("k2")), "left")
    return f.withColumn(value, F.coalesce("v1", "v2")).drop("k1", "k2", "v1", "v2", "patched")


#: File extensions of raw images.
EXTENSIONS = ("ARI", "ARW", "CR2", "CR3", "CRM", "CRW", "DCR", "DCS", "DNG", "ERF", "IIQ", "KDC", "MEF", "MOS", "MRW", "NEF", "NRW", "ORF", "ORI", "PEF", "RAF", "RAW", "RW2", "RWL", "SRW", "3FR", "FFF", "X3F", "QTK")


def supported(path: Column) -> Column:
    """Whether the last extension of a path is one of raw images, in any case; false for null and for none."""
    return F.coalesce(F.upper(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS), F.lit(False))


def frames(files: DataFrame, stem: str, count: str) -> DataFrame:
    """One row per frame (from 0), with its output's name: the stem alone, or with four digits if there are several frames."""
    f = files.filter(F.col(count) > 0).withColumn("frame", F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))))
    return f.withColumn("output", F.when(F.col(count) == 1, F.col(stem)).otherwise(F.format_string("%s_%04d", F.col(stem), F.col("frame"))))
