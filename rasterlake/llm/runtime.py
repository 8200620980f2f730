"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a fixed-size membership bitmap: 2**23 bits are 1 MB, whatever the data.
BITMAP_BITS = 1 << 23
_PAGE = 32768  # bits of one page of Spark's bitmap_construct_agg


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset and the driver runs all tasks, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rasterlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Mark a written table for broadcast if it has no more rows than stated; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def bitmap(ids: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Membership bitmap of hashed ids: at most bits/32768 pages of 4 KB come to the driver, whatever the number of ids.

    A superset filter: a join must follow it. It only saves shuffling rows that cannot match.
    """
    pos = F.pmod(F.xxhash64(column), F.lit(bits))
    pages = (
        ids.select(pos.alias("p"))
        .groupBy(F.expr(f"p div {_PAGE}").alias("page"))
        .agg(F.expr(f"bitmap_construct_agg(p % {_PAGE})").alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for page, b in pages:
        out[page * _PAGE // 8 : page * _PAGE // 8 + len(b)] = np.frombuffer(b, np.uint8)
    return out


def in_bitmap(bitmap_broadcast, positions: np.ndarray) -> np.ndarray:
    """Boolean mask of positions (xxhash64 pmod bits) that are set."""
    b = bitmap_broadcast.value
    return (b[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def bitmap_position(column, bits: int = BITMAP_BITS):
    return F.pmod(F.xxhash64(column), F.lit(bits))


def tidy(step):
    """A batch step that, at the end of its task, gives freed memory back: idle Python workers stay alive beside later tasks."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def sum_arrays(parts: DataFrame, dtype: str, salts: int = 32) -> dict[int, np.ndarray]:
    """Element-wise sums of binary arrays by key, in two levels: by (key, salt), then by key. For a fixed number of keys."""
    import pyarrow as pa

    def add(t: pa.Table) -> pa.Table:
        total = None
        for b in t.column("vec"):
            x = np.frombuffer(b.as_buffer(), dtype)
            total = x.copy() if total is None else total + x
        return pa.table({"key": t.column("key")[:1], "salt": pa.array([0], pa.int32()), "vec": pa.array([total.tobytes()], pa.binary())})

    schema = "key int, salt int, vec binary"
    one = parts.select("key", F.expr(f"salt % {salts}").cast("int").alias("salt"), "vec").groupBy("key", "salt").applyInArrow(add, schema)
    return {r["key"]: np.frombuffer(r["vec"], dtype) for r in one.groupBy("key").applyInArrow(add, schema).select("key", "vec").collect()}


#: Keys that are broadcast; more are met by a bitmap in Python.
KEYS = 500_000


def hits(rows: DataFrame, wanted: DataFrame, key: list[str], n: int, keep: bool) -> DataFrame:
    """Rows whose key may be (keep) or certainly is not among the n wanted keys, by their broadcast or a bitmap of at most 16 MB; no shuffle.

    The bitmap's Python workers run beside those of the next step, and stay: each executor holds twice as many from then on.
    """
    import pyarrow as pa

    if n <= KEYS:
        return rows.join(F.broadcast(wanted.select(*key)), key, "left_semi" if keep else "left_anti").select(*(f"`{c}`" for c in rows.columns))
    bits = 1 << min(27, max(20, (16 * n).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(*key).alias("key")), "key", bits))

    def run(batches):
        for batch in batches:
            hit = in_bitmap(shared, np.asarray(batch.column("bitmap_pos"))) == keep
            if hit.any():
                yield batch.filter(pa.array(hit)).drop_columns(["bitmap_pos"])

    return rows.withColumn("bitmap_pos", bitmap_position(F.xxhash64(*key), bits)).mapInArrow(tidy(run), rows.schema)
