"""Lossless-prediction residuals, their size classes and code lengths."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import image, neighbours


def residuals(px: DataFrame, predictor: int, bits: int = 16) -> DataFrame:
    """Difference of each sample from its prediction (1 to 7), wrapped to 16 bits signed."""
    p = neighbours(px, {"a": (0, -1), "b": (-1, 0), "d": (-1, -1)})
    full = {1: "a", 2: "b", 3: "d", 4: "a + b - d", 5: "a + shiftright(b - d, 1)", 6: "b + shiftright(a - d, 1)", 7: "shiftright(a + b, 1)"}[predictor]
    guess = F.expr(f"case when r = 0 and c = 0 then {1 << (bits - 1)} when r = 0 then a when c = 0 then b else {full} end")
    return p.withColumn("g", guess).select(*image(px), "r", "c", F.expr("pmod(v - g + 32768, 65536) - 32768").cast("long").alias("diff"))


def size_class(diff: Column) -> Column:
    """Bits of the magnitude: 0 for 0, else floor(log2 |d|) + 1."""
    return F.when(diff == 0, 0).otherwise(F.length(F.bin(F.abs(diff)))).cast("int")


def histogram(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy(size_class(F.col("diff")).alias("ssss")).agg(F.count("*").alias("n"))


def histogram_by_component(diffs: DataFrame, components: int) -> DataFrame:
    """Size classes of each interleaved component: the samples of a line belong to them in turn."""
    component = F.pmod(F.col("c"), F.lit(components)).cast("int").alias("component")
    return diffs.groupBy(*image(diffs), component, size_class(F.col("diff")).alias("ssss")).agg(F.count("*").alias("n"))


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code length of each class, merging the two least frequent; a reserved least symbol keeps the all-ones code free."""
    heap = [(n, -k, [k]) for k, n in counts.items() if n] + [(0, 1, [])]
    length = dict.fromkeys(counts, 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        n1, t1, a = heapq.heappop(heap)
        n2, t2, b = heapq.heappop(heap)
        for k in a + b:
            length[k] += 1
        heapq.heappush(heap, (n1 + n2, min(t1, t2), a + b))
    return {k: v for k, v in length.items() if counts[k]}
