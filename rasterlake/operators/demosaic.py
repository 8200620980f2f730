"""Colour reconstruction of 2x2 mosaics in their four phases, and of wider ones, as neighbour expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import image, neighbours

CROSS = {"n1": (-1, 0), "n2": (-2, 0), "s1": (1, 0), "s2": (2, 0), "w1": (0, -1), "w2": (0, -2), "e1": (0, 1), "e2": (0, 2)}
RING = {"n1": (-1, 0), "s1": (1, 0), "w1": (0, -1), "e1": (0, 1), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}


#: Lines and samples by which each 2x2 pattern is ahead of RGGB.
AHEAD = {"RGGB": (0, 0), "GRBG": (0, 1), "GBRG": (1, 0), "BGGR": (1, 1)}


def is_green(pattern: str = "RGGB") -> Column:
    return F.pmod(F.col("r") + F.col("c") + sum(AHEAD[pattern]), F.lit(2)) == 1


def on_red_line(pattern: str = "RGGB") -> Column:
    return F.pmod(F.col("r") + AHEAD[pattern][0], F.lit(2)) == 0


def _mean(*names: str) -> Column:
    cols = [F.col(n) for n in names]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.when(count > 0, total / count)


def bilinear(px: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Red, green and blue of every sample of a 2x2 mosaic; missing ones are means of the neighbours that exist."""
    p, green_here, even = neighbours(px, RING), is_green(pattern), on_red_line(pattern)
    green = F.when(green_here, F.col("v")).otherwise(_mean("n1", "s1", "w1", "e1"))
    beside, above, corner = _mean("w1", "e1"), _mean("n1", "s1"), _mean("nw", "ne", "sw", "se")
    red = F.when(~green_here & even, F.col("v")).when(~green_here, corner).when(even, beside).otherwise(above)
    blue = F.when(~green_here & ~even, F.col("v")).when(~green_here, corner).when(even, above).otherwise(beside)
    return p.select(*image(px), "r", "c", red.alias("red"), green.alias("green"), blue.alias("blue"))


def region(px: DataFrame, x: int, y: int, w: int, h: int, pattern: str = "RGGB") -> DataFrame:
    """Colours of a rectangle alone, re-based to its corner: it is cut first, and keeps its place in the pattern until the end."""
    inside = px.filter(F.col("r").between(y, y + h - 1) & F.col("c").between(x, x + w - 1))
    return bilinear(inside, pattern).withColumns({"r": F.col("r") - y, "c": F.col("c") - x})


def ppg_green(px: DataFrame, height: int, width: int, pattern: str = "RGGB") -> DataFrame:
    """Green of samples three or more from the edge: the least gradient of north, east, west and south (ties in that order)."""
    p = neighbours(px, CROSS).filter(F.col("r").between(3, height - 4) & F.col("c").between(3, width - 4))
    x = F.col("v")
    grad, pick = {}, {}
    for name, near, far, back in (("n", "n1", "n2", "s1"), ("e", "e1", "e2", "w1"), ("w", "w1", "w2", "e1"), ("s", "s1", "s2", "n1")):
        grad[name] = F.abs(x - F.col(far)) * 2 + F.abs(F.col(near) - F.col(back))
        pick[name] = (F.col(near) * 3 + F.col(back) + x - F.col(far)) / 4
    least = F.least(*grad.values())
    best = F.when(grad["n"] == least, pick["n"]).when(grad["e"] == least, pick["e"]).when(grad["w"] == least, pick["w"]).otherwise(pick["s"])
    return p.select(*image(px), "r", "c", F.when(is_green(pattern), x).otherwise(best).alias("green"))


def border_means(px: DataFrame, height: int, width: int, pattern: str = "RGGB") -> DataFrame:
    """Samples less than three from the edge: mean of each colour of the pattern over the clamped 3x3; their own is kept."""
    strip = px.filter(~(F.col("r").between(4, height - 5) & F.col("c").between(4, width - 5)))
    p = neighbours(strip, RING).filter(~(F.col("r").between(3, height - 4) & F.col("c").between(3, width - 4)))
    beside, above, corner = ("w1", "e1"), ("n1", "s1"), ("nw", "ne", "sw", "se")
    v, green_here, even = F.col("v"), is_green(pattern), on_red_line(pattern)
    green = F.when(green_here, v).otherwise(_mean(*beside, *above))
    red = F.when(green_here & even, _mean(*beside)).when(green_here, _mean(*above)).when(even, v).otherwise(_mean(*corner))
    blue = F.when(green_here & even, _mean(*above)).when(green_here, _mean(*beside)).when(even, _mean(*corner)).otherwise(v)
    return p.select(*image(px), "r", "c", red.alias("red"), green.alias("green"), blue.alias("blue"))


def hue_transit(l1: Column, l2: Column, l3: Column, v1: Column, v3: Column) -> Column:
    """Value between v1 and v3 where the guide runs l1, l2, l3: linear if monotone, else the mean plus curvature."""
    monotone = ((l1 < l2) & (l2 < l3)) | ((l1 > l2) & (l2 > l3))
    return F.when(monotone, v1 + (v3 - v1) * (l2 - l1) / (l3 - l1)).otherwise((v1 + v3) / 2 + (l2 * 2 - l1 - l3) / 4)


def window_means(px: DataFrame, pattern: list[list[int]], radius: int = 2) -> DataFrame:
    """Mean of each colour over the clamped square around every sample, its own included. pattern: colours, repeating."""
    h, w = len(pattern), len(pattern[0])
    flat = F.array(*(F.lit(x) for row in pattern for x in row))
    near = {f"p{i}": (i // (2 * radius + 1) - radius, i % (2 * radius + 1) - radius) for i in range((2 * radius + 1) ** 2)}
    colour = lambda dr, dc: flat[(F.pmod(F.col("r") + dr, F.lit(h)) * w + F.pmod(F.col("c") + dc, F.lit(w))).cast("int")]
    seen = F.array(*(F.struct(colour(*at).alias("k"), F.col(n).alias("v")) for n, at in near.items()))
    p = neighbours(px, near).select(*image(px), "r", "c", F.filter(seen, lambda x: x["v"].isNotNull()).alias("seen"))

    def mean(k: int) -> Column:
        of = F.filter("seen", lambda x: x["k"] == k)
        return F.when(F.size(of) > 0, F.aggregate(of, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(of))

    return p.select(*image(px), "r", "c", *(mean(k).alias(n) for k, n in enumerate(("red", "green", "blue"))))


def chroma(px: DataFrame) -> DataFrame:
    """4:2:2 columns: odd ones are (left + right + 1) div 2, the last repeats its left."""
    p = neighbours(px, {"w1": (0, -1), "e1": (0, 1)})
    between = F.when(F.col("e1").isNull(), F.col("w1")).otherwise(F.expr("(w1 + e1 + 1) div 2"))
    return p.select(*image(px), "r", "c", F.when(F.pmod(F.col("c"), F.lit(2)) == 1, between).otherwise(F.col("v")).cast("long").alias("v"))


def chroma_lines(px: DataFrame) -> DataFrame:
    """4:2:0 lines, after the columns: the middle line of every three is (above + below + 1) div 2; others, and one without both, stay."""
    p = neighbours(px, {"n1": (-1, 0), "s1": (1, 0)})
    middle = F.when(F.pmod(F.col("r"), F.lit(3)) == 1, F.expr("(n1 + s1 + 1) div 2"))
    return p.select(*image(px), "r", "c", F.coalesce(middle, "v").cast("long").alias("v"))


def bilinear4(px: DataFrame) -> DataFrame:
    """Four channels of every sample, ch0 to ch3 by the phase of a 2x2 mosaic; missing ones are means of the neighbours that exist."""
    p = neighbours(px, RING)
    odd_r, odd_c = (F.pmod(F.col(x), F.lit(2)) for x in ("r", "c"))

    def channel(k: int) -> Column:
        line, column = odd_r == k // 2, odd_c == k % 2
        return F.when(line & column, F.col("v")).when(line, _mean("w1", "e1")).when(column, _mean("n1", "s1")).otherwise(_mean("nw", "ne", "sw", "se"))

    return p.select(*image(px), "r", "c", *(channel(k).alias(f"ch{k}") for k in range(4)))


DIAGONALS = RING | {"nw2": (-2, -2), "ne2": (-2, 2), "sw2": (2, -2), "se2": (2, 2)}


def ppg_red_blue(px: DataFrame, height: int, width: int, pattern: str = "RGGB") -> DataFrame:
    """Red and blue of a 2x2 mosaic (r, c, v) with a whole green plane g, three or more from the edge.

    At green samples both come from the neighbours beside and above. At red and blue samples the other one comes from the diagonal
    with the lesser gradient; north-west to south-east if they tie. A null sample or guide is a missing neighbour: null.
    """
    p = neighbours(px.select(*image(px), "r", "c", F.struct("v", "g").alias("v")), DIAGONALS).filter(F.col("r").between(3, height - 4) & F.col("c").between(3, width - 4))
    v, g = (lambda n: F.col(f"{n}.v")), (lambda n: F.col(f"{n}.g"))

    def between(a: str, b: str) -> Column:
        return hue_transit(g(a), g("v"), g(b), v(a), v(b))

    def gradient(a: str, b: str) -> Column:
        return F.abs(v(a) - v(b)) + F.abs(v(a + "2") - v("v")) + F.abs(v("v") - v(b + "2")) + F.abs(g(a) - g("v")) + F.abs(g("v") - g(b))

    other = F.when(gradient("ne", "sw") < gradient("nw", "se"), between("ne", "sw")).otherwise(between("nw", "se"))
    green_here, even = is_green(pattern), on_red_line(pattern)
    beside, above = between("w1", "e1"), between("n1", "s1")
    red = F.when(green_here & even, beside).when(green_here, above).when(even, v("v")).otherwise(other)
    blue = F.when(green_here & even, above).when(green_here, beside).when(even, other).otherwise(v("v"))
    return p.select(*image(px), "r", "c", red.alias("red"), blue.alias("blue"))


def ppg(px: DataFrame, height: int, width: int, pattern: str = "RGGB") -> DataFrame:
    """Red, green and blue of every sample of a 2x2 mosaic by gradients; means within three samples of the edge.

    The guide of red and blue is the whole green plane, that of the edge included.
    """
    keys = [*image(px), "r", "c"]
    border = border_means(px, height, width, pattern)
    green = ppg_green(px, height, width, pattern).unionByName(border.select(*keys, "green"))
    guided = px.select(*keys, "v").join(green.withColumnRenamed("green", "g"), keys)
    inside = ppg_red_blue(guided, height, width, pattern).join(green, keys)
    return inside.select(*keys, "red", "green", "blue").unionByName(border)
