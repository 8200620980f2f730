"""Colour functions: tone curves, spaces, matrices and adaptation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sRGB primaries' matrix (D65) and the cone matrix of the Bradford method.
SRGB_TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
#: White points (x, y).
WHITE = {"A": (0.44757, 0.40745), "D50": (0.34567, 0.35850), "D55": (0.33242, 0.34743), "D65": (0.31271, 0.32902), "D75": (0.29902, 0.31485)}
#: Knee of the sRGB curve, and the constants of CIE L*a*b*.
KNEE, EPSILON, KAPPA = 0.00304, 216 / 24389, 24389 / 27


def srgb(v: Column) -> Column:
    return F.when(v <= KNEE, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def srgb_inverse(v: Column) -> Column:
    return F.when(v <= KNEE * 12.92, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def gamma(v: Column, g: float) -> Column:
    return F.pow(v, F.lit(1 / g))


def gamma_inverse(v: Column, g: float) -> Column:
    return F.pow(v, F.lit(g))


def lab(x: Column, y: Column, z: Column, white: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    f = lambda t: F.when(t > EPSILON, F.cbrt(t)).otherwise((t * KAPPA + 16) / 116)
    fx, fy, fz = (f(v / w) for v, w in zip((x, y, z), white, strict=True))
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def lab_inverse(lightness: Column, a: Column, b: Column, white: tuple[float, float, float]) -> list[Column]:
    """X, Y, Z of L*a*b*."""
    fy = (lightness + 16) / 116
    cube = lambda t: t * t * t
    f = lambda t: F.when(cube(t) > EPSILON, cube(t)).otherwise((t * 116 - 16) / KAPPA)
    y = F.when(lightness > KAPPA * EPSILON, cube(fy)).otherwise(lightness / KAPPA)
    return [f(fy + a / 500) * white[0], y * white[1], f(fy - b / 200) * white[2]]


def rgb_to_lab(red: Column, green: Column, blue: Column) -> list[Column]:
    """L*a*b* of linear sRGB, with the exact cube root. The white of D65, and the curve's constants from 6/29."""
    knee = 6 / 29
    f = lambda t: F.when(t > knee**3, F.cbrt(t)).otherwise(t / (3 * knee * knee) + 4 / 29)
    fx, fy, fz = (f(v / w) for v, w in zip(matrix(SRGB_TO_XYZ, [red, green, blue]), (0.95047, 1.0, 1.08883), strict=True))
    return [fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200]


def matrix(m: np.ndarray, cols: list[Column]) -> list[Column]:
    """Linear map as literal expressions."""
    return [sum((c * float(k) for c, k in zip(cols[1:], row[1:], strict=True)), cols[0] * float(row[0])) for row in m]


def normalize_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to sum 1; a row that sums to 0 stays 0."""
    s = m.sum(1, keepdims=True)
    return np.divide(m, s, out=np.zeros_like(m, dtype=float), where=s != 0)


def camera_to_rgb(xyz_to_camera: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(normalize_rows(xyz_to_camera @ SRGB_TO_XYZ))


def xy_to_xyz(x: float, y: float) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y])


def bradford(source: str, target: str) -> np.ndarray:
    """Adaptation matrix between two white points."""
    a, b = (BRADFORD @ xy_to_xyz(*WHITE[k]) for k in (source, target))
    return np.linalg.inv(BRADFORD) @ np.diag(b / a) @ BRADFORD


def ycbcr(y: Column, cb: Column, cr: Column, offset: int = 16383) -> tuple[Column, Column, Column]:
    b, r = cb - offset, cr - offset
    return y + r * 1.402, y - b * 0.344136 - r * 0.714136, y + b * 1.772
