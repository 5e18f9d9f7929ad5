"""Rectangles in points, origin top left, as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = ("x0", "y0", "x1", "y1")


def rounded_key(*columns: str) -> list[Column]:
    """Equality of coordinates is at two decimals."""
    return [F.bround(F.col(c), 2).alias(f"k_{c}") for c in columns]


def normalized(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Corners in ascending order."""
    return {"x0": F.least(x0, x1), "y0": F.least(y0, y1), "x1": F.greatest(x0, x1), "y1": F.greatest(y0, y1)}


def is_empty(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 <= x0) | (y1 <= y0)


def intersection_area(a: list[Column], b: list[Column]) -> Column:
    """Common area of two rectangles; 0 where one is absent, as after an outer join."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when(a[0].isNull() | b[0].isNull(), 0.0).otherwise(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length over the shorter length."""
    shorter = F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1e-9))
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / shorter


def contains_rect(outer: list[Column], inner: list[Column], tolerance: float = 0.0) -> Column:
    t = F.lit(tolerance)
    return (inner[0] >= outer[0] - t) & (inner[1] >= outer[1] - t) & (inner[2] <= outer[2] + t) & (inner[3] <= outer[3] + t)


def tightened(y0: Column, y1: Column, horizontal: Column) -> tuple[Column, Column]:
    """Top and bottom of a text rectangle drawn in to about the letters: 0.6 of the height, from 3 to 12 points, about its middle."""
    h = y1 - y0
    target = F.least(F.greatest(F.lit(0.6) * h, F.lit(3.0)), F.lit(12.0))
    applies = horizontal & (h > 0) & (h <= 24) & (target < h)
    middle = (y0 + y1) / 2
    return F.when(applies, middle - target / 2).otherwise(y0), F.when(applies, middle + target / 2).otherwise(y1)


def is_horizontal(dy: Column) -> Column:
    return F.abs(dy) <= 1e-3


def mapped_rect(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Envelope of a rectangle's corners under an affine map [a, b, c, d, e, f]."""
    at = lambda i: F.get(m, F.lit(i))
    xs = [at(0) * x + at(2) * y + at(4) for x in (x0, x1) for y in (y0, y1)]
    ys = [at(1) * x + at(3) * y + at(5) for x in (x0, x1) for y in (y0, y1)]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def inverse_map(m: Column) -> Column:
    """The inverse affine map, null where the determinant is nearly 0."""
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    det = a * d - b * c
    out = F.array(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)
    return F.when(F.abs(det) >= 1e-9, out)


BAND = 32.0
_MOST_BANDS = 2000


def band_of(y: Column) -> Column:
    """Number of the horizontal band that a height lies in; what is far off any page shares the outermost ones."""
    return F.floor(F.least(F.greatest(y / BAND, F.lit(-float(_MOST_BANDS))), F.lit(float(_MOST_BANDS)))).cast("int")


def bands_between(low: Column, high: Column) -> Column:
    """Numbers of all bands from one height to another."""
    return F.sequence(band_of(low), F.greatest(band_of(low), band_of(high)))
