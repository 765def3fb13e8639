"""Scalar geometry of boxes as column expressions.

A box is four columns, ``x0 y0 x1 y1``, with an optional prefix. Helpers that look
alike differ in the floor of their denominators; callers name it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> Box:
        return Box(*[F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")])

    @staticmethod
    def from_list(values: Column) -> Box:
        """A four-element array as a box."""
        return Box(*[F.get(values, F.lit(i)) for i in range(4)])

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x1 - self.x0)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y1 - self.y0)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2

    def scaled(self, sx: float | Column, sy: float | Column) -> Box:
        return Box(self.x0 * sx, self.y0 * sy, self.x1 * sx, self.y1 * sy)

    def clamped(self, width: float | Column, height: float | Column) -> Box:
        """Cut to the page; inverted edges change places."""
        cut = lambda v, most: F.least(F.greatest(F.lit(0.0), v), F.lit(most) if not isinstance(most, Column) else most)
        a, b, c, d = cut(self.x0, width), cut(self.y0, height), cut(self.x1, width), cut(self.y1, height)
        return Box(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))

    def struct(self) -> Column:
        return F.struct(self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1"))


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def intersection_area(a: Box, b: Box) -> Column:
    return overlap_1d(a.x0, a.x1, b.x0, b.x1) * overlap_1d(a.y0, a.y1, b.y0, b.y1)


def coverage(inner: Box, outer: Box, floor: float = 1.0) -> Column:
    """Share of ``inner`` that lies in ``outer``, at most 1."""
    return F.least(F.lit(1.0), intersection_area(inner, outer) / F.greatest(inner.area, F.lit(floor)))


def iou(a: Box, b: Box, floor: float = 1e-9) -> Column:
    common = intersection_area(a, b)
    return common / F.greatest(a.area + b.area - common, F.lit(floor))


def horizontal_overlap_ratio(a: Box, b: Box) -> Column:
    return overlap_1d(a.x0, a.x1, b.x0, b.x1) / F.greatest(F.least(a.width, b.width), F.lit(1.0))


def vertical_overlap_ratio(a: Box, b: Box) -> Column:
    return overlap_1d(a.y0, a.y1, b.y0, b.y1) / F.greatest(F.least(a.height, b.height), F.lit(1.0))


def center_inside(a: Box, b: Box, tolerance: float = 0.0) -> Column:
    return a.center_x.between(b.x0 - tolerance, b.x1 + tolerance) & a.center_y.between(b.y0 - tolerance, b.y1 + tolerance)


def intersects_page(a: Box, width: float, height: float) -> Column:
    return (a.x1 > 0) & (a.y1 > 0) & (a.x0 < width) & (a.y0 < height)


def row_key(y0: Column, step: float = 6.0) -> Column:
    """Rows of the visual order: half-even rounding to a multiple of ``step``."""
    return F.rint(y0 / step) * step
