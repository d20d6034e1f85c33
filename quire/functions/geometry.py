"""Boxes and polygons as column expressions.  A box is four numeric columns or a struct<x1,y1,x2,y2>."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Corner columns of an axis-aligned box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])

    def area(self) -> Column:
        """Zero where the corners are out of order."""
        return F.greatest(self.x2 - self.x1, F.lit(0)) * F.greatest(self.y2 - self.y1, F.lit(0))

    def overlaps(self, other: Box) -> Column:
        return (self.x1 < other.x2) & (other.x1 < self.x2) & (self.y1 < other.y2) & (other.y1 < self.y2)

    def intersection(self, other: Box) -> Column:
        wide = F.least(self.x2, other.x2) - F.greatest(self.x1, other.x1)
        high = F.least(self.y2, other.y2) - F.greatest(self.y1, other.y1)
        return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))

    def iou(self, other: Box) -> Column:
        """Intersection over union; zero for touching boxes and for an empty union."""
        inter = self.intersection(other)
        union = self.area() + other.area() - inter
        return F.when(union > 0, inter.cast("double") / union.cast("double")).otherwise(F.lit(0.0))

    def hull_area(self, other: Box) -> Column:
        """Area of the convex hull of both boxes: their common bounds without the corners that neither reaches."""
        wide = F.greatest(self.x2, other.x2) - F.least(self.x1, other.x1)
        high = F.greatest(self.y2, other.y2) - F.least(self.y1, other.y1)
        cut = lambda x, y, side: F.greatest(side * (getattr(self, x) - getattr(other, x)) * (getattr(self, y) - getattr(other, y)), F.lit(0))
        return (wide * high).cast("double") - (cut("x1", "y1", -1) + cut("x2", "y1", 1) + cut("x1", "y2", 1) + cut("x2", "y2", -1)).cast("double") / 2

    def hull_iou(self, other: Box) -> Column:
        """Intersection over the hull of both; zero for an empty hull."""
        hull = self.hull_area(other)
        return F.when(hull > 0, self.intersection(other).cast("double") / hull).otherwise(F.lit(0.0))

    def corner_distance(self, other: Box) -> Column:
        """L1 distance of all corners, plus the smaller of the two corners' own."""
        first = F.abs(self.x1 - other.x1) + F.abs(self.y1 - other.y1)
        last = F.abs(self.x2 - other.x2) + F.abs(self.y2 - other.y2)
        return first + last + F.least(first, last)

    def centre(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def holds(self, x: Column, y: Column) -> Column:
        """Whether a point lies inside, edges included."""
        return x.between(self.x1, self.x2) & y.between(self.y1, self.y2)

    def padded(self, by: int, width: Column, height: Column) -> Box:
        zero = F.lit(0)
        return Box(F.greatest(self.x1 - by, zero), F.greatest(self.y1 - by, zero), F.least(self.x2 + by, width), F.least(self.y2 + by, height))

    def scaled(self, width: Column, height: Column, to: int = 1000) -> Box:
        """Corners as integers on a grid of ``to`` cells; fractions are cut off."""
        return Box(*[(c * to / size).cast("long") for c, size in ((self.x1, width), (self.y1, height), (self.x2, width), (self.y2, height))])

    def corners(self) -> Column:
        """Four points, clockwise from the top left."""
        return F.array(F.array(self.x1, self.y1), F.array(self.x2, self.y1), F.array(self.x2, self.y2), F.array(self.x1, self.y2))


def bounds(points: Column) -> Column:
    """struct<x1,y1,x2,y2> of an array of points; null for none."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def polygon_area(points: Column) -> Column:
    """Signed area by the shoelace sum."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, shifted, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda a, b: a + b) / 2


def box_of_corners(values: Column) -> Column:
    """xyxy of a flat array of four numbers or of eight (four points); else null."""
    even, odd = F.filter(values, lambda v, i: i % 2 == 0), F.filter(values, lambda v, i: i % 2 == 1)
    box = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    return F.when(F.size(values) == 4, box(values[0], values[1], values[2], values[3])).when(F.size(values) == 8, box(F.array_min(even), F.array_min(odd), F.array_max(even), F.array_max(odd)))


def centre_to_corners(box: Box) -> Box:
    """From centre, width and height to corners."""
    return Box(box.x1 - box.x2 / 2, box.y1 - box.y2 / 2, box.x1 + box.x2 / 2, box.y1 + box.y2 / 2)


def corners_to_centre(box: Box) -> Box:
    return Box(box.x1 + (box.x2 - box.x1) / 2, box.y1 + (box.y2 - box.y1) / 2, box.x2 - box.x1, box.y2 - box.y1)
