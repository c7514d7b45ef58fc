"""Quadrilaterals of page corners as Columns, clockwise from the top left.

Corners are plain double columns, so all of this stays inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.numbers import Number, clamp, col


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length <= 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / length))
    return distance(px, py, ax + dx * t, ay + dy * t)


class Quad:
    """Four corners: xs and ys."""

    def __init__(self, xs: list[Column], ys: list[Column]):
        self.xs, self.ys = xs, ys

    @classmethod
    def of(cls, prefix_x: str = "x", prefix_y: str = "y") -> Quad:
        return cls([F.col(f"{prefix_x}{k}") for k in range(4)], [F.col(f"{prefix_y}{k}") for k in range(4)])

    def mapped(self, fx, fy) -> Quad:
        return Quad([fx(x, y) for x, y in zip(self.xs, self.ys, strict=True)], [fy(x, y) for x, y in zip(self.xs, self.ys, strict=True)])

    def scaled(self, width: Number, height: Number) -> Quad:
        """In shares of width and height."""
        return self.mapped(lambda x, _: x / col(width), lambda _, y: y / col(height))

    @property
    def left(self) -> Column:
        return F.least(*self.xs)

    @property
    def right(self) -> Column:
        return F.greatest(*self.xs)

    @property
    def top(self) -> Column:
        return F.least(*self.ys)

    @property
    def bottom(self) -> Column:
        return F.greatest(*self.ys)

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def area(self) -> Column:
        """The shoelace formula."""
        terms = [self.xs[i] * self.ys[(i + 1) % 4] - self.xs[(i + 1) % 4] * self.ys[i] for i in range(4)]
        return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2.0

    @property
    def turns(self) -> list[Column]:
        """The cross product at the end of each edge."""
        n = [(i, (i + 1) % 4, (i + 2) % 4) for i in range(4)]
        return [(self.xs[b] - self.xs[a]) * (self.ys[c] - self.ys[b]) - (self.ys[b] - self.ys[a]) * (self.xs[c] - self.xs[b]) for a, b, c in n]

    def is_clockwise(self, least: float = 1e-4) -> Column:
        """Convex, and in the order of corners."""
        return all_of([t >= least for t in self.turns])

    def is_convex(self, least: float = 1e-6) -> Column:
        """Strictly convex, in either sense."""
        return all_of([t >= least for t in self.turns]) | all_of([t <= -least for t in self.turns])

    def edges_cross(self, a: int, b: int) -> Column:
        """Whether the edges that start at corners a and b cross."""
        (ax, ay), (bx, by) = self.point(a), self.point(a + 1)
        (cx, cy), (dx, dy) = self.point(b), self.point(b + 1)
        return (cross(ax, ay, bx, by, cx, cy) * cross(ax, ay, bx, by, dx, dy) < 0) & (cross(cx, cy, dx, dy, ax, ay) * cross(cx, cy, dx, dy, bx, by) < 0)

    def point(self, k: int) -> tuple[Column, Column]:
        return self.xs[k % 4], self.ys[k % 4]

    def is_valid(self) -> Column:
        """Has an area, and no edge crosses the one across."""
        return (self.area > 0.000001) & ~self.edges_cross(0, 2) & ~self.edges_cross(1, 3)

    def inside(self, low: Number, width: Number, height: Number) -> Column:
        return (self.left >= col(low)) & (self.top >= col(low)) & (self.right <= col(width)) & (self.bottom <= col(height))

    def holds(self, x: Column, y: Column) -> Column:
        """Whether a point lies inside: a ray from it crosses an odd number of edges."""
        crossed = F.lit(0)
        for k in range(4):
            (cx, cy), (px, py) = self.point(k), self.point(k + 3)
            crossed = crossed + F.when((cy > y) != (py > y), (x < (px - cx) * (y - cy) / (py - cy) + cx).cast("int")).otherwise(0)
        return crossed % 2 == 1

    def distances(self, other: Quad) -> list[Column]:
        return [distance(*self.point(k), *other.point(k)) for k in range(4)]

    def rotated(self, degrees: Column) -> Quad:
        """Turned within the unit square; the corner that comes to the top left is named first."""

        def turned(k: int, axis: int) -> Column:
            (x90, y90), (x180, y180), (x270, y270), (x, y) = self.point(k + 3), self.point(k + 2), self.point(k + 1), self.point(k)
            options = ((1.0 - y90, x90), (1.0 - x180, 1.0 - y180), (y270, 1.0 - x270), (x, y))
            return F.when(degrees == 90, options[0][axis]).when(degrees == 180, options[1][axis]).when(degrees == 270, options[2][axis]).otherwise(options[3][axis])

        return Quad([turned(k, 0) for k in range(4)], [turned(k, 1) for k in range(4)])


# fixed values: the extents and areas in the rules below have to be these for results to be right


def is_sane(unit: Quad, single: Column, clipping: Number, capture: bool = False) -> Column:
    """Large enough within the frame to be a page; sides of a spread may be narrower, live captures have to be larger."""
    sane = unit.inside(0, 1, 1) & (unit.width >= F.when(single, 0.46).otherwise(0.42)) & (unit.height >= 0.48) & (unit.area >= F.when(single, 0.24).otherwise(0.22)) & (col(clipping) < 0.88)
    if capture:
        sane = sane & (unit.width >= F.when(single, 0.52).otherwise(0.48)) & (unit.height >= 0.56) & (unit.area >= F.when(single, 0.32).otherwise(0.30))
    return unit.is_valid() & sane


def is_live_sane(unit: Quad, single: Column) -> Column:
    """As a live capture; the frame may be left by 3 %."""
    within = (unit.left >= -0.03) & (unit.right <= 1.03) & (unit.top >= -0.03) & (unit.bottom <= 1.03)
    return unit.is_valid() & within & (unit.width >= F.when(single, 0.52).otherwise(0.48)) & (unit.height >= 0.56) & (unit.area >= F.when(single, 0.32).otherwise(0.30))


def is_content_sane(unit: Quad) -> Column:
    return unit.is_valid() & unit.inside(0, 1, 1) & (unit.width >= 0.68) & (unit.height >= 0.68) & (unit.area >= 0.48)


def crop(left: Column, top: Column, right: Column, bottom: Column, least: float = 0.01) -> list[Column]:
    """A rectangle held within the unit square, at least so wide and high."""

    def held(a: Column, b: Column) -> tuple[Column, Column]:
        a, b = clamp(a), clamp(b)
        narrow = b - a < least
        wide = clamp(a + least)
        return F.when(narrow, clamp(wide - least)).otherwise(a), F.when(narrow, wide).otherwise(b)

    (l, r), (t, b) = held(left, right), held(top, bottom)
    return [l, t, r, b]
