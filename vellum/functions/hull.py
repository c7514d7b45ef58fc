"""Convex hulls and smallest rectangles of points of whole numbers, as Columns over an array of structs (x, y).

The hull is a fold over the sorted points, one for either side: a point takes off the end of the chain whatever turns the wrong way.
For the rectangle every edge of the hull is tried as a side.  Products are whole numbers, so turns are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:bigint,y:bigint>>"


def turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _chain(points: Column) -> Column:
    def step(chain: Column, p: Column) -> Column:
        # the places where the chain still turns left towards p are its first ones
        left = F.filter(F.sequence(F.lit(1), F.size(chain) - 1), lambda i: turn(F.get(chain, i - 1), F.get(chain, i), p) > 0)
        keep = F.when(F.size(chain) < 2, F.size(chain)).otherwise(F.size(left) + 1)
        return F.concat(F.slice(chain, 1, keep), F.array(p))

    return F.aggregate(points, F.array().cast(POINTS), step)


def hull(points: Column) -> Column:
    """The corners of the convex hull from the leftmost point on, points along its edges left out; a single point is its own hull."""
    ordered = F.array_sort(F.array_distinct(points.cast(POINTS)))

    def open_(chain: Column) -> Column:
        return F.slice(chain, 1, F.size(chain) - 1)

    return F.when(F.size(ordered) < 2, ordered).otherwise(F.concat(open_(_chain(ordered)), open_(_chain(F.reverse(ordered)))))


def smallest_rectangle(hull: Column) -> Column:
    """(area, corners) of the smallest rectangle around a hull that has a side along one of its edges; of equal ones that of the leftmost edge.

    A single point is a rectangle without an area; an empty hull has none.
    """

    def around(i: Column) -> Column:
        a, b = F.get(hull, i), F.get(hull, (i + 1) % F.size(hull))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        along, across = F.transform(hull, lambda p: p["x"] * dx + p["y"] * dy), F.transform(hull, lambda p: p["y"] * dx - p["x"] * dy)
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), dx.alias("dx"), dy.alias("dy"), F.array_min(along).alias("p0"), F.array_max(along).alias("p1"), F.array_min(across).alias("n0"), F.array_max(across).alias("n1"))

    def measured(r: Column) -> Column:
        square = r["dx"] * r["dx"] + r["dy"] * r["dy"]
        area = (r["p1"] - r["p0"]) * (r["n1"] - r["n0"]) / square
        corners = [F.struct(((r[p] * r["dx"] - r[n] * r["dy"]) / square).alias("x"), ((r[p] * r["dy"] + r[n] * r["dx"]) / square).alias("y")) for p, n in (("p0", "n0"), ("p1", "n0"), ("p1", "n1"), ("p0", "n1"))]
        return F.struct(area.alias("area"), r["ax"].alias("ax"), r["ay"].alias("ay"), F.array(*corners).alias("corners"))

    edges = F.transform(F.sequence(F.lit(0), F.size(hull) - 1), around)
    best = F.array_min(F.transform(edges, measured))
    one = F.get(hull, F.lit(0))
    same = F.struct(one["x"].cast("double").alias("x"), one["y"].cast("double").alias("y"))
    point = F.struct(F.lit(0.0).alias("area"), F.array(same, same, same, same).alias("corners"))
    return F.when(F.size(hull) == 1, point).when(F.size(hull) > 1, F.struct(best["area"].alias("area"), best["corners"].alias("corners")))


def representative(points: Column) -> Column:
    """The points of least x + y, greatest x - y, greatest x + y and least x - y; of equal ones the first by line, then place."""

    def extreme(value) -> Column:
        best = F.array_min(F.transform(points, lambda p: F.struct(value(p).alias("v"), p["y"].alias("y"), p["x"].alias("x"))))
        return F.struct(best["x"].alias("x"), best["y"].alias("y"))

    return F.array(extreme(lambda p: p["x"] + p["y"]), extreme(lambda p: p["y"] - p["x"]), extreme(lambda p: -p["x"] - p["y"]), extreme(lambda p: p["x"] - p["y"]))
