"""Components, lines and rectangles against plain versions, and odd inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import hull as H
from vellum.operators import lines as L
from vellum.operators import masks as M

LINES = "mask long, y long, pixels array<boolean>"


def flood(picture, diagonal):
    """Pixels by component, told by its first run's number."""
    set_ = {(y, x) for y, line in enumerate(picture) for x, on in enumerate(line) if on}
    steps = [(a, b) for a, b in itertools.product((-1, 0, 1), repeat=2) if (a or b) and (diagonal or not (a and b))]
    found = {}
    while set_:
        first = min(set_)
        seen, todo = set(), [first]
        while todo:
            p = todo.pop()
            if p in set_:
                set_.remove(p)
                seen.add(p)
                todo += [(p[0] + a, p[1] + b) for a, b in steps]
        found[first] = seen
    return {(y << M.PIXEL_BITS) + x: seen for (y, x), seen in found.items()}


def picture_of(seed, width, height, share):
    r = random.Random(seed)
    return [[r.random() < share for _ in range(width)] for _ in range(height)]


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(spark, diagonal):
    pictures = {1: picture_of(1, 200, 12, 0.5), 2: picture_of(2, 70, 30, 0.4), 3: [[True] * 300] * 4, 4: [[False] * 9] * 3}
    # a comb: one component that is only joined in its last line, and a snake as long as the picture
    pictures[5] = [[x % 2 == 0 for x in range(160)] for _ in range(6)] + [[True] * 160]
    pictures[6] = [[y % 2 == 0 or x == (149 if y % 4 == 1 else 0) for x in range(150)] for y in range(25)]
    rows = [(m, y, line) for m, p in pictures.items() for y, line in enumerate(p)]
    labelled = M.labelled(M.runs(spark.createDataFrame(rows, LINES).repartition(3)), diagonal).collect()
    for m, p in pictures.items():
        got = {}
        for r in labelled:
            if r["mask"] == m:
                got.setdefault(r["label"], set()).update((r["y"], x) for x in range(r["x0"], r["x1"] + 1))
        assert got == flood(p, diagonal)


def test_pairs_come_once(spark):
    rows = [(1, 0, [True] * 500), (1, 1, [x % 3 > 0 for x in range(500)])]
    pairs = M.touching(M.runs(spark.createDataFrame(rows, LINES)))
    assert pairs.count() == pairs.distinct().count() == 167


def test_odd_lines(spark):
    rows = [(1, 0, None), (1, 1, []), (1, 2, [None, True, None]), (1, 3, [False]), (2, 0, [True]), (3, 0, None)]
    runs = M.runs(spark.createDataFrame(rows, LINES))
    assert sorted((r["mask"], r["y"], r["x0"], r["x1"]) for r in runs.collect()) == [(1, 2, 1, 1), (2, 0, 0, 0)]
    nothing = M.runs(spark.createDataFrame([], LINES))
    assert M.chosen(M.components(M.labelled(nothing), 8, 8), 8, 8).count() == 0


def test_choice(spark):
    """A guide draws the choice to the component that is near it; equal scores leave the larger, then the first."""
    rows = [(m, y, [x < 6 or x >= 14 for x in range(20)]) for m in (1, 2) for y in range(4, 12)]
    c = M.components(M.labelled(M.runs(spark.createDataFrame(rows, LINES))), 20, 16)
    c = c.withColumns({"gx": F.when(F.col("mask") == 2, 17.0), "gy": F.when(F.col("mask") == 2, 8.0)})
    got = {r["mask"]: r for r in M.chosen(c, 20, 16, ("gx", "gy")).collect()}
    assert got[1]["x_min"] == 0 and got[2]["x_min"] == 14
    tiny = M.components(M.labelled(M.runs(spark.createDataFrame([(1, 0, [True] + [False] * 19)], LINES))), 20, 16)
    assert M.chosen(tiny, 20, 16).count() == 0


def rectangle_by_turning(points):
    """Area of the smallest rectangle with a side through two of the points that holds all."""
    areas = []
    for (ax, ay), (bx, by) in itertools.permutations(points, 2):
        dx, dy = bx - ax, by - ay
        if all(dx * (y - ay) - dy * (x - ax) >= 0 for x, y in points):
            along, across = [x * dx + y * dy for x, y in points], [y * dx - x * dy for x, y in points]
            areas.append((max(along) - min(along)) * (max(across) - min(across)) / (dx * dx + dy * dy))
    return min(areas)


def test_rectangles(spark):
    r = random.Random(5)
    clouds = [[(r.randrange(n), r.randrange(n)) for _ in range(size)] for n in (2, 5, 40, 4000) for size in (2, 3, 7, 25)]
    clouds = [c if len(set(c)) > 1 else [(0, 0), (1, 1)] for c in clouds] + [[(0, 0), (2, 2), (1, 1), (2, 2)], [(3, 0), (0, 3), (3, 6), (6, 3)]]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in c]) for i, c in enumerate(clouds)], f"id int, p {H.POINTS}")
    got = df.withColumn("h", H.hull(F.col("p"))).withColumn("r", H.smallest_rectangle(F.col("h"))).collect()
    for row in got:
        points = clouds[row["id"]]
        assert row["r"]["area"] == pytest.approx(rectangle_by_turning(sorted(set(points))))
        corners, hull = [(p["x"], p["y"]) for p in row["h"]], set(points)
        assert set(corners) <= hull and len(set(corners)) == len(corners)
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in hull)


def test_rectangles_of_little(spark):
    df = spark.createDataFrame([(1, [{"x": 4, "y": 5}] * 3), (2, []), (3, None)], f"id int, p {H.POINTS}").withColumn("h", H.hull(F.col("p"))).withColumn("r", H.smallest_rectangle(F.col("h")))
    got = {r["id"]: r["r"] for r in df.collect()}
    assert got[1]["area"] == 0 and {(c["x"], c["y"]) for c in got[1]["corners"]} == {(4.0, 5.0)}
    assert got[2] is None and got[3] is None


def test_lines(spark):
    """A frame's four sides are found, each as one segment; a gap parts a side in two, and a short rest is left out."""
    frame = {(x, y) for x in range(10, 91) for y in (20, 70)} | {(x, y) for x in (10, 90) for y in range(20, 71)}
    points = spark.createDataFrame([(1, x, y) for x, y in frame if not (y == 20 and 40 < x < 60)] + [(2, 3, 3)], "mask int, x int, y int")
    top = L.strongest(L.peaks(L.votes(points), 45))
    straight = top.filter("angle in (0, 90)")
    assert {(r["angle"], r["distance"]) for r in straight.collect()} == {(0, 10), (0, 90), (90, 20), (90, 70)}
    found = L.segments(points, straight, 20.0, 5.0)
    assert sorted((r["angle"], r["distance"], abs(r["x1"] - r["x0"]) + abs(r["y1"] - r["y0"])) for r in found.collect()) == [(0, 10, 50), (0, 90, 50), (90, 20, 30), (90, 20, 30), (90, 70, 80)]
    corners = {"x0": 10, "y0": 21, "x1": 90, "y1": 21, "x2": 90, "y2": 70, "x3": 10, "y3": 70}
    quads = spark.createDataFrame([(m, *map(float, corners.values())) for m in (1, 2)], "mask int, " + ", ".join(f"{c} double" for c in corners))
    assert {r["mask"]: (r["supported"], r["score"]) for r in L.support(quads, found, 2.0).collect()} == {1: (5, 1.0), 2: (0, 0.0)}


def test_no_lines(spark):
    none = spark.createDataFrame([], "mask int, x int, y int")
    lines = L.strongest(L.peaks(L.votes(none), 1))
    assert lines.count() == 0 and L.segments(none, lines, 1.0, 1.0).count() == 0
