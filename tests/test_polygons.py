"""The polygon of a page against a plain version, on random pages and the cases that matter."""

import numpy as np
import pytest

from vellum.operators import polygons as O

CORNERS = [f"{a}{k}" for k in range(4) for a in "xy"]
PAGES = "page_id long, side string, width int, height int, " + ", ".join(f"{c} double" for c in CORNERS) + ", " + ", ".join(f"r{c} double" for c in CORNERS)
PAGES += ", accepted boolean, ownership double, adjacent double, roi_left double, roi_top double, roi_right double, roi_bottom double"
EDGES = "page_id long, edge string, ord long, visibility string, offset double, foreground_beyond boolean, paper_beyond boolean"
SQUARE = [(200.0, 200.0), (800.0, 200.0), (800.0, 1000.0), (200.0, 1000.0)]


def page(key, corners=SQUARE, side=None, refined=None, accepted=False, ownership=0.9, adjacent=0.1, region=(100.0, 100.0, 900.0, 1390.0)):
    flat = [float(v) if v is not None else None for p in corners for v in p]
    return (key, side, 1000, 1400, *flat, *([v for p in refined for v in p] if refined else [None] * 8), accepted, ownership, adjacent, *region)


def area(p):
    return abs(sum(p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4))) / 2


def moved(corners, outward):
    """Each edge as a line n.p = c, moved by its distance; neighbours meet where two equations hold."""
    lines = []
    for k in range(4):
        a, b = np.array(corners[k]), np.array(corners[(k + 1) % 4])
        normal = np.array([b[1] - a[1], a[0] - b[0]]) / max(1.0, np.hypot(*(b - a)))
        lines.append((normal, normal @ (a + normal * outward[k])))
    out = []
    for k in range(4):
        (n, c), (m, d) = lines[(k + 3) % 4], lines[k]
        if abs(n[0] * m[1] - n[1] * m[0]) < 1e-12:
            return None
        x, y = np.linalg.solve(np.array([n, m]), np.array([c, d]))
        out.append((min(max(x, 0.0), 1000.0), min(max(y, 0.0), 1400.0)))
    return out


def safe(raw, polygon):
    if polygon is None or not 0.96 <= area(polygon) / max(1.0, area(raw)) <= 1.70:
        return False
    p = [(int(x + 1e-7), int(y + 1e-7)) for x, y in polygon]
    turns = [(p[(i + 1) % 4][0] - p[i][0]) * (p[(i + 2) % 4][1] - p[(i + 1) % 4][1]) - (p[(i + 1) % 4][1] - p[i][1]) * (p[(i + 2) % 4][0] - p[(i + 1) % 4][0]) for i in range(4)]
    return all(t > 0 for t in turns) or all(t < 0 for t in turns)


def plain(row, edges):
    raw = [(row[4 + 2 * k], row[5 + 2 * k]) for k in range(4)]
    refined = [(row[12 + 2 * k], row[13 + 2 * k]) for k in range(4)]
    side, (accepted, ownership, adjacent, *region) = row[1], row[20:]
    if (1.0 if ownership is None else ownership) < 0.66 or (adjacent or 0.0) >= 0.66 or not np.isfinite(np.array(raw, float)).all():
        return None, None
    seen = [min((e[2:] for e in edges if e[0] == row[0] and e[1] == name), default=None) for name in O.EDGES]
    states = [s[1] if s else "unknown" for s in seen]
    if accepted and refined[0][0] is not None and set(states) == {"confirmed"}:
        return "ai_refined", refined
    outward, margins = [], []
    for k, state in enumerate(states):
        spine = (side, k) in (("left", 1), ("right", 3))
        x, y = ((raw[k][i] + raw[(k + 1) % 4][i]) / 2 for i in (0, 1))
        most = 55.0 if spine else 100.0
        if not spine and state == "outOfFrame":
            most = max(most, (y, 1000 - x, 1400 - y, x)[k])
        elif not spine and k == 2 and seen[k] and (seen[k][3] or seen[k][4]):
            most = max(most, region[3] - y)
        least = {"confirmed": 0.0, "weak": 35.0 if k == 2 else 12.0, "occluded": 70.0 if k == 2 else 30.0}.get(state, 70.0 if k == 2 else 40.0)
        outward.append(min(max(seen[k][2] if seen[k] else 0.0, least), most))
        margins.append(70.0 if k == 2 else 12.0)
    if ownership is not None or set(states) & {"confirmed", "weak", "occluded"}:
        hybrid = moved(raw, outward)
        if safe(raw, hybrid):
            return "ai_hybrid", hybrid
    fallback = moved(raw, margins)
    return ("ai_raw_fallback", fallback) if safe(raw, fallback) else (None, None)


def check(spark, pages, edges):
    got = {r["page_id"]: r for r in O.safe_polygons(spark.createDataFrame(pages, PAGES).repartition(3), spark.createDataFrame(edges, EDGES).repartition(3)).collect()}
    assert len(got) == len(pages)
    for row in pages:
        source, corners = plain(row, edges)
        r = got[row[0]]
        assert r["source"] == source, row
        assert [r[c] for c in CORNERS] == (pytest.approx([v for p in corners for v in p], abs=1e-6) if corners else [None] * 8)
    return {k: r["source"] for k, r in got.items()}


def test_random_pages(spark):
    rng = np.random.default_rng(3)
    pages, edges = [], []
    for i in range(400):
        corners = [(x + rng.uniform(-90, 90) * (i % 4), y + rng.uniform(-90, 90) * (i % 4)) for x, y in SQUARE]
        none = i % 5 == 0
        refined = [(x + 1, y + 1) for x, y in corners] if i % 3 else None
        pages.append(page(i, corners, (None, "left", "right")[i % 3], refined, bool(i % 2), None if none else rng.uniform(0.6, 1), None if none else rng.uniform(0, 0.75)))
        sure = i % 7 == 0
        for j in range(int(rng.integers(0, 8)) if not sure else 4):
            state = "confirmed" if sure else str(rng.choice(["confirmed", "weak", "occluded", "outOfFrame", "unknown"]))
            edges.append((i, O.EDGES[j % 4], j // 4, state, float(rng.uniform(0, 250)), bool(rng.integers(2)), bool(rng.integers(2))))
    found = check(spark, pages, edges)
    assert set(found.values()) == {None, "ai_refined", "ai_hybrid", "ai_raw_fallback"}


def test_cases(spark):
    """The search region below a page that goes on, the frame, the spine's own limit, parallel edges, odd corners, and pages without evidence."""
    flat = [(200.0, 200.0), (800.0, 200.0), (900.0, 200.0), (200.0, 1000.0)]
    nan, missing = [(float("nan"), 200.0), *SQUARE[1:]], [(None, 200.0), *SQUARE[1:]]
    endless = [(float("inf"), 200.0), *SQUARE[1:]]
    pages = [page(0, region=(100.0, 100.0, 900.0, 1200.0)), page(1), page(2, side="left"), page(3, flat), page(4, nan), page(5, missing), page(6, endless), page(7, ownership=None, adjacent=None), page(8, ownership=0.5), page(9, adjacent=0.7)]
    edges = [(0, "bottom", 1, "weak", 500.0, True, False), (0, "bottom", 2, "confirmed", 0.0, False, False), (1, "left", 1, "outOfFrame", 500.0, False, False), (2, "right", 1, "outOfFrame", 500.0, False, False)]
    found = check(spark, pages, edges)
    assert [found[k] for k in range(10)] == ["ai_hybrid", "ai_hybrid", "ai_hybrid", None, None, None, None, "ai_raw_fallback", None, None]
    got = {r["page_id"]: r for r in O.safe_polygons(spark.createDataFrame(pages, PAGES), spark.createDataFrame(edges, EDGES)).collect()}
    assert got[0]["y2"] == pytest.approx(1200) and got[1]["x0"] == pytest.approx(0) and got[2]["x1"] == pytest.approx(855)
    empty = O.safe_polygons(spark.createDataFrame([], PAGES), spark.createDataFrame([], EDGES))
    assert empty.count() == 0 and empty.columns == ["page_id", "source", *CORNERS]


def test_regions_in_the_source(spark):
    rows = [(10.0, 20.0, 100.0, 50.0, 0.5), (999.0, 0.0, 5.0, 0.0, 0.4), (-3.0, 5.0, 1e9, 1.0, 0.3)]
    found = spark.createDataFrame(rows, "l double, t double, w double, h double, s double").select(*[v.alias(n) for v, n in zip(O.to_source("l", "t", "w", "h", "s", 2000, 3000), "ltwh", strict=True)])
    assert [tuple(r) for r in found.collect()] == [(20, 40, 200, 100), (1999, 0, 1, 1), (0, 16, 2000, 4)]
