"""Features and scores as the device computes them.  Where they differ from the tested policies, they keep names of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.geometry import Quad, distance
from vellum.functions.numbers import cascade, clamp, weighted

# fixed values: the weights, thresholds and names in this module's expressions have to be these for results to be right


def occupancy(area: Column, single: Column) -> Column:
    return F.when(single, clamp((area - 0.14) / (0.72 - 0.14))).otherwise(clamp((area - 0.24) / (0.68 - 0.24)))


def small_penalty(area: Column, single: Column) -> Column:
    return F.when(single, clamp((F.lit(0.42) - area) / 0.42)).otherwise(clamp((F.lit(0.48) - area) / 0.48))


def border_proximity(unit: Quad, side: Column) -> Column:
    """How near the page comes to the frame: on all sides, or mostly on the outer side of a spread."""

    def near(gap: Column, tolerance: float) -> Column:
        return clamp(F.lit(1.0) - gap / tolerance)

    left, right, top, bottom = unit.left, F.lit(1.0) - unit.right, near(unit.top, 0.30), near(F.lit(1.0) - unit.bottom, 0.30)
    all_sides = (near(left, 0.30) + near(right, 0.30) + top + bottom) / 4.0

    def spread(outer: Column, spine: Column) -> Column:
        return near(outer, 0.26) * 0.36 + top * 0.27 + bottom * 0.27 + near(spine, 0.40) * 0.10

    return F.when(side == "single", all_sides).when(side == "left", spread(left, right)).otherwise(spread(right, left))


def paper_interior(brightness: Column, bright: Column, even: Column, text: Column) -> Column:
    return clamp(clamp(brightness / 210.0) * 0.30 + bright * 0.32 + even * 0.20 + clamp(text / 0.55) * 0.18)


def internal_line(contrast: Column, border: Column, small: Column, continuation: Column) -> Column:
    return clamp((F.lit(1.0) - contrast) * (F.lit(1.0) - border) * 0.42 + small * 0.28 + continuation * 0.30)


def repeated_line(lines: Column) -> Column:
    return cascade((lines >= 5, F.lit(0.92)), (lines >= 3, F.lit(0.74)), (lines >= 2, F.lit(0.52)), otherwise=F.lit(0.0))


def overlap_penalty(unit: Quad, side: Column) -> Column:
    """A half of a spread that reaches past the spine."""
    right, left = (unit.xs[1] + unit.xs[2]) / 2.0, (unit.xs[0] + unit.xs[3]) / 2.0
    return F.when(side == "left", clamp((right - 0.94) / 0.06)).when(side == "right", clamp((F.lit(1.0) - left - 0.94) / 0.06)).otherwise(0.0)


def right_angles(quad: Quad) -> Column:
    total = F.lit(0.0)
    for k in range(4):
        (px, py), (x, y), (nx, ny) = quad.point(k + 3), quad.point(k), quad.point(k + 1)
        ax, ay, bx, by = px - x, py - y, nx - x, ny - y
        size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
        total = total + F.when(size > 0, F.abs((ax * bx + ay * by) / size)).otherwise(0.0)
    return clamp(F.lit(1.0) - total / 4.0)


def edge_distance(quad: Quad, width: float, height: float) -> Column:
    margin = min(width, height) * 0.015
    on_edge = [((x <= margin) | (y <= margin) | (x >= width - margin) | (y >= height - margin)).cast("int") for x, y in zip(quad.xs, quad.ys, strict=True)]
    return F.lit(1.0) - (on_edge[0] + on_edge[1] + on_edge[2] + on_edge[3]) / 4.0


def guide_alignment(quad: Quad, width: float, height: float) -> Column:
    x = F.abs((quad.xs[0] + quad.xs[1] + quad.xs[2] + quad.xs[3]) / 4.0 - width / 2.0) / (width / 2.0)
    y = F.abs((quad.ys[0] + quad.ys[1] + quad.ys[2] + quad.ys[3]) / 4.0 - height / 2.0) / (height / 2.0)
    return clamp(F.lit(1.0) - F.sqrt(x * x + y * y) / F.sqrt(F.lit(2.0)))


def continuation(inside: Column, outside: Column, bright_in: Column, bright_out: Column, samples: Column) -> Column:
    """Whether content goes on outside the boundary; unknown with few samples."""
    text = F.least(clamp(outside / F.greatest(inside, F.lit(0.012))), clamp(outside * 12.0))
    alike = clamp(F.lit(1.0) - F.abs(bright_in - bright_out) / 55.0)
    return F.when(samples < 20, 0.0).otherwise(clamp(text * 0.78 + alike * 0.22))


def clipping_evidence(quad: Quad, width: float, height: float) -> Column:
    """Sides along which the page touches the frame, in halves."""
    margin = min(width, height) * 0.006

    def contact(near, along, extent):
        hit = [near(x, y) for x, y in zip(quad.xs, quad.ys, strict=True)]
        at = [F.when(h, v) for h, v in zip(hit, along, strict=True)]
        count = sum((h.cast("int") for h in hit[1:]), hit[0].cast("int"))
        return F.coalesce((count >= 2) & (F.greatest(*at) - F.least(*at) >= extent), F.lit(False)).cast("int")

    sides = (
        contact(lambda x, y: x <= margin, quad.ys, height * 0.06) + contact(lambda x, y: x >= width - 1 - margin, quad.ys, height * 0.06)
        + contact(lambda x, y: y <= margin, quad.xs, width * 0.06) + contact(lambda x, y: y >= height - 1 - margin, quad.xs, width * 0.06)
    )
    return clamp(sides / 2.0)


def spine_proximity(quad: Quad, spine: Column, strength: Column, width: float) -> Column:
    left, right = (quad.xs[0] + quad.xs[3]) / 2.0, (quad.xs[1] + quad.xs[2]) / 2.0
    return clamp(F.lit(1.0) - F.least(F.abs(left - spine), F.abs(right - spine)) / (width * 0.28)) * strength


def spine_side(quad: Quad, spine: Column) -> Column:
    left, right = (quad.xs[0] + quad.xs[3]) / 2.0, (quad.xs[1] + quad.xs[2]) / 2.0
    return F.when(F.abs(left - spine) <= F.abs(right - spine), "left").otherwise("right")


def two_pages(text_left: Column, text_right: Column, even_left: Column, even_right: Column) -> Column:
    return F.least(text_left, text_right) * 0.72 + F.least(even_left, even_right) * 0.28


def page_side(quad: Quad, side: Column, supports: Column, width: float) -> Column:
    """Where a half's outer edge lies, and how many lines support it."""
    left, right = (quad.xs[3] + quad.xs[0]) / 2.0, (quad.xs[1] + quad.xs[2]) / 2.0
    outer = F.when(side == "left", clamp(F.lit(1.0) - left / (width * 0.62))).otherwise(clamp(F.lit(1.0) - (F.lit(width) - right) / (width * 0.62)))
    return F.when(side == "single", 0.0).otherwise(outer * 0.72 + clamp(supports / 2.0) * 0.28)


def paper_region_score() -> Column:
    return weighted((0.26, "occupancy"), (0.22, "paper"), (0.14, "contrast"), (0.10, "rect"), (0.09, "center"), (0.09, "border"), (0.06, "envelope"), (0.04, "side_score"))


def paper_region_confidence() -> Column:
    return clamp(weighted((0.29, "paper"), (0.21, "contrast"), (0.20, "occupancy"), (0.12, "rect"), (0.10, "center"), (0.08, "envelope")))


def base_scores() -> tuple[Column, Column]:
    """Shape scores of a document and of a book's page, before evidence comes in."""
    document = F.least("area_ratio", F.lit(1.0)) * 0.32 + weighted((0.24, "angle"), (0.10, "rect"), (0.10, "edge"), (0.08, "aspect"), (0.06, "guide"), (0.04, "lines"), (0.06, "contrast"))
    book = F.least("area_ratio", F.lit(0.65)) / 0.65 * 0.18 + weighted((0.08, "angle"), (0.10, "guide"), (0.16, "spine"), (0.15, "text"), (0.09, "even"), (0.12, "curve"), (0.07, "contrast"), (0.05, "lines"))
    return document, book


def component_with_guide(area: Column, center: Column, aspect: Column, guide: Column) -> Column:
    return area * 0.64 + center * 0.18 + clamp(F.lit(1.0) - (aspect - 1.0) / 7.0) * 0.08 + guide * 0.10


def moved_corner(quad: Quad, k: int, outward: list[Column]) -> tuple[Column, Column]:
    """Where the edges before and after corner k meet once each is shifted outward; the corner itself if they are parallel."""

    def line(i: int):
        (ax, ay), (bx, by) = quad.point(i), quad.point(i + 1)
        length = distance(ax, ay, bx, by)
        nx, ny = (by - ay) / length, (ax - bx) / length  # clockwise corners: outside is to the left of the way
        return ax + nx * outward[i % 4], ay + ny * outward[i % 4], bx - ax, by - ay

    (px, py, dx, dy), (qx, qy, ex, ey) = line(k + 3), line(k)
    det = dx * ey - dy * ex
    t = F.when(F.abs(det) > 1e-9, ((qx - px) * ey - (qy - py) * ex) / det)
    return F.coalesce(px + dx * t, quad.xs[k]), F.coalesce(py + dy * t, quad.ys[k])
