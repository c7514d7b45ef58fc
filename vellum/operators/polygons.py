"""The polygon that a page is cut by: as refined, else its raw edges moved outward as far as what is seen of them allows.

Pages and the evidence for their edges are tables of their own: evidence is brought to one row a page by partial
aggregation, and all geometry is columns of doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions.geometry import Quad, all_of, distance
from vellum.functions.numbers import Number, cascade, clamp, col

EDGES = ("top", "right", "bottom", "left")
# fixed values: shares, areas and distances have to be these for results to be right
OWNED, ADJACENT = 0.66, 0.66
AREA_RATIOS = (0.96, 1.70)
PARALLEL = 1e-6
RAW_MARGINS = (0.012, 0.012, 0.070, 0.012)


def by_edge(edges: DataFrame) -> DataFrame:
    """page_id and a struct for each of top, right, bottom and left, null where a page has no such edge.

    edges: page_id, edge, ord, visibility, offset (outward), foreground_beyond, paper_beyond.  Of several rows for an
    edge the one of the smallest ord counts, among equals the smallest of the other columns in that order.
    """
    seen = F.struct("ord", "visibility", "offset", "foreground_beyond", "paper_beyond")
    return edges.groupBy("page_id").agg(*[F.min(F.when(F.col("edge") == e, seen)).alias(e) for e in EDGES])


def shifted(quad: Quad, outward: list[Column]) -> Quad:
    """Where neighbouring edges meet once each is moved outward; null coordinates where they are parallel."""

    def moved(k: int) -> tuple[Column, Column, Column, Column]:
        (ax, ay), (bx, by) = quad.point(k), quad.point(k + 1)
        length = F.greatest(distance(ax, ay, bx, by), F.lit(1.0))
        return ax + (by - ay) / length * outward[k % 4], ay + (ax - bx) / length * outward[k % 4], bx - ax, by - ay

    xs, ys = [], []
    for k in range(4):
        (px, py, dx, dy), (qx, qy, ex, ey) = moved(k + 3), moved(k)
        turn = dx * ey - dy * ex
        along = F.when(F.abs(turn) >= PARALLEL, ((qx - px) * ey - (qy - py) * ex) / turn)
        xs.append(px + dx * along)
        ys.append(py + dy * along)
    return Quad(xs, ys)


def most_outward(quad: Quad, k: int, edge: Column, spine: Column, shorter: Column) -> Column:
    """How far edge k may move: to the frame if it left the picture, to the search region if the page goes on below, else a share of the picture."""
    (ax, ay), (bx, by) = quad.point(k), quad.point(k + 1)
    x, y = (ax + bx) / 2.0, (ay + by) / 2.0
    to_frame = (y, F.col("width") - x, F.col("height") - y, x)[k]
    to_region = (y - F.col("roi_top"), F.col("roi_right") - x, F.col("roi_bottom") - y, x - F.col("roi_left"))[k]
    own = shorter * F.when(spine, P.SPINE_LIMIT).otherwise(P.OUTWARD_LIMIT)
    on_below = F.lit(k == 2) & (edge["foreground_beyond"] | edge["paper_beyond"])
    return cascade((spine, own), (edge["visibility"] == "outOfFrame", F.greatest(own, to_frame)), (on_below, F.greatest(own, to_region)), otherwise=own)


def is_safe(candidate: Quad, raw: Quad) -> Column:
    """Convex on whole pixels, without edges in line, and of an area near the raw one's."""
    known = all_of([v.isNotNull() for v in (*candidate.xs, *candidate.ys)])
    pixels = candidate.mapped(lambda x, _: F.floor(x).cast("double"), lambda _, y: F.floor(y).cast("double"))
    return F.coalesce(known & (candidate.area / F.greatest(raw.area, F.lit(1.0))).between(*AREA_RATIOS) & pixels.is_convex(), F.lit(False))


def safe_polygons(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id, source, x0 to y3: one row a page, all null but page_id where no polygon is safe.

    pages: one row each of page_id, side (left, right or null), width, height, the raw corners x0 to y3 clockwise from the
    top left, the refined ones rx0 to ry3 (null if there are none), accepted (whether refinement was), ownership and
    adjacent of the paper candidate (null if there is none), and the search region roi_left, roi_top, roi_right, roi_bottom.
    edges: see by_edge().  An edge without a row is unknown.  Raw corners that are null or not finite give no polygon.
    """
    raw, refined = Quad.of(), Quad.of("rx", "ry")
    table = pages.join(by_edge(edges), "page_id", "left")
    shorter = F.least("width", "height").cast("double")

    safe, padded = [], []
    for k, name in enumerate(EDGES):
        edge, spine = F.col(name), P.is_spine_edge(F.col("side"), F.lit(name))
        least = shorter * P.outward_margin(F.lit(name), edge["visibility"])
        safe.append(F.least(F.greatest(edge["offset"], least), most_outward(raw, k, edge, spine, shorter)).alias(f"safe{k}"))
        padded.append((shorter * F.when(spine, min(RAW_MARGINS[k], P.SPINE_LIMIT)).otherwise(RAW_MARGINS[k])).alias(f"padded{k}"))
    seen = [F.coalesce(F.col(e)["visibility"], F.lit("unknown")) for e in EDGES]
    evident = F.col("ownership").isNotNull()
    confirmed = all_of([v == "confirmed" for v in seen])
    for v in seen:
        evident = evident | v.isin("confirmed", "weak", "occluded")
    table = table.select("*", *safe, *padded, evident.alias("evident"), confirmed.alias("confirmed"))

    corners = []
    for name, prefix in (("hybrid", "safe"), ("fallback", "padded")):
        polygon = shifted(raw, [F.col(f"{prefix}{k}") for k in range(4)])
        corners += [clamp(v, 0.0, F.col(most).cast("double")).alias(f"{name}_{a}{k}") for a, values, most in (("x", polygon.xs, "width"), ("y", polygon.ys, "height")) for k, v in enumerate(values)]
    table = table.select("*", *corners)

    hybrid, fallback = Quad.of("hybrid_x", "hybrid_y"), Quad.of("fallback_x", "fallback_y")
    finite = F.coalesce(all_of([F.abs(v) < float("inf") for v in (*raw.xs, *raw.ys)]), F.lit(False))
    foreign = (F.coalesce("ownership", F.lit(1.0)) < OWNED) | (F.coalesce("adjacent", F.lit(0.0)) >= ADJACENT)
    has_refined = all_of([v.isNotNull() for v in (*refined.xs, *refined.ys)])
    source = cascade(
        (foreign | ~finite, F.lit(None).cast("string")),
        (F.col("accepted") & has_refined & F.col("confirmed"), "ai_refined"),
        (F.col("evident") & is_safe(hybrid, raw), "ai_hybrid"),
        (is_safe(fallback, raw), "ai_raw_fallback"),
    )
    table = table.withColumn("source", source)
    options = (("ai_refined", refined), ("ai_hybrid", hybrid), ("ai_raw_fallback", fallback))
    chosen = [cascade(*[(F.col("source") == s, (q.xs if a == "x" else q.ys)[k]) for s, q in options]).alias(f"{a}{k}") for k in range(4) for a in "xy"]
    return table.select("page_id", "source", *chosen)


def to_source(left: Number, top: Number, width: Number, height: Number, scale: Number, source_width: Number, source_height: Number) -> list[Column]:
    """A rectangle of the analysed picture in whole pixels of the one it was scaled from, within it and at least a pixel wide and high."""
    out = []
    for low, size, most in ((left, width, source_width), (top, height, source_height)):
        start = clamp(F.floor(col(low) / col(scale)), 0, col(most) - 1.0)
        out.append((start, clamp(F.ceil(col(size) / col(scale)), 1, col(most) - start)))
    (x, w), (y, h) = out
    return [v.cast("long") for v in (x, y, w, h)]
