"""Outlines of pages: points, columns and curves are rows, so a page's outline is never one value that has to fit a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import native as N
from vellum.functions import stats as S
from vellum.functions.geometry import Quad, distance
from vellum.functions.numbers import cascade, clamp

# fixed values: shares of the shorter side by which an edge may move outward, at the spine and elsewhere
SPINE_LIMIT, OUTWARD_LIMIT = 0.055, 0.10
# fixed values: how far beyond an edge's ends its points may lie, and the share of them that an envelope covers
END_TOLERANCE, COVERED = 0.08, 0.88
# fixed values: what counts as flat, and the share of a curve that is left out at each end
FLAT, END_TRIM = 0.0015, 0.10


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def chord(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(place along the chord from a to b, 0 to 1; distance from that place)."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square <= 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / square))
    return t, distance(px, py, ax + dx * t, ay + dy * t)


def per_edge(points: DataFrame, sheets: DataFrame, values) -> DataFrame:
    """One row per point and edge of its sheet; ``values`` makes named columns of (quad, edge number)."""
    q = Quad.of()
    edges = F.array(*[F.struct(F.lit(k).alias("edge"), *[v.alias(n) for n, v in values(q, k).items()]) for k in range(4)])
    return points.join(sheets, "page_id").select("page_id", "pos", "px", "py", "side", "width", "height", F.explode(edges).alias("e")).select("*", "e.*").drop("e")


def envelopes(points: DataFrame, sheets: DataFrame) -> DataFrame:
    """Corners after each edge moved out to where it has nearly all of the outline's points inside, and how well the outline keeps to these edges.

    Points: page_id, pos, px, py.  Sheets: page_id, x0 to y3, side, width, height.  A high percentile stands for an edge,
    so fingers and clips do not become one.  Pages of fewer than four points have no envelope.
    """

    def projected(q: Quad, k: int) -> dict[str, Column]:
        (ax, ay), (bx, by) = q.point(k), q.point(k + 1)
        length = F.greatest(distance(ax, ay, bx, by), F.lit(1.0))
        tx, ty = (bx - ax) / length, (by - ay) / length
        x, y = F.col("px") - ax, F.col("py") - ay
        return {"length": length, "along": x * tx + y * ty, "out": x * ty - y * tx}

    at = per_edge(points, sheets, projected)
    near = F.col("along").between(-F.col("length") * END_TOLERANCE, F.col("length") * (1.0 + END_TOLERANCE)) & (F.col("out") >= 0)
    spine = F.coalesce(((F.col("side") == "left") & (F.col("edge") == 1)) | ((F.col("side") == "right") & (F.col("edge") == 3)), F.lit(False))
    limit = F.least("width", "height") * F.when(spine, SPINE_LIMIT).otherwise(OUTWARD_LIMIT)
    moved = at.groupBy("page_id", "edge").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.percentile(F.when(near, F.col("out")), COVERED), F.lit(0.0)).alias("out"), F.max(limit).alias("limit"))
    moved = moved.filter("n >= 4").groupBy("page_id").agg(*[F.max(F.when(F.col("edge") == k, clamp("out", 0.0, "limit"))).alias(f"out{k}") for k in range(4)])
    q = Quad.of()
    corners = [v.alias(f"{n}{k}") for k in range(4) for n, v in zip(("x", "y"), N.moved_corner(q, k, [F.col(f"out{k}") for k in range(4)]), strict=True)]
    wide = sheets.join(moved, "page_id").select("page_id", "side", "width", "height", *corners)

    def across(q: Quad, k: int) -> dict[str, Column]:
        (ax, ay), (bx, by) = q.point(k), q.point(k + 1)
        length = F.greatest(distance(ax, ay, bx, by), F.lit(1.0))
        return {"off": F.abs((by - ay) * F.col("px") - (bx - ax) * F.col("py") + bx * ay - by * ax) / length}

    off = per_edge(points, wide, across)
    keys = ["page_id", "edge"]
    scale = off.groupBy(*keys).agg(F.greatest(F.percentile("off", 0.75), F.lit(1.0)).alias("scale"), F.count(F.lit(1)).alias("n"))
    shares = off.join(scale, keys).groupBy(*keys, "n").agg((F.count_if(F.col("off") <= F.col("scale") * 0.45) / F.col("n")).alias("share"))
    kept = shares.groupBy("page_id").agg(F.when(F.max("n") >= 8, clamp(F.avg("share"))).otherwise(0.0).alias("consistency"))
    return wide.join(kept, "page_id")


def narrow_connections(columns: DataFrame) -> DataFrame:
    """Per page how much a mask narrows between its centre and the spine: 0 for even columns, 1 where it breaks off.

    Columns: page_id, x, filled (pixels of the mask), centre (its column), last (the last column), side (null: no spine).
    """
    way = F.when(F.col("side") == "left", (F.col("x") >= F.col("centre")) & (F.col("x") < F.col("last"))).otherwise((F.col("x") <= F.col("centre")) & (F.col("x") > 0))
    w = W.partitionBy("page_id")
    passed = columns.filter(F.col("side").isNotNull() & way).select("page_id", "filled", F.row_number().over(w.orderBy("x")).alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    trim = F.greatest(F.lit(1), half_up(F.col("n") * 0.12))
    core = passed.filter((F.col("n") >= 8) & (F.col("at") > trim) & (F.col("at") <= F.col("n") - trim)).groupBy("page_id")
    told = core.agg(F.count(F.lit(1)).alias("n"), F.percentile("filled", 0.75).alias("high"), F.percentile("filled", 0.10).alias("low")).filter("n >= 4")
    penalty = clamp(F.lit(1.0) - F.col("low") / F.greatest(F.col("high"), F.lit(1.0)))
    return columns.select("page_id").distinct().join(told.select("page_id", penalty.alias("penalty")), "page_id", "left").fillna(0.0, ["penalty"])


def native_spines(columns: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, x, strength) of spines told from the darkest column and from upright lines; pages without one have no row.

    Columns: page_id, x, mean (luminance), of which those between 8 % and 92 % of the width count, every third.  Lines:
    page_id, ord, ax, ay, bx, by.
    """
    first, last = int(width * 0.08 + 0.5), int(width * 0.92 + 0.5)
    offset = max(6, int(width * 0.045 + 0.5))
    seen = columns.filter(F.col("x").between(first, last) & ((F.col("x") - first) % 3 == 0))
    dark = F.min(F.struct("mean", "x")).over(W.partitionBy("page_id"))
    seen = seen.withColumn("dark", dark)
    left, right = F.greatest(F.col("dark.x") - offset, F.lit(first)), F.least(F.col("dark.x") + offset, F.lit(last))
    beside = [F.min_by("mean", F.struct(F.abs(F.col("x") - to), F.col("x"))) for to in (left, right)]
    shade = seen.groupBy("page_id").agg(F.first("dark").alias("dark"), ((beside[0] + beside[1]) / 2.0).alias("beside"))
    shade = shade.select("page_id", F.col("dark.x").alias("dark"), clamp((F.col("beside") - F.col("dark.mean")) / 70.0).alias("shadow"))
    dx, dy, x = F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")), (F.col("ax") + F.col("bx")) / 2.0
    central = clamp(F.lit(1.0) - F.abs(x - width / 2.0) / (width / 2.0))
    upright = lines.filter((dy >= height * 0.28) & (dy >= dx * 2.2) & x.between(float(first), float(last)))
    line = F.struct(clamp(dy / float(height) * (central * 0.45 + 0.55)).alias("strength"), (-F.col("ord")).alias("turn"), x.alias("x"))
    found = shade.join(upright.groupBy("page_id").agg(F.max(line).alias("line")), "page_id", "left")
    strong = F.coalesce("line.strength", F.lit(0.0))
    place = cascade(
        (F.col("line").isNull(), F.col("dark").cast("double")),
        ((F.col("shadow") >= 0.22) & (F.abs(F.col("line.x") - F.col("dark")) < width * 0.10), F.col("line.x") * 0.55 + F.col("dark") * 0.45),
        (strong > F.col("shadow"), F.col("line.x")),
        otherwise=F.col("dark").cast("double"),
    )
    return found.select("page_id", place.alias("x"), F.greatest("shadow", strong).alias("strength")).filter("strength >= 0.28")


def central(curves: DataFrame, *keys: str) -> DataFrame:
    """Points (x, off) of curves without a tenth at each end."""
    w = W.partitionBy(*keys)
    counted = curves.filter(F.col("off").isNotNull()).withColumns({"at": F.row_number().over(w.orderBy("x")), "n": F.count(F.lit(1)).over(w)})
    trim = F.least(half_up(F.col("n") * END_TRIM), F.floor((F.col("n") - 1) / 2))
    return counted.filter((F.col("at") > trim) & (F.col("at") <= F.col("n") - trim))


def curve_signs(curves: DataFrame, height: float) -> DataFrame:
    """(page_id, curve, magnitude, direction) of curves (page_id, curve, x, off): the 90 % rank of offsets in heights, and the sign of their median (null: none)."""
    kept = central(curves, "page_id", "curve").groupBy("page_id", "curve")
    told = kept.agg(F.array_sort(F.collect_list(F.abs("off"))).alias("sizes"), F.percentile("off", 0.5).alias("median"), F.first("n").alias("n"))
    sign = F.when((F.col("n") >= 3) & (F.size("sizes") >= 3) & (F.abs("median") > 1e-6), F.signum("median").cast("int"))
    return told.select("page_id", "curve", (S.nearest_rank(F.col("sizes"), 0.90) / height).alias("magnitude"), sign.alias("direction"))


def fused_curves(signs: DataFrame) -> DataFrame:
    """What a page's curves (0: upper edge, 1: lower edge, from 2 on: lines of text) say together about its curvature.

    Directions of curves that are nearly flat do not vote; of lines of text the first four do.
    """
    top, bottom, inner = F.col("curve") == 0, F.col("curve") == 1, F.col("curve") >= 2
    votes = F.col("magnitude") >= FLAT * 0.7

    def ballots(of: Column, sign: int) -> Column:
        return F.count_if(of & votes & (F.col("direction") == sign))

    outer = top | bottom
    strongest = F.max_by("direction", F.when(inner, F.struct(F.col("magnitude"), -F.col("curve"))))
    t = signs.groupBy("page_id").agg(
        F.coalesce(F.max(F.when(top, F.col("magnitude"))), F.lit(0.0)).alias("top"), F.coalesce(F.max(F.when(bottom, F.col("magnitude"))), F.lit(0.0)).alias("bottom"),
        F.max(F.when(top, F.col("direction"))).alias("top_sign"), F.max(F.when(bottom, F.col("direction"))).alias("bottom_sign"),
        F.coalesce(F.percentile(F.when(inner, F.col("magnitude")), 0.5), F.lit(0.0)).alias("internal"), F.count_if(inner & (F.col("magnitude") >= FLAT)).alias("n_internal"),
        ballots(outer, 1).alias("gp"), ballots(outer, -1).alias("gn"), ballots(inner & (F.col("curve") < 6), 1).alias("ip"), ballots(inner & (F.col("curve") < 6), -1).alias("in_"), strongest.alias("inner_sign"),
    )

    def split(p: str, n: str) -> Column:
        return (F.col(p) > 0) & (F.col(n) > 0) & (S.consistency(F.col(p), F.col(n)) < 0.67)

    def sure(p: str, n: str) -> Column:
        return (F.col(p) + F.col(n) >= 2) & (F.col(p) != F.col(n)) & (S.consistency(F.col(p), F.col(n)) >= 0.67)

    against = sure("gp", "gn") & sure("ip", "in_") & ((F.col("gp") > F.col("gn")) != (F.col("ip") > F.col("in_")))
    contour_sign = F.when(F.col("top") >= F.col("bottom"), F.col("top_sign")).otherwise(F.col("bottom_sign"))
    t = t.withColumns({
        "contour": F.greatest("top", "bottom"), "consistency": S.consistency(F.col("gp") + F.col("ip"), F.col("gn") + F.col("in_")), "n_geometry": (F.col("top") >= FLAT).cast("int") + (F.col("bottom") >= FLAT).cast("int"),
        "conflict": split("gp", "gn") | split("ip", "in_") | against, "agree": F.coalesce(contour_sign == F.col("inner_sign"), F.lit(False)),
    })
    supported = (F.col("n_geometry") >= 2) | ((F.col("n_geometry") >= 1) & (F.col("n_internal") >= 1) & F.col("agree"))
    mild = (F.col("contour") >= FLAT) & ~F.col("conflict") & (F.col("consistency") >= 0.67) & supported
    return t.select("page_id", "top", "bottom", "internal", "contour", "consistency", "n_geometry", "n_internal", "agree", "conflict", mild.alias("mild"))


def clamped_contours(curves: DataFrame, width: int, height: float, cap: float = 0.006) -> DataFrame:
    """Curves held within ``cap`` heights and the 90 % rank of their central offsets, and led to nothing at both ends."""
    keys = ["page_id", "curve"]
    inside = curves.filter(F.col("off").isNotNull() & (F.col("x") >= half_up(F.lit(width * END_TRIM))) & (F.col("x") < width - half_up(F.lit(width * END_TRIM))))
    limits = inside.groupBy(*keys).agg(F.least(F.lit(height * cap), S.nearest_rank(F.array_sort(F.collect_list(F.abs("off"))), 0.90)).alias("limit"))
    taper = max(2, int(width * 0.08 + 0.5))
    weight = F.least(F.lit(1.0), F.least(F.col("x"), F.lit(width - 1) - F.col("x")) / float(taper))
    held = curves.join(limits, keys, "left").withColumn("limit", F.coalesce("limit", F.lit(0.0)))
    return held.select(*keys, "x", (clamp("off", -F.col("limit"), "limit") * weight).alias("off"))


def boundaries_of_outlines(points: DataFrame, sheets: DataFrame) -> DataFrame:
    """(page_id, edge, n, points) of each edge's points in order, from corner to corner, those within half a pixel of the last one left out.

    A point belongs to the edge nearest to it in lengths of the edge, the first of equals.  Pages have no rows if they
    have fewer than 12 points, an edge with fewer than two, or corners that enclose nothing or cross.
    """

    def placed(q: Quad, k: int) -> dict[str, Column]:
        (ax, ay), (bx, by) = q.point(k), q.point(k + 1)
        t, away = chord(F.col("px"), F.col("py"), ax, ay, bx, by)
        return {"away": away / F.greatest(F.lit(1.0), distance(ax, ay, bx, by)), "t": t}

    near = per_edge(points, sheets, placed).groupBy("page_id", "pos").agg(F.min(F.struct("away", "edge", "t", "px", "py")).alias("e"))
    sides = near.groupBy("page_id", "e.edge").agg(F.array_sort(F.collect_list(F.struct("e.t", "pos", F.col("e.px").alias("x"), F.col("e.py").alias("y")))).alias("p"))
    w = W.partitionBy("page_id")
    sides = sides.withColumns({"all": F.sum(F.size("p")).over(w), "least": F.min(F.size("p")).over(w), "edges": F.count(F.lit(1)).over(w)}).filter("all >= 12 AND least >= 2 AND edges = 4")
    q = Quad.of()
    corner = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in zip(q.xs, q.ys, strict=True)])
    sides = sides.join(sheets.filter(q.is_valid()).select("page_id", corner.alias("c")), "page_id")
    ends = F.get("c", F.col("edge")), F.get("c", (F.col("edge") + 1) % 4)
    way = F.concat(F.array(ends[0]), F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array(ends[1]))

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when(distance(last["x"], last["y"], p["x"], p["y"]) > 0.5, F.concat(kept, F.array(p))).otherwise(kept)

    kept = F.aggregate(F.slice("way", 2, 1 << 20), F.slice("way", 1, 1), step)
    return sides.select("page_id", "edge", way.alias("way")).select("page_id", "edge", kept.alias("points")).select("page_id", "edge", F.size("points").alias("n"), "points")


def lattice(sheets: DataFrame) -> DataFrame:
    """19 by 19 places within the bounds of each sheet, of which those inside it remain: page_id, x, y."""
    q, steps = Quad.of(), F.sequence(F.lit(1), F.lit(19))

    def edge(of: Column, size: str) -> Column:
        return F.least(F.greatest(half_up(of).cast("int"), F.lit(0)), F.col(size) - 1)

    box = sheets.withColumns({"x_low": edge(q.left, "width"), "x_high": edge(q.right, "width"), "y_low": edge(q.top, "height"), "y_high": edge(q.bottom, "height")})
    cells = box.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    cells = cells.withColumns({"x": (F.col("x_low") + F.floor((F.col("x_high") - F.col("x_low")) * F.col("j") / 20)).cast("int"), "y": (F.col("y_low") + F.floor((F.col("y_high") - F.col("y_low")) * F.col("i") / 20)).cast("int")})
    return cells.filter(q.holds(F.col("x"), F.col("y"))).select("page_id", "x", "y")


def region_signals(samples: DataFrame) -> DataFrame:
    """Text density, evenness, mean and bright share of samples (page_id, brightness, edge) of a region."""
    return samples.groupBy("page_id").agg(
        clamp(F.count_if("edge") / F.count(F.lit(1)) * 9.0).alias("text"), clamp(F.lit(1.0) - F.stddev_pop("brightness") / 90.0).alias("even"),
        F.avg("brightness").alias("mean"), (F.count_if(F.col("brightness") >= 150.0) / F.count(F.lit(1))).alias("bright"),
    )


def text_curves(boxes: DataFrame, region: Quad, most: int = 24, used: int = 8) -> DataFrame:
    """Of a page's boxes (page_id, ord, x, y, w, h) that look like lines of text the ``most`` widest, ranked; ``used`` of them are."""
    fits = (F.col("w") >= region.width * 0.18) & (F.col("h") <= F.greatest(F.lit(4.0), region.height * 0.08)) & (F.col("x") < region.right) & (F.col("x") + F.col("w") > region.left)
    lines = boxes.filter(fits & (F.col("y") >= region.top) & (F.col("y") + F.col("h") <= region.bottom))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("w"), "ord"))
    return lines.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("used", F.col("rank") <= used)
