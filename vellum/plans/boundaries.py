"""Queries over the corners of pages: geometry, crops, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import policies as P
from vellum.functions.numbers import cascade, clamp
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.sources.tables import oracle, view

# fixed values: points of an A4 page's height
A4_HEIGHT = 29.7 * 72.0 / 2.54
W, H = 1000.0, 1400.0


def unit():
    return G.Quad.of().scaled(W, H)


def finer():
    """A second boundary of the same page, a little off."""
    q, jx, jy = G.Quad.of(), F.col("jx"), F.col("jy")
    return G.Quad([q.xs[0] + jx, q.xs[1] - jx, q.xs[2] - jx, q.xs[3] + jx], [q.ys[0] + jy, q.ys[1] + jy, q.ys[2] - jy, q.ys[3] - jy])


def single():
    return F.col("side") == "single"


def polygon_area(spark, d):
    return view(spark, d, "placed_quads").select("page_id", "ord", r6(G.Quad.of().area).alias("area"))


def bounds_extent(spark, d):
    q = G.Quad.of()
    return view(spark, d, "placed_quads").select("page_id", "ord", q.left.alias("left"), q.top.alias("top"), q.width.alias("width"), q.height.alias("height"))


def corner_order(spark, d):
    q = G.Quad.of()
    return view(spark, d, "placed_quads").select("page_id", "ord", q.is_clockwise().alias("ordered"), q.is_convex().alias("convex"))


def manual_corners(spark, d):
    q = G.Quad.of()
    valid = q.inside(0, W, H) & q.is_convex() & (q.area / (W * H) >= 0.01)
    return view(spark, d, "placed_quads").select("page_id", "ord", valid.alias("valid"))


def boundary_sanity(spark, d):
    u = unit()
    return view(spark, d, "placed_quads").select(
        "page_id", "ord", u.is_valid().alias("valid"), G.is_sane(u, single(), F.col("clipping")).alias("sane"), G.is_sane(u, single(), F.col("clipping"), True).alias("capture"),
        G.is_live_sane(u, single()).alias("live"), G.is_content_sane(u).alias("content"),
    )


def boundary_guidance(spark, d):
    stability = F.when(F.col("stable"), 1.0).otherwise(F.col("confidence"))
    return view(spark, d, "placed_quads").select("page_id", "ord", P.guidance(unit(), F.col("confidence"), stability, F.col("clipping")).alias("guidance"))


def bounded_refinement(spark, d):
    c, f = unit(), finer().scaled(W, H)
    dist = c.distances(f)
    reason = P.refinement_rejection(c, f)
    return view(spark, d, "placed_quads").select("page_id", "ord", reason.alias("reason"), r6((dist[0] + dist[1] + dist[2] + dist[3]) / 4.0 * 100.0).alias("delta"), r6(F.when(reason == "none", f.area).otherwise(c.area)).alias("area"))


def crop_cascade(spark, d):
    """Live boundary, else detected paper, else content, else the guide."""
    u, f = unit(), finer().scaled(W, H)
    detected = (F.col("confidence") >= 0.55) & F.col("stable")
    live = (F.col("page_id") % 2 == 0) & G.is_sane(u, single(), F.col("clipping"), True)
    paper = detected & G.is_sane(f, single(), F.col("clipping"))
    content = (F.col("clipping") >= 0.48) & (F.col("ord") % 13 >= 1) & G.is_content_sane(f)
    guide = F.col("page_id") % 5 != 0
    source = cascade((live, "captureLiveBoundary"), (paper, "highResPaperBoundary"), (content, "contentSafe"), (guide, "guideFallback"))
    refined = F.when(live, F.when(paper, P.refinement_rejection(u, f)).otherwise("high_res_boundary_unavailable"))
    return view(spark, d, "placed_quads").select("page_id", "ord", source.alias("source"), refined.alias("refinement"))


def crop_sources(spark, d):
    return crop_cascade(spark, d).groupBy("source", "refinement").agg(F.count(F.lit(1)).alias("n"))


def guide_overlap(spark, d):
    share = P.guide_overlap(G.Quad.of(), finer(), W, H)
    far = P.guide_overlap(G.Quad.of(), G.Quad([F.lit(0.0), F.lit(90.0), F.lit(90.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.col("y2"), F.col("y2")]), W, H)
    return view(spark, d, "placed_quads").select("page_id", "ord", r6(share).alias("near"), r6(far).alias("far"), (far >= 0.35).alias("agrees"))


def search_rois(spark, d):
    q = G.Quad.of()
    dx, dy = F.greatest(q.width * 0.10, F.lit(W * 0.02)), F.greatest(q.height * 0.14, F.lit(H * 0.02))
    sides = (("left", q.left - dx, W), ("top", q.top - dy, H), ("right", q.right + dx, W), ("bottom", q.bottom + dy, H))
    return view(spark, d, "placed_quads").select("page_id", "ord", *[r6(clamp(v, 0.0, most)).alias(n) for n, v, most in sides])


def output_sizes(spark, d):
    w, h = P.output_size(G.Quad.of())
    return view(spark, d, "placed_quads").select("page_id", "ord", w.alias("width"), h.alias("height"))


def boundary_modes(spark, d):
    q, mx, my = G.Quad.of(), W * 0.015, H * 0.015
    seen = (q.xs[0] > mx) & (q.xs[3] > mx) & (q.xs[1] < W - mx) & (q.xs[2] < W - mx) & (q.ys[0] > my) & (q.ys[1] > my) & (q.ys[2] < H - my) & (q.ys[3] < H - my)
    inset = F.when(seen, 0.0).otherwise(0.04)
    return view(spark, d, "placed_quads").select("page_id", "ord", F.when(seen, "detected").otherwise("insetFallback").alias("mode"), inset.alias("low"), (F.lit(1.0) - inset).alias("high"))


def rotated_boundaries(spark, d):
    q = unit().rotated(F.col("ord") % 4 * 90)
    return view(spark, d, "placed_quads").select("page_id", "ord", *[r6(v).alias(n) for k in range(4) for n, v in ((f"x{k}", q.xs[k]), (f"y{k}", q.ys[k]))])


def spread_rois(spark, d):
    """Halves of a spread with an overlap of a tenth, and the boundary within its half."""
    left, start = F.floor(F.col("width") * 0.55 + 0.5), F.floor(F.col("width") * 0.45 + 0.5)
    begin = F.when(F.col("side") == "left", 0.0).otherwise(0.5 - 0.05)
    end = F.when(F.col("side") == "left", 0.5 + 0.05).otherwise(1.0)
    u = unit()
    return view(spark, d, "placed_quads").filter("side <> 'single'").select(
        "page_id", "ord", left.alias("left_width"), start.alias("right_start"), (F.col("width") - start).alias("right_width"),
        r6(clamp((u.left - begin) / (end - begin))).alias("x_low"), r6(clamp((u.right - begin) / (end - begin))).alias("x_high"),
    )


def guide_regions(spark, d):
    """The guide drawn for single pages, for a viewport of any size, and for the halves of a spread."""
    w, h = F.col("x1"), F.col("y2")
    gw = w * 0.78
    gh = F.least(h * 0.68, gw * 1.414)
    left, top = (w - gw) / 2.0 / w, (h - gh) / 2.0 / h
    is_single, is_left = single(), F.col("side") == "left"
    roi = F.when(is_left, 0.0).otherwise(0.5 - 0.05)
    values = (
        F.when(is_single, left).otherwise(roi + F.when(is_left, 0.03).otherwise(0.09) * 0.55),
        F.when(is_single, top).otherwise(0.04),
        F.when(is_single, F.lit(1.0) - left).otherwise(roi + F.when(is_left, F.lit(1 - 0.09)).otherwise(F.lit(1 - 0.03)) * 0.55),
        F.when(is_single, F.lit(1.0) - top).otherwise(F.lit(1 - 0.04)),
    )
    return view(spark, d, "placed_quads").select("page_id", "ord", *[r6(v).alias(n) for n, v in zip(("left", "top", "right", "bottom"), values, strict=True)])


def crop_unrotate_compose(spark, d):
    """A crop drawn on a turned preview, brought back into the original picture, and in whole pixels."""

    def boxed(df, name, *sides):
        # each step is a projection of its own, or the expressions would grow into one another
        return df.withColumns({f"{name}{n}": v for n, v in zip("ltrb", G.crop(*sides), strict=True)})

    def of(name):
        return [F.col(f"{name}{n}") for n in "ltrb"]

    u, turn, one = unit(), F.col("ord") % 4, F.lit(1.0)
    df = view(spark, d, "placed_quads").select("page_id", "ord", u.left.alias("u_l"), u.top.alias("u_t"), u.right.alias("u_r"), u.bottom.alias("u_b"))
    df = boxed(df, "c", *[F.col(f"u_{n}") for n in "ltrb"])
    l, t, r, b = of("c")
    ways = ((t, one - r, one - b, l), (one - r, one - b, l, t), (b, one - l, one - t, r), (one - l, one - t, r, b))
    df = df.withColumns({f"r{n}": F.when(turn == 1, w[0]).when(turn == 2, w[1]).when(turn == 3, w[2]).otherwise(w[3]) for n, w in zip("ltrb", ways, strict=True)})
    df = boxed(df, "i", *of("r"))
    l, t, r, b = of("i")
    df = boxed(df, "w", F.lit(0.1) + F.lit(0.9 - 0.1) * l, F.lit(0.05) + F.lit(0.95 - 0.05) * t, F.lit(0.1) + F.lit(0.9 - 0.1) * r, F.lit(0.05) + F.lit(0.95 - 0.05) * b)
    l, t, r, b = of("w")
    df = df.withColumns({"px_l": clamp(F.floor(l * W).cast("double"), 0, 999).cast("int"), "px_t": clamp(F.floor(t * H).cast("double"), 0, 1399).cast("int")})
    df = df.withColumns({"px_r": clamp(F.ceil(r * W).cast("double"), F.col("px_l") + 1, 1000).cast("int"), "px_b": clamp(F.ceil(b * H).cast("double"), F.col("px_t") + 1, 1400).cast("int")})
    return df.select("page_id", "ord", *[r6(F.col(f"w{n}")).alias(n) for n in "ltrb"], "px_l", "px_t", "px_r", "px_b")


def split_geometry(spark, d):
    """Where a picture is cut at a gutter, with an overlap to both sides."""
    width = F.lit(1000)
    x = clamp(F.floor("x1").cast("double"), 1, 999).cast("int")
    overlap = F.greatest(F.lit(1), F.floor(width * 0.015 + 0.5).cast("int"))
    left, start = F.least(x + overlap, width), F.greatest(x - overlap, F.lit(0))
    return view(spark, d, "placed_quads").select("page_id", "ord", left.alias("left_width"), start.alias("right_start"), (width - start).alias("right_width"))


def pdf_page_sizes(spark, d):
    """The longer edge is as long as an A4 page is high; quarter turns swap the edges."""
    w, h = P.output_size(G.Quad.of())
    swap = F.col("ord") % 2 == 1
    a, b = F.when(swap, h).otherwise(w).cast("double"), F.when(swap, w).otherwise(h).cast("double")
    scale = F.lit(A4_HEIGHT) / F.greatest(a, b)
    turns = F.col("page_id") % 8
    turned = F.when(turns < 4, (turns + F.col("ord")) % 4).otherwise(4 + (turns - 4 + F.col("ord")) % 4)
    return view(spark, d, "placed_quads").select("page_id", "ord", r6(a * scale).alias("width"), r6(b * scale).alias("height"), turned.cast("int").alias("orientation"))


def small_rules(spark, d):
    """Columns of a grid, a clockwise turn, the power of two that a picture is read smaller by."""
    w, h = P.output_size(G.Quad.of())
    longest = F.greatest(w, h)
    sample = F.expr("CAST(1 AS INT)")
    for k in range(1, 6):
        sample = F.when(longest / F.lit(float(1 << (k - 1))) > 256.0, F.lit(1 << k)).otherwise(sample)
    return view(spark, d, "placed_quads").select(
        "page_id", "ord", clamp(F.floor(F.col("x1") / 220.0).cast("double"), 2, 4).cast("int").alias("columns"), ((F.col("ord") % 4 * 90 + 90) % 360).cast("int").alias("turned"), sample.alias("sample")
    )


def crop_differences(spark, d):
    """Crops that differ from a finer one: corners by more than 4 % on average, or area by more than 8 %."""
    u, f = unit(), finer().scaled(W, H)
    dist = u.distances(f)
    mean, area = (dist[0] + dist[1] + dist[2] + dist[3]) / 4.0, F.abs(u.area - f.area)
    return view(spark, d, "placed_quads").filter((mean > 0.04) | (area > 0.08)).select("page_id", "ord", r6(mean).alias("corners"), r6(area).alias("area"))


def initial_corners(spark, d):
    """What a corner editor starts from: the page's own corners, else the guide's."""
    own, guide = F.when(F.col("ord") % 3 != 0, F.col("x0")), F.when(F.col("ord") % 5 != 0, F.lit(30.0))
    source = cascade((own.isNotNull() & F.col("stable"), "manual"), (own.isNotNull(), "finalCrop"), (guide.isNotNull(), "guideFallback"))
    return view(spark, d, "placed_quads").select("page_id", "ord", F.coalesce(own, guide).alias("x"), source.alias("source"))


def ordered_corners(spark, d):
    """Corners in any order, put clockwise from the top left: the upper two by x, then the lower two."""
    shuffled = view(spark, d, "placed_quads").select("page_id", "ord", F.array(*[F.struct(F.col(f"y{k}").alias("y"), F.col(f"x{k}").alias("x")) for k in (2, 0, 3, 1)]).alias("points"))
    ranked = shuffled.withColumn("s", F.array_sort("points"))

    def side(a, b, least):
        one, two = F.get("s", F.lit(a)), F.get("s", F.lit(b))
        return F.when((one["x"] <= two["x"]) == F.lit(least), one).otherwise(two)

    corners = (side(0, 1, True), side(0, 1, False), side(2, 3, False), side(2, 3, True))
    return ranked.select("page_id", "ord", *[c[a].alias(f"{a}{k}") for k, c in enumerate(corners) for a in ("x", "y")])


def representative_corners(spark, d):
    """The points of least and greatest x + y and x - y stand for the corners; the first of equals."""
    q = view(spark, d, "placed_quads").select("page_id", "ord", F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"), F.lit(k).alias("k")) for k in range(4)]).alias("p"))

    def extreme(value, sign):
        best = F.array_min(F.transform("p", lambda p: F.struct((value(p) * sign).alias("v"), p["k"].alias("k"))))
        return best["k"]

    return q.select(
        "page_id", "ord", extreme(lambda p: p["x"] + p["y"], 1).alias("top_left"), extreme(lambda p: p["x"] - p["y"], -1).alias("top_right"),
        extreme(lambda p: p["x"] + p["y"], -1).alias("bottom_right"), extreme(lambda p: p["x"] - p["y"], 1).alias("bottom_left"),
    )


def nearest_edges(spark, d):
    """The edge that is nearest to a point, by distance in lengths of the edge; the first of equals."""
    q = G.Quad.of()
    px, py = F.col("x0") + F.col("jx") * 12.0 + 200.0, F.col("y0") + F.col("jy") * 9.0 + 250.0
    found = []
    for k in range(4):
        (ax, ay), (bx, by) = q.point(k), q.point(k + 1)
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = F.when(length <= 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / length))
        away = G.distance(px, py, ax + dx * t, ay + dy * t)
        found.append(F.struct((away / F.greatest(F.lit(1.0), F.sqrt(length))).alias("d"), F.lit(k).alias("edge"), t.alias("t")))
    best = F.array_min(F.array(*found))
    return view(spark, d, "placed_quads").select("page_id", "ord", best["edge"].alias("edge"), r6(best["t"]).alias("t"), r6(best["d"]).alias("distance"))


def curve_acceptance(spark, d):
    """Whether a curve of offsets may be applied: within limits, without jumps, and keeping the order of rows."""
    height, offsets = F.lit(1400.0), F.array(*[F.col("jx") / 3.0 + F.col("jy") / 16.0 * F.lit(float(k)) for k in range(4)])
    o = F.col("o")
    sizes = F.transform(o, lambda x: F.abs(x))
    jumps = F.zip_with(F.slice(o, 2, 3), F.slice(o, 1, 3), lambda b, a: F.abs(b - a))
    samples = F.sequence(F.lit(0), F.lit(64))

    def mapped(offset, k):
        y = (height - 1.0) * k / 64.0
        return y + offset * F.sin(F.lit(3.141592653589793) * y / (height - 1.0))

    steady = F.forall(o, lambda x: F.forall(samples, lambda k: (mapped(x, k) >= 0) & (mapped(x, k) <= height - 1.0) & ((k == 0) | (mapped(x, k) > mapped(x, k - 1)))))
    ok = (F.col("confidence") >= 0.68) & (F.array_max(sizes) >= height * 0.0015) & (F.array_max(sizes) <= height * 0.025) & (F.array_max(jumps) <= height * 0.0025)
    return view(spark, d, "placed_quads").withColumn("o", offsets).select("page_id", "ord", (ok & steady).alias("accepted"))


def a(xs, ys):
    return "abs(" + " + ".join(f"({xs[i]}*{ys[(i + 1) % 4]} - {xs[(i + 1) % 4]}*{ys[i]})" for i in range(4)) + ")/2e0"


XS, YS = [f"x{k}" for k in range(4)], [f"y{k}" for k in range(4)]
UNIT = "u AS (SELECT *, " + ", ".join(f"x{k}/1000e0 AS ux{k}, y{k}/1400e0 AS uy{k}" for k in range(4)) + " FROM {placed_quads})"
FINER = ("f AS (SELECT *, (x0 + jx)/1000e0 AS fx0, (x1 - jx)/1000e0 AS fx1, (x2 - jx)/1000e0 AS fx2, (x3 + jx)/1000e0 AS fx3,"
         " (y0 + jy)/1400e0 AS fy0, (y1 + jy)/1400e0 AS fy1, (y2 - jy)/1400e0 AS fy2, (y3 - jy)/1400e0 AS fy3 FROM u)")  # fmt: skip


def names(p):
    return [f"{p}x{k}" for k in range(4)], [f"{p}y{k}" for k in range(4)]


def measures(p):
    """left, right, top, bottom, width, height, area, valid of corners named with prefix p, as columns p_..."""
    xs, ys = names(p)
    low = {"l": f"least({', '.join(xs)})", "r": f"greatest({', '.join(xs)})", "t": f"least({', '.join(ys)})", "b": f"greatest({', '.join(ys)})"}

    def crossing(i, j):
        def c(m, n, o):
            return f"(({xs[n]} - {xs[m]})*({ys[o]} - {ys[m]}) - ({ys[n]} - {ys[m]})*({xs[o]} - {xs[m]}))"

        i2, j2 = (i + 1) % 4, (j + 1) % 4
        return f"({c(i, i2, j)}*{c(i, i2, j2)} < 0 AND {c(j, j2, i)}*{c(j, j2, i2)} < 0)"

    return (
        ", ".join(f"{v} AS {p}_{k}" for k, v in low.items()) + f", {low['r']} - {low['l']} AS {p}_w, {low['b']} - {low['t']} AS {p}_h, {a(xs, ys)} AS {p}_a,"
        f" {a(xs, ys)} > 0.000001e0 AND NOT {crossing(0, 2)} AND NOT {crossing(1, 3)} AS {p}_ok"
    )


def sane(p, capture=False):
    more = f" AND {p}_w >= CASE WHEN side = 'single' THEN 0.52e0 ELSE 0.48e0 END AND {p}_h >= 0.56e0 AND {p}_a >= CASE WHEN side = 'single' THEN 0.32e0 ELSE 0.3e0 END" if capture else ""
    return (
        f"({p}_ok AND {p}_l >= 0 AND {p}_t >= 0 AND {p}_r <= 1 AND {p}_b <= 1 AND {p}_w >= CASE WHEN side = 'single' THEN 0.46e0 ELSE 0.42e0 END AND {p}_h >= 0.48e0"
        f" AND {p}_a >= CASE WHEN side = 'single' THEN 0.24e0 ELSE 0.22e0 END AND clipping < 0.88e0{more})"
    )


def content(p):
    return f"({p}_ok AND {p}_l >= 0 AND {p}_t >= 0 AND {p}_r <= 1 AND {p}_b <= 1 AND {p}_w >= 0.68e0 AND {p}_h >= 0.68e0 AND {p}_a >= 0.48e0)"


TURNS = [f"((x{(i + 1) % 4} - x{i})*(y{(i + 2) % 4} - y{(i + 1) % 4}) - (y{(i + 1) % 4} - y{i})*(x{(i + 2) % 4} - x{(i + 1) % 4}))" for i in range(4)]
CONVEX = f"(least({', '.join(TURNS)}) >= 0.000001e0 OR greatest({', '.join(TURNS)}) <= -0.000001e0)"
DIST = [f"sqrt((ux{k} - fx{k})*(ux{k} - fx{k}) + (uy{k} - fy{k})*(uy{k} - fy{k}))" for k in range(4)]
MEAN = f"(({' + '.join(DIST)})/4e0)"
BOTH = f"WITH {UNIT}, {FINER}, m AS (SELECT *, {measures('u')}, {measures('f')} FROM f)"
REJECT = f"""CASE WHEN greatest({', '.join(DIST)}) > 0.05e0 OR {MEAN} > 0.035e0 THEN 'excessive_corner_delta' WHEN f_a < u_a*0.96e0 THEN 'area_shrunk' WHEN f_w < u_w*0.96e0 OR f_h < u_h*0.96e0 THEN 'extent_shrunk'
  WHEN greatest(f_l - u_l, u_r - f_r, f_t - u_t, u_b - f_b) > 0.025e0 THEN 'inward_edge_move' ELSE 'none' END"""


def long_(a_, b_, c_, e_):
    def d_(i, j):
        return f"sqrt((x{i} - x{j})*(x{i} - x{j}) + (y{i} - y{j})*(y{i} - y{j}))"

    return f"least(1000000, greatest(1, floor(greatest({d_(a_, b_)}, {d_(c_, e_)}) + 0.5e0)))::INTEGER"


SIZES = f"z AS (SELECT *, {long_(0, 1, 3, 2)} AS w, {long_(0, 3, 1, 2)} AS h FROM {{placed_quads}})"


def box(p, l, t, r, b):
    """Clamped rectangle as columns pl, pt, pr, pb."""
    def c(x):
        return f"least(1e0, greatest(0e0, {x}))"

    def pair(lo, hi, n, m):
        narrow, wide = f"{c(hi)} - {c(lo)} < 0.01e0", c(f"{c(lo)} + 0.01e0")
        return f"CASE WHEN {narrow} THEN {c(f'{wide} - 0.01e0')} ELSE {c(lo)} END AS {p}{n}, CASE WHEN {narrow} THEN {wide} ELSE {c(hi)} END AS {p}{m}"

    return f"{pair(l, r, 'l', 'r')}, {pair(t, b, 't', 'b')}"


def edge_sql(k):
    i = (k + 1) % 4
    dx, dy = f"(x{i} - x{k})", f"(y{i} - y{k})"
    t = f"CASE WHEN {dx}*{dx} + {dy}*{dy} <= 0 THEN 0e0 ELSE least(1e0, greatest(0e0, ((px - x{k})*{dx} + (py - y{k})*{dy})/({dx}*{dx} + {dy}*{dy}))) END"
    return t, dx, dy


QUERIES = {
    f.__name__: f
    for f in (
        polygon_area, bounds_extent, corner_order, manual_corners, boundary_sanity, boundary_guidance, bounded_refinement, crop_cascade, crop_sources, guide_overlap, search_rois, output_sizes,
        boundary_modes, rotated_boundaries, spread_rois, guide_regions, crop_unrotate_compose, split_geometry, pdf_page_sizes, small_rules, crop_differences, initial_corners, ordered_corners,
        representative_corners, nearest_edges, curve_acceptance,
    )
}
CASCADE = f"""{BOTH}, c AS (SELECT *, page_id % 2 = 0 AND {sane('u', True)} AS live, confidence >= 0.55e0 AND stable AND {sane('f')} AS paper FROM m),
s AS (SELECT page_id, ord, CASE WHEN live THEN 'captureLiveBoundary' WHEN paper THEN 'highResPaperBoundary' WHEN clipping >= 0.48e0 AND ord % 13 >= 1 AND {content('f')} THEN 'contentSafe'
  WHEN page_id % 5 <> 0 THEN 'guideFallback' END AS source, CASE WHEN live THEN CASE WHEN paper THEN {REJECT} ELSE 'high_res_boundary_unavailable' END END AS refinement FROM c)"""
ORACLE = {
    "polygon_area": oracle(f"SELECT page_id, ord, {R(a(XS, YS))} AS area FROM {{placed_quads}}"),
    "bounds_extent": oracle('SELECT page_id, ord, least(x0, x1, x2, x3) AS "left", least(y0, y1, y2, y3) AS top, greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3) AS width, greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) AS height FROM {placed_quads}'),
    "corner_order": oracle(f"SELECT page_id, ord, least({', '.join(TURNS)}) >= 0.0001e0 AS ordered, {CONVEX} AS convex FROM {{placed_quads}}"),
    "manual_corners": oracle(f"SELECT page_id, ord, least({', '.join(XS + YS)}) >= 0 AND greatest({', '.join(XS)}) <= 1000 AND greatest({', '.join(YS)}) <= 1400 AND {CONVEX} AND {a(XS, YS)}/1400000e0 >= 0.01e0 AS valid FROM {{placed_quads}}"),
    "boundary_sanity": oracle(f"""WITH {UNIT}, m AS (SELECT *, {measures('u')} FROM u)
SELECT page_id, ord, u_ok AS valid, {sane('u')} AS sane, {sane('u', True)} AS capture, {content('u')} AS content, u_ok AND u_l >= -0.03e0 AND u_r <= 1.03e0 AND u_t >= -0.03e0 AND u_b <= 1.03e0
  AND u_w >= CASE WHEN side = 'single' THEN 0.52e0 ELSE 0.48e0 END AND u_h >= 0.56e0 AND u_a >= CASE WHEN side = 'single' THEN 0.32e0 ELSE 0.3e0 END AS live FROM m"""),
    "boundary_guidance": oracle(f"""WITH {UNIT}, m AS (SELECT *, {measures('u')}, stable OR confidence >= 0.99e0 AS st FROM u)
SELECT page_id, ord, CASE WHEN NOT u_ok THEN 'notDetected' WHEN st AND clipping >= 0.45e0 THEN 'clipped' WHEN st AND u_a >= 0.88e0 AND (clipping >= 0.2e0 OR u_l < 0.008e0 OR u_t < 0.008e0 OR u_r > 0.992e0 OR u_b > 0.992e0) THEN 'tooClose'
  WHEN u_a <= 0.12e0 OR (u_a <= 0.2e0 AND confidence < 0.7e0) THEN 'tooFar' WHEN confidence < 0.45e0 OR NOT st THEN 'unstable' ELSE 'ready' END AS guidance FROM m"""),
    "bounded_refinement": oracle(f"{BOTH}, r AS (SELECT *, {REJECT} AS reason FROM m) SELECT page_id, ord, reason, {R(MEAN + '*100e0')} AS delta, {R('CASE WHEN reason = ' + chr(39) + 'none' + chr(39) + ' THEN f_a ELSE u_a END')} AS area FROM r"),
    "crop_cascade": oracle(f"{CASCADE} SELECT * FROM s"),
    "crop_sources": oracle(f"{CASCADE} SELECT source, refinement, count(*) AS n FROM s GROUP BY source, refinement"),
    "guide_overlap": oracle(f"""WITH q AS (SELECT *, {measures('')}, least(x0 + jx, x1 - jx, x2 - jx, x3 + jx) AS gl, greatest(x0 + jx, x1 - jx, x2 - jx, x3 + jx) AS gr, least(y0 + jy, y1 + jy, y2 - jy, y3 - jy) AS gt, greatest(y0 + jy, y1 + jy, y2 - jy, y3 - jy) AS gb FROM {{placed_quads}}),
n AS (SELECT *, CASE WHEN _w*_h <= 0 THEN 1e0 ELSE greatest(least(_r, least(1000e0, greatest(0e0, gr + 160e0))) - greatest(_l, least(1000e0, greatest(0e0, gl - 160e0))), 0e0)
  * greatest(least(_b, least(1400e0, greatest(0e0, gb + 224e0))) - greatest(_t, least(1400e0, greatest(0e0, gt - 224e0))), 0e0) / (_w*_h) END AS near,
  CASE WHEN _w*_h <= 0 THEN 1e0 ELSE greatest(least(_r, 250e0) - greatest(_l, 0e0), 0e0) * greatest(least(_b, least(1400e0, greatest(0e0, y2 + 224e0))) - greatest(_t, 0e0), 0e0) / (_w*_h) END AS far FROM q)
SELECT page_id, ord, {R('near')} AS near, {R('far')} AS far, far >= 0.35e0 AS agrees FROM n"""),
    "search_rois": oracle(f"""WITH q AS (SELECT *, {measures('')} FROM {{placed_quads}}), e AS (SELECT *, greatest(_w*0.1e0, 20e0) AS dx, greatest(_h*0.14e0, 28e0) AS dy FROM q)
SELECT page_id, ord, {R('least(1000e0, greatest(0e0, _l - dx))')} AS "left", {R('least(1400e0, greatest(0e0, _t - dy))')} AS top, {R('least(1000e0, greatest(0e0, _r + dx))')} AS "right", {R('least(1400e0, greatest(0e0, _b + dy))')} AS bottom FROM e"""),
    "output_sizes": oracle(f"WITH {SIZES} SELECT page_id, ord, w AS width, h AS height FROM z"),
    "boundary_modes": oracle("""WITH s AS (SELECT *, x0 > 15 AND x3 > 15 AND x1 < 985 AND x2 < 985 AND y0 > 21 AND y1 > 21 AND y2 < 1379 AND y3 < 1379 AS seen FROM {placed_quads})
SELECT page_id, ord, CASE WHEN seen THEN 'detected' ELSE 'insetFallback' END AS mode, CASE WHEN seen THEN 0e0 ELSE 0.04e0 END AS low, 1e0 - CASE WHEN seen THEN 0e0 ELSE 0.04e0 END AS high FROM s"""),
    "rotated_boundaries": oracle(f"WITH {UNIT} SELECT page_id, ord, " + ", ".join(
        f"{R(f'CASE ord % 4 WHEN 1 THEN 1e0 - uy{(k + 3) % 4} WHEN 2 THEN 1e0 - ux{(k + 2) % 4} WHEN 3 THEN uy{(k + 1) % 4} ELSE ux{k} END')} AS x{k}, {R(f'CASE ord % 4 WHEN 1 THEN ux{(k + 3) % 4} WHEN 2 THEN 1e0 - uy{(k + 2) % 4} WHEN 3 THEN 1e0 - ux{(k + 1) % 4} ELSE uy{k} END')} AS y{k}"
        for k in range(4)) + " FROM u"),
    "spread_rois": oracle(f"""WITH {UNIT}, m AS (SELECT *, {measures('u')}, CASE WHEN side = 'left' THEN 0e0 ELSE 0.45e0 END AS s, CASE WHEN side = 'left' THEN 0.55e0 ELSE 1e0 END AS e FROM u WHERE side <> 'single')
SELECT page_id, ord, floor(width*0.55e0 + 0.5e0)::BIGINT AS left_width, floor(width*0.45e0 + 0.5e0)::BIGINT AS right_start, width - floor(width*0.45e0 + 0.5e0)::BIGINT AS right_width,
  {R('least(1e0, greatest(0e0, (u_l - s)/(e - s)))')} AS x_low, {R('least(1e0, greatest(0e0, (u_r - s)/(e - s)))')} AS x_high FROM m"""),
    "guide_regions": oracle(f"""WITH g AS (SELECT *, (x1 - x1*0.78e0)/2e0/x1 AS gl, (y2 - least(y2*0.68e0, x1*0.78e0*1.414e0))/2e0/y2 AS gt, CASE WHEN side = 'left' THEN 0e0 ELSE 0.45e0 END AS roi FROM {{placed_quads}})
SELECT page_id, ord, {R("CASE side WHEN 'single' THEN gl WHEN 'left' THEN roi + 0.03e0*0.55e0 ELSE roi + 0.09e0*0.55e0 END")} AS "left", {R("CASE side WHEN 'single' THEN gt ELSE 0.04e0 END")} AS top,
  {R("CASE side WHEN 'single' THEN 1e0 - gl WHEN 'left' THEN roi + 0.91e0*0.55e0 ELSE roi + 0.97e0*0.55e0 END")} AS "right", {R("CASE side WHEN 'single' THEN 1e0 - gt ELSE 0.96e0 END")} AS bottom FROM g"""),
    "crop_unrotate_compose": oracle(f"""WITH {UNIT}, m AS (SELECT *, {measures('u')}, ord % 4 AS k FROM u), b AS (SELECT *, {box('c', 'u_l', 'u_t', 'u_r', 'u_b')} FROM m),
r AS (SELECT *, CASE k WHEN 1 THEN ct WHEN 2 THEN 1e0 - cr WHEN 3 THEN 1e0 - cb ELSE cl END AS rl, CASE k WHEN 1 THEN 1e0 - cr WHEN 2 THEN 1e0 - cb WHEN 3 THEN cl ELSE ct END AS rt,
  CASE k WHEN 1 THEN cb WHEN 2 THEN 1e0 - cl WHEN 3 THEN 1e0 - ct ELSE cr END AS rr, CASE k WHEN 1 THEN 1e0 - cl WHEN 2 THEN 1e0 - ct WHEN 3 THEN cr ELSE cb END AS rb FROM b),
i AS (SELECT *, {box('i', 'rl', 'rt', 'rr', 'rb')} FROM r), w AS (SELECT *, {box('w', '0.1e0 + 0.8e0*il', '0.05e0 + 0.8999999999999999e0*it', '0.1e0 + 0.8e0*ir', '0.05e0 + 0.8999999999999999e0*ib')} FROM i),
p AS (SELECT *, least(999, greatest(0, floor(wl*1000e0)))::INTEGER AS px_l, least(1399, greatest(0, floor(wt*1400e0)))::INTEGER AS px_t FROM w)
SELECT page_id, ord, {R('wl')} AS l, {R('wt')} AS t, {R('wr')} AS r, {R('wb')} AS b, px_l, px_t, least(1000, greatest(px_l + 1, ceil(wr*1000e0)))::INTEGER AS px_r, least(1400, greatest(px_t + 1, ceil(wb*1400e0)))::INTEGER AS px_b FROM p"""),
    "split_geometry": oracle("WITH s AS (SELECT page_id, ord, least(999, greatest(1, floor(x1)))::INTEGER AS x FROM {placed_quads}) SELECT page_id, ord, least(x + 15, 1000)::INTEGER AS left_width, greatest(x - 15, 0)::INTEGER AS right_start, 1000 - greatest(x - 15, 0)::INTEGER AS right_width FROM s"),
    "pdf_page_sizes": oracle(f"""WITH {SIZES}, s AS (SELECT *, CASE WHEN ord % 2 = 1 THEN h ELSE w END::DOUBLE AS a, CASE WHEN ord % 2 = 1 THEN w ELSE h END::DOUBLE AS b FROM z)
SELECT page_id, ord, {R(f'a*({A4_HEIGHT!r}e0/greatest(a, b))')} AS width, {R(f'b*({A4_HEIGHT!r}e0/greatest(a, b))')} AS height,
  CASE WHEN page_id % 8 < 4 THEN (page_id % 8 + ord) % 4 ELSE 4 + (page_id % 8 - 4 + ord) % 4 END::INTEGER AS orientation FROM s"""),
    "small_rules": oracle(f"""WITH {SIZES} SELECT page_id, ord, least(4, greatest(2, floor(x1/220e0)))::INTEGER AS columns, ((ord % 4*90 + 90) % 360)::INTEGER AS turned,
  CASE WHEN greatest(w, h)/16e0 > 256 THEN 32 WHEN greatest(w, h)/8e0 > 256 THEN 16 WHEN greatest(w, h)/4e0 > 256 THEN 8 WHEN greatest(w, h)/2e0 > 256 THEN 4 WHEN greatest(w, h) > 256 THEN 2 ELSE 1 END AS sample FROM z"""),
    "crop_differences": oracle(f"{BOTH} SELECT page_id, ord, {R(MEAN)} AS corners, {R('abs(u_a - f_a)')} AS area FROM m WHERE {MEAN} > 0.04e0 OR abs(u_a - f_a) > 0.08e0"),
    "initial_corners": oracle("""SELECT page_id, ord, CASE WHEN ord % 3 <> 0 THEN x0 WHEN ord % 5 <> 0 THEN 30e0 END AS x, CASE WHEN ord % 3 <> 0 THEN CASE WHEN stable THEN 'manual' ELSE 'finalCrop' END WHEN ord % 5 <> 0 THEN 'guideFallback' END AS source FROM {placed_quads}"""),
    "ordered_corners": oracle("""WITH p AS (SELECT page_id, ord, unnest([{'y': y0, 'x': x0}, {'y': y1, 'x': x1}, {'y': y2, 'x': x2}, {'y': y3, 'x': x3}]) AS p FROM {placed_quads}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, ord ORDER BY p.y, p.x) AS i FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY page_id, ord, i > 2 ORDER BY p.x, p.y) AS j FROM r)
SELECT page_id, ord, max(p.x) FILTER (i <= 2 AND j = 1) AS x0, max(p.y) FILTER (i <= 2 AND j = 1) AS y0, max(p.x) FILTER (i <= 2 AND j = 2) AS x1, max(p.y) FILTER (i <= 2 AND j = 2) AS y1,
  max(p.x) FILTER (i > 2 AND j = 2) AS x2, max(p.y) FILTER (i > 2 AND j = 2) AS y2, max(p.x) FILTER (i > 2 AND j = 1) AS x3, max(p.y) FILTER (i > 2 AND j = 1) AS y3 FROM s GROUP BY page_id, ord"""),
    "representative_corners": oracle("""WITH p AS (SELECT page_id, ord, unnest([0, 1, 2, 3]) AS k, unnest([x0, x1, x2, x3]) AS x, unnest([y0, y1, y2, y3]) AS y FROM {placed_quads}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, ord ORDER BY x + y, k) AS a, row_number() OVER (PARTITION BY page_id, ord ORDER BY x - y DESC, k) AS b,
  row_number() OVER (PARTITION BY page_id, ord ORDER BY x + y DESC, k) AS c, row_number() OVER (PARTITION BY page_id, ord ORDER BY x - y, k) AS d FROM p)
SELECT page_id, ord, max(k) FILTER (a = 1) AS top_left, max(k) FILTER (b = 1) AS top_right, max(k) FILTER (c = 1) AS bottom_right, max(k) FILTER (d = 1) AS bottom_left FROM r GROUP BY page_id, ord"""),
    "nearest_edges": oracle("WITH p AS (SELECT *, x0 + jx*12e0 + 200e0 AS px, y0 + jy*9e0 + 250e0 AS py FROM {placed_quads}), t AS (SELECT *, " + ", ".join(f"{edge_sql(k)[0]} AS t{k}" for k in range(4)) + " FROM p), e AS ("
        + " UNION ALL ".join(f"SELECT page_id, ord, {k} AS edge, t{k} AS t, sqrt((px - (x{k} + {edge_sql(k)[1]}*t{k}))*(px - (x{k} + {edge_sql(k)[1]}*t{k})) + (py - (y{k} + {edge_sql(k)[2]}*t{k}))*(py - (y{k} + {edge_sql(k)[2]}*t{k})))/greatest(1e0, sqrt({edge_sql(k)[1]}*{edge_sql(k)[1]} + {edge_sql(k)[2]}*{edge_sql(k)[2]})) AS d FROM t" for k in range(4))
        + f") SELECT page_id, ord, edge, {R('t')} AS t, {R('d')} AS distance FROM e QUALIFY row_number() OVER (PARTITION BY page_id, ord ORDER BY d, edge) = 1"),
    "curve_acceptance": oracle("""WITH o AS (SELECT page_id, ord, confidence, unnest([0, 1, 2, 3]) AS i, unnest([jx/3e0 + jy/16e0*0e0, jx/3e0 + jy/16e0*1e0, jx/3e0 + jy/16e0*2e0, jx/3e0 + jy/16e0*3e0]) AS o FROM {placed_quads}),
s AS (SELECT page_id, ord, i, o, k, 1399e0*k/64e0 + o*sin(3.141592653589793e0*(1399e0*k/64e0)/1399e0) AS y FROM o, range(65) r(k)),
p AS (SELECT page_id, ord, i, min(y) >= 0 AND max(y) <= 1399 AND coalesce(bool_and(y > b), true) AS ok FROM (SELECT *, lag(y) OVER (PARTITION BY page_id, ord, i ORDER BY k) AS b FROM s) GROUP BY page_id, ord, i),
j AS (SELECT page_id, ord, any_value(confidence) AS c, max(abs(o)) AS m, max(abs(o - b)) AS jump FROM (SELECT *, lag(o) OVER (PARTITION BY page_id, ord ORDER BY i) AS b FROM o) GROUP BY page_id, ord),
g AS (SELECT page_id, ord, bool_and(ok) AS ok FROM p GROUP BY page_id, ord)
SELECT page_id, ord, c >= 0.68e0 AND m >= 1400*0.0015e0 AND m <= 1400*0.025e0 AND jump <= 1400*0.0025e0 AND ok AS accepted FROM j JOIN g USING (page_id, ord)"""),
}
