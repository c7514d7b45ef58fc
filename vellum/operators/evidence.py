"""Evidence around a page's edges: samples of a picture, and what they say together.

Samples are looked up in pixels by whoever has them; places to look at come from edge_places() and band_places().  The
few samples of a line along an edge are arrays of one row, so that nothing is sorted or shuffled; those of a band are rows.

Steps over a line's arrays are written out sample by sample.  The long ones have a function over an array column (a count, a
transform) among them: that keeps them out of whole-stage code, where each would be one method too long for the JVM to compile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import native as N
from vellum.functions.geometry import Quad, distance
from vellum.functions.numbers import clamp
from vellum.operators.outlines import OUTWARD_LIMIT, SPINE_LIMIT, half_up

# fixed values: samples of an edge, the step of the search and the distance of probes in shares of the shorter side
SAMPLES, STEP, PROBE = 13, 0.003, 0.004
# fixed values: what a sample and an edge need to count, and what is too much
SAMPLE_EVIDENCE, EDGE_SUPPORT, EDGE_EVIDENCE, OCCLUDED = 0.22, 0.38, 0.24, 0.48
# fixed values: robust fits - deviations that are in, the share that is trimmed, the jump that breaks an edge
DEVIATIONS, TRIM, JUMP = 2.8, 0.18, 0.34
# fixed values: what lies below a page - grey levels, colour, and shares that tell
BELOW_EDGE, BELOW_DARK, BELOW_PAPER, BELOW_CHROMA, BELOW_FOREGROUND, BELOW_CONTINUES = 28.0, 112.0, 135.0, 38.0, 0.018, 0.45
# fixed values: eligibility of paper regions
REGION_ENVELOPE, REGION_ASPECT, REGION_VERTICES = 0.78, 8.0, (4, 28)


def outward_limit(edge: Column) -> Column:
    """How far an edge may move, in pixels; of side, width and height."""
    spine = F.coalesce(((F.col("side") == "left") & (edge == 1)) | ((F.col("side") == "right") & (edge == 3)), F.lit(False))
    return F.least("width", "height") * F.when(spine, SPINE_LIMIT).otherwise(OUTWARD_LIMIT)


def edge_places(sheets: DataFrame) -> DataFrame:
    """Where to look for the edges of sheets: page_id, edge, limit, step, offset, and in arrays of SAMPLES the points on, inside and outside a line that far out.

    The points beside the line are null where one of the two is not well inside the picture.
    """
    q, size = Quad.of(), F.least("width", "height")
    edges = []
    for k in range(4):
        (ax, ay), (bx, by) = q.point(k), q.point(k + 1)
        length = F.greatest(distance(ax, ay, bx, by), F.lit(1.0))
        edges.append(F.struct(F.lit(k).alias("edge"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), ((by - ay) / length).alias("nx"), ((ax - bx) / length).alias("ny"), outward_limit(F.lit(k)).alias("limit")))
    step, probe = F.greatest(F.lit(1.0), size * STEP), F.greatest(F.lit(2.0), size * PROBE)
    # a sheet of some 100 bytes turns into 1,600 samples: sheets are dealt out, however few files or row groups they come from
    sheets = sheets.repartition(4 * sheets.sparkSession.sparkContext.defaultParallelism, "page_id")
    at = sheets.select("page_id", "width", "height", step.alias("step"), probe.alias("probe"), F.explode(F.array(*edges)).alias("e")).select("page_id", "width", "height", "step", "probe", "e.*")
    at = at.withColumn("offset", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("limit") + 0.1) / F.col("step")).cast("int")), lambda s: s * F.col("step"))))
    at = at.select(
        "page_id", "edge", "limit", "step", "offset", *[(F.col(f"n{c}") * F.col("probe")).alias(f"probe_{c}") for c in "xy"], F.struct("width", "height").alias("size"),
        *[each(f"a{c} + (b{c} - a{c})*({{k}}e0/{SAMPLES + 1}e0) + n{c}*offset", 1).alias(f"on_{c}") for c in "xy"],
    )
    pixel = {f"{side}_{c}": f"int(floor(get(on_{c}, {{k}}) {sign} probe_{c} + 0.5e0))" for side, sign in (("in", "-"), ("out", "+")) for c in "xy"}
    inside = " AND ".join(f"least({pixel[f'in_{c}']}, {pixel[f'out_{c}']}) >= 1 AND greatest({pixel[f'in_{c}']}, {pixel[f'out_{c}']}) < size.{of} - 1" for c, of in (("x", "width"), ("y", "height")))
    return at.select(
        "page_id", "edge", "limit", "step", "offset", *[F.transform(f"on_{c}", lambda v: half_up(v).cast("int")).alias(c) for c in "xy"],
        *[each(f"CASE WHEN {inside} THEN {of} END").alias(name) for name, of in pixel.items()],
    )


def each(text: str, first: int = 0) -> Column:
    """The array of an SQL expression for each sample; {k} is its number, from first on."""
    return F.expr(_each(text, first))


def _each(text: str, first: int = 0) -> str:
    return f"array({', '.join(text.format(k=k) for k in range(first, first + SAMPLES))})"


def _ordered(of: str) -> str:
    """An array's values in order, infinity for those that are null."""
    return f"sort_array({_each(f"coalesce(get({of}, {{k}}), double('inf'))")})"


def _median(of: str) -> Column:
    """The median of the n values of an array that are not null."""
    return F.expr(f"get({_ordered(of)}, shiftright(n - 1, 1))*0.5e0 + get({_ordered(of)}, shiftright(n, 1))*0.5e0")


def _count(of: str, condition: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(of, condition))


def _apart(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    return f"sqrt({' + '.join(f'({x} - {y})*({x} - {y})' for x, y in zip(a, b, strict=True))})"


def edge_evidence(samples: DataFrame) -> DataFrame:
    """Per page_id, edge and offset of samples: score, support, continuity and occlusion.

    Samples are arrays in order along the edge (colours il ia ib inside and ol oa ob outside, gradient); where a colour is null there is no sample, and lines without any are left out.
    A sample scores by how its two sides differ; those off the median score, or of a colour unlike the inside's, do not
    count, and jumps between those that do break the edge.
    """
    keys = ["page_id", "edge", "limit", "step", "offset"]
    inside, outside = (tuple(f"get({side}{c}, {{k}})" for c in "lab") for side in "io")
    score = f"{_apart(inside, outside)}/58e0*0.5e0 + abs({inside[0]} - {outside[0]})/52e0*0.25e0 + get(gradient, {{k}})/96e0*0.25e0"
    s = samples.select(*keys, "il", "ia", "ib", each(f"CASE WHEN {inside[0]} IS NOT NULL THEN least(greatest({score}, 0e0), 1e0) END").alias("score"), _count("il", lambda v: v.isNotNull()).alias("n"))
    support = _count("score", lambda v: v >= SAMPLE_EVIDENCE) / F.nullif("n", F.lit(0))
    s = s.select(*keys, "n", "score", "il", "ia", "ib", support.alias("support"), *[_median(of).alias(m) for of, m in (("score", "ms"), ("il", "ml"), ("ia", "ma"), ("ib", "mb"))])
    s = s.select(*keys, "n", "score", "support", F.transform("score", lambda v: F.abs(v - F.col("ms"))).alias("ds"), each(_apart(inside, ("ml", "ma", "mb"))).alias("colour"))
    s = s.withColumns({"spread": F.greatest(F.lit(0.025), _median("ds")), "mc": _median("colour")})
    s = s.withColumn("dc", F.transform("colour", lambda v: F.abs(v - F.col("mc")))).withColumn("wide", F.greatest(F.lit(2.0), _median("dc")))
    is_in = f"get(ds, {{k}}) <= spread*{DEVIATIONS}e0 AND get(colour, {{k}}) <= mc + wide*{DEVIATIONS}e0"
    s = s.select(*keys, "n", "support", each(f"CASE WHEN {is_in} THEN get(score, {{k}}) END").alias("kept"))
    jumps = [f"CASE WHEN abs(get(kept, {k}) - coalesce({', '.join(f'get(kept, {j})' for j in range(k - 1, -1, -1))})) > {JUMP}e0 THEN 1 ELSE 0 END" for k in range(1, SAMPLES)]
    s = s.select(*keys, "n", "support", F.expr(_ordered("kept")).alias("ordered"), _count("kept", lambda v: v.isNotNull()).alias("inliers"), F.expr(" + ".join(jumps)).alias("jumps"))
    s = s.withColumn("cut", F.floor(F.col("inliers") * TRIM).cast("int"))
    middle = F.expr(" + ".join(f"CASE WHEN cut <= {k} AND inliers - cut > {k} THEN get(ordered, {k}) ELSE 0e0 END" for k in range(SAMPLES)))
    broken = F.when(F.col("inliers") < 2, 1.0).otherwise(F.col("jumps") / (F.col("inliers") - 1))
    t = s.withColumns({"broken": broken, "score": F.when(F.col("inliers") > 0, middle / (F.col("inliers") - F.col("cut") * 2)).otherwise(0.0)})
    occlusion = clamp((F.lit(1.0) - F.col("inliers") / F.nullif("n", F.lit(0))) * 0.70 + F.col("broken") * 0.30)
    found = F.struct(*keys, "score", "support", clamp(F.lit(1.0) - F.col("broken")).alias("continuity"), occlusion.alias("occlusion"))
    # not a filter: that would go down to the samples, and all would be computed twice
    return t.select(F.inline(F.when(F.col("n") > 0, F.array(found))))


def edge_moves(evidence: DataFrame) -> DataFrame:
    """Per page and edge how far it moves outward: to the best evidence (the first of equals), held back where that is unsure; a bottom edge behind something stays."""
    sure = clamp(F.col("score") + F.col("offset") / F.col("limit") * 0.04)
    found = F.when(F.col("support") >= EDGE_SUPPORT, F.struct(sure.alias("sure"), (-F.col("offset")).alias("near"), "score", "continuity", "occlusion", "support", "offset"))
    best = evidence.groupBy("page_id", "edge", "limit").agg(F.max(found).alias("b"))

    def of(name: str, otherwise: float) -> Column:
        return F.coalesce(F.col(f"b.{name}"), F.lit(otherwise))

    held = (F.col("edge") == 2) & (of("occlusion", 1.0) > OCCLUDED)
    offset = F.when(held, 0.0).otherwise(of("offset", 0.0))
    reliable = ~held & F.coalesce(F.col("b.score") >= EDGE_EVIDENCE, F.lit(False)) & (of("occlusion", 1.0) <= OCCLUDED)
    safety = clamp(clamp((of("sure", 0.0) - 0.18) / 0.34) * 0.42 + clamp(of("continuity", 0.0)) * 0.18 + 0.20 + 0.14 + (F.lit(1.0) - clamp(of("occlusion", 1.0))) * 0.06)
    best = best.select("page_id", "edge", offset.alias("wanted"), F.least(offset, F.col("limit") * safety).alias("offset"), of("sure", 0.0).alias("evidence"), reliable.alias("reliable"))
    return best.withColumn("conservative", F.col("offset") + 0.1 < F.col("wanted")).drop("wanted")


def below_bottom(samples: DataFrame) -> DataFrame:
    """Whether something lies below a page's bottom edge, and whether its paper goes on there: of samples (page_id, l, a, b, gradient, mask)."""
    paper = (F.col("l") >= BELOW_PAPER) & (F.abs(F.col("a") - 128.0) <= BELOW_CHROMA) & (F.abs(F.col("b") - 128.0) <= BELOW_CHROMA)
    shares = [F.count_if(c) / F.count(F.lit(1)) for c in (F.col("gradient") >= BELOW_EDGE, F.col("l") <= BELOW_DARK, F.col("mask"))]
    return samples.groupBy("page_id").agg((F.greatest(*shares) >= BELOW_FOREGROUND).alias("foreground"), (F.count_if(paper) / F.count(F.lit(1)) >= BELOW_CONTINUES).alias("continues"))


def band_places(sheets: DataFrame) -> DataFrame:
    """Where to look inside and outside the upper and the lower edge: page_id, band, x, y.  Sheets under 8 pixels have none."""
    top, bottom = (F.col("y0") + F.col("y1")) / 2.0, (F.col("y2") + F.col("y3")) / 2.0
    q = Quad.of()
    s = sheets.withColumns({"top": top, "bottom": bottom, "l": q.left, "r": q.right}).filter((F.col("r") - F.col("l") >= 8) & (F.col("bottom") - F.col("top") >= 8))
    tall, inset = F.col("bottom") - F.col("top"), (F.col("r") - F.col("l")) * 0.12
    deep, gap = tall * 0.18, tall * 0.02
    bands = {"top_in": (F.col("top") + gap, F.col("top") + deep), "top_out": (F.col("top") - deep, F.col("top") - gap), "bottom_in": (F.col("bottom") - deep, F.col("bottom") - gap), "bottom_out": (F.col("bottom") + gap, F.col("bottom") + deep)}

    def held(of: Column, size: str) -> Column:
        return F.least(F.greatest(half_up(of).cast("int"), F.lit(0)), F.col(size) - 1)

    ranges = F.array(*[F.struct(F.lit(n).alias("band"), held(a, "height").alias("from"), held(b, "height").alias("to")) for n, (a, b) in bands.items()])
    s = s.select("page_id", held(F.col("l") + inset, "width").alias("x_from"), held(F.col("r") - inset, "width").alias("x_to"), F.explode(ranges).alias("b")).select("page_id", "x_from", "x_to", "b.*")
    s = s.filter((F.col("x_to") > F.col("x_from")) & (F.col("to") > F.col("from")))

    def steps(low: str, high: str, most: int) -> Column:
        return F.sequence(F.col(low), F.col(high), F.greatest(F.lit(1), F.floor((F.col(high) - F.col(low)) / most).cast("int")))

    return s.withColumn("x", F.explode(steps("x_from", "x_to", 48))).withColumn("y", F.explode(steps("from", "to", 14))).select("page_id", "band", "x", "y")


def boundary_signals(samples: DataFrame, contrast: DataFrame) -> DataFrame:
    """How much content goes on beyond a page's upper and lower edge: of samples (page_id, band, brightness, edge) and contrast (page_id, contrast)."""
    bands = samples.groupBy("page_id", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("brightness").alias("mean"), (F.count_if("edge") / F.count(F.lit(1))).alias("edges"))

    def of(name: str, band: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("band") == band, F.col(name))), F.lit(0.0))

    wide = bands.groupBy("page_id").agg(*[of(n, b).alias(f"{b}_{n}") for b in ("top_in", "top_out", "bottom_in", "bottom_out") for n in ("n", "mean", "edges")])

    def goes_on(edge: str) -> Column:
        i, o = f"{edge}_in", f"{edge}_out"
        return N.continuation(F.col(f"{i}_edges"), F.col(f"{o}_edges"), F.col(f"{i}_mean"), F.col(f"{o}_mean"), F.least(f"{i}_n", f"{o}_n"))

    t = contrast.join(wide.select("page_id", goes_on("top").alias("top"), goes_on("bottom").alias("bottom")), "page_id").withColumn("most", F.greatest("top", "bottom"))
    return t.select("page_id", "top", "bottom", clamp(F.lit(1.0) - F.col("most") * 0.55).alias("containment"), clamp(F.col("contrast") * 0.70 + (F.lit(1.0) - F.col("most")) * 0.30).alias("continuity"))


def contained(points: DataFrame, sheets: DataFrame, width: int) -> DataFrame:
    """Which share of a picture's edge points (page_id, x, y), without the part beyond the spine, lies in its sheet; 1 with fewer than 16."""
    margin, beyond = half_up(F.lit(width * 0.02)), half_up(F.lit(width * 0.18))
    q = Quad.of()
    near = points.join(sheets, "page_id")
    first = margin + F.when(F.col("side") == "right", beyond).otherwise(0)
    last = F.lit(width - 1) - margin - F.when(F.col("side") == "left", beyond).otherwise(0)
    near = near.filter((F.col("x") >= first) & (F.col("x") <= last))
    return near.groupBy("page_id").agg(F.when(F.count(F.lit(1)) < 16, 1.0).otherwise(F.count_if(q.holds(F.col("x"), F.col("y"))) / F.count(F.lit(1))).alias("share"))


def is_paper_region() -> Column:
    """Whether a region may be a page: of side, area_ratio, vertices, width_ratio, height_ratio and envelope."""
    alone = F.coalesce(F.col("side") == "single", F.lit(True))
    long, short = F.greatest("width_ratio", "height_ratio"), F.greatest(F.least("width_ratio", "height_ratio"), F.lit(0.001))
    return (
        (F.col("area_ratio") >= F.when(alone, 0.20).otherwise(0.24)) & F.col("vertices").between(*REGION_VERTICES) & (F.col("width_ratio") >= F.when(alone, 0.46).otherwise(0.42))
        & (F.col("height_ratio") >= 0.48) & (long / short <= REGION_ASPECT) & (F.col("envelope") >= REGION_ENVELOPE)
    )
