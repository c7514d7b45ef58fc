"""A page of a spread where its outline is not found: the strongest lines near the places where a spread's edges lie.

Each side of a spread has an outer edge and a spine, then a top and a bottom within the columns between them.  A picture comes as lines of
brightness (whole numbers) and of edge pixels; column sums combine before they are shuffled, line sums stay in their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import native as N
from vellum.functions.numbers import clamp, weighted

# fixed values: where edges are looked for (side, role, from, to, expected place), in shares of the picture, and what they have to reach
UPRIGHT = (("left", "outer", 0.0, 0.28, 0.03), ("left", "spine", 0.70, 0.97, 0.91), ("right", "outer", 0.72, 1.0, 0.97), ("right", "spine", 0.03, 0.30, 0.09))
LEVEL = (("top", 0.01, 0.27, 0.04), ("bottom", 0.73, 0.99, 0.96))
LINES_FROM, LINES_TO = 0.05, 0.95
LEAST_WIDTH, LEAST_HEIGHT, LEAST_OUTER, LEAST_LEVEL, LEAST_ENVELOPE, LEAST_AREA = 0.42, 0.45, 0.045, 0.035, 0.80, 0.24
MOST_CONTINUATION, MOST_PENALTY = 0.42, 0.82
#: So many samples along an edge at most for its support, upright and level, and for its contrast.
SUPPORT_SAMPLES, CONTRAST_SAMPLES = (180, 220), (96, 120)
LEAST_SIZE = 40


def held(x: float, low: int, high: int) -> int:
    return max(low, min(int(x + 0.5), high))


def reach(low: float, high: float, size: int) -> tuple[int, int]:
    start = held(size * low, 1, size - 2)
    return start, held(size * high, start, size - 2)


def _support(hits: Column, gradient: Column, samples: Column) -> Column:
    return hits / samples * 0.75 + clamp(gradient / 255.0 / samples) * 0.25


def _contrast(differences: Column, samples: Column) -> Column:
    return F.when(samples > 0, clamp(differences / 255.0 / samples * 3.2)).otherwise(0.0)


def _preferred(at: Column, size: int, low: Column, high: Column, target: Column) -> Column:
    prior = clamp(F.lit(1.0) - F.abs(at / float(size) - target) / F.greatest(high - low, F.lit(0.01)))
    return F.col("support") * 0.50 + F.col("contrast") * 0.30 + prior * 0.20


def _strongest(score: Column) -> Column:
    """The place of highest score, the first of equals, and its support."""
    best = F.max_by(F.struct("at", "support"), F.struct(score, -F.col("at")))
    return best.alias("b")


def upright_anchors(lines: DataFrame, width: int, height: int) -> DataFrame:
    """(mask, side, outer, outer_support, spine, spine_support) of lines (mask, y, shades, edges)."""
    first = held(height * LINES_FROM, 1, height - 2)
    last = held(height * LINES_TO, first + 1, height - 1)
    off = max(2, int(width * 0.012 + 0.5))
    step, far_step = (max(1, (last - first) // n) for n in (SUPPORT_SAMPLES[0], CONTRAST_SAMPLES[0]))

    def sample(x: Column) -> Column:
        near = F.abs(F.get("shades", x + 1) - F.get("shades", x - 1))
        far = F.abs(F.get("shades", F.least(x + off, F.lit(width - 1))) - F.get("shades", F.greatest(x - off, F.lit(0))))
        return F.struct(x.cast("long").alias("at"), F.get("edges", x).cast("int").alias("hit"), near.alias("near"), far.alias("far"))

    rows = lines.filter(F.col("y").between(first, last - 1)).select("mask", "y", F.explode(F.transform(F.sequence(F.lit(1), F.lit(width - 2)), sample)).alias("s")).select("mask", "y", "s.*")
    counted, compared = (F.col("y") - first) % step == 0, (F.col("y") - first) % far_step == 0
    sums = rows.groupBy("mask", "at").agg(
        F.sum(F.when(counted, F.col("hit"))).alias("hits"), F.sum(F.when(counted, F.col("near"))).alias("near"), F.count(F.when(counted, F.col("near"))).alias("n"),
        F.sum(F.when(compared, F.col("far"))).alias("far"), F.count(F.when(compared, F.col("far"))).alias("m"),
    ).filter("n > 0")
    told = sums.select("mask", "at", _support(F.coalesce("hits", F.lit(0)), F.col("near"), F.col("n")).alias("support"), _contrast(F.col("far"), F.col("m")).alias("contrast"))
    places = [(side, role, *reach(low, high, width), low, high, target) for side, role, low, high, target in UPRIGHT]
    names = ("side", "role", "start", "end", "low", "high", "target")
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p, strict=True)]) for p in places]))
    laid = told.select("*", each.alias("r")).select("mask", "at", "support", "contrast", "r.*").filter(F.col("at").between(F.col("start"), F.col("end")))
    best = laid.groupBy("mask", "side", "role").agg(_strongest(_preferred(F.col("at"), width, F.col("low"), F.col("high"), F.col("target"))))
    named = [F.max(F.when(F.col("role") == r, F.col(f"b.{c}"))).alias(n) for r in ("outer", "spine") for c, n in (("at", r), ("support", f"{r}_support"))]
    return best.groupBy("mask", "side").agg(*named)


def level_anchors(lines: DataFrame, upright: DataFrame, width: int, height: int) -> DataFrame:
    """upright with top, top_support, bottom and bottom_support, found within the columns between outer edge and spine; sides that are too narrow, or lack a top or a bottom, go."""
    off = max(2, int(height * 0.012 + 0.5))
    down = W.partitionBy("mask").orderBy("y")
    whole = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    around = lines.withColumns({
        "above": F.lag("shades", 1).over(down), "below": F.lead("shades", 1).over(down),
        "far_above": F.coalesce(F.lag("shades", off).over(down), F.first("shades").over(whole)), "far_below": F.coalesce(F.lead("shades", off).over(down), F.last("shades").over(whole)),
    })
    owned = upright.withColumns({"from": F.least("outer", "spine"), "to": F.greatest("outer", "spine")})
    right_way = F.when(F.col("side") == "left", F.col("outer") < F.col("spine")).otherwise(F.col("spine") < F.col("outer"))
    owned = owned.filter(right_way & (F.col("to") - F.col("from") >= width * LEAST_WIDTH))
    met = around.join(owned, "mask")
    places = [(role, *reach(low, high, height), low, high, target) for role, low, high, target in LEVEL]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("role", "start", "end", "low", "high", "target"), p, strict=True)]) for p in places]))
    met = met.withColumn("r", each).filter(F.col("y").between(F.col("r.start"), F.col("r.end")))
    first = F.greatest(F.lit(1), F.least("from", F.lit(width - 2))).cast("int")
    last = F.greatest(F.col("first") + 1, F.least(F.col("to").cast("int"), F.lit(width - 1)))
    met = met.withColumn("first", first).withColumn("last", last)

    def along(most: int) -> Column:
        return F.sequence(F.col("first"), F.col("last") - 1, F.greatest(F.lit(1), F.floor((F.col("last") - F.col("first")) / float(most)).cast("int")))

    def total(places: Column, value) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(value(x).cast("long"), F.lit(0).cast("long")))

    def present(places: Column, a: str, b: str) -> Column:
        return F.size(F.filter(places, lambda x: F.get(a, x).isNotNull() & F.get(b, x).isNotNull()))

    near, far = along(SUPPORT_SAMPLES[1]), along(CONTRAST_SAMPLES[1])
    met = met.withColumns({
        "hits": total(near, lambda x: F.get("edges", x).cast("int")), "near": total(near, lambda x: F.abs(F.get("below", x) - F.get("above", x))), "n": present(near, "below", "above"),
        "far": total(far, lambda x: F.abs(F.get("far_below", x) - F.get("far_above", x))), "m": present(far, "far_below", "far_above"),
    }).filter("n > 0")
    told = met.select("mask", "side", "r.*", F.col("y").alias("at"), _support(F.col("hits"), F.col("near"), F.col("n")).alias("support"), _contrast(F.col("far"), F.col("m")).alias("contrast"))
    best = told.groupBy("mask", "side", "role").agg(_strongest(_preferred(F.col("at"), height, F.col("low"), F.col("high"), F.col("target"))))
    named = [F.max(F.when(F.col("role") == r, F.col(f"b.{c}"))).alias(n) for r in ("top", "bottom") for c, n in (("at", r), ("support", f"{r}_support"))]
    both = best.groupBy("mask", "side").agg(*named).filter("top IS NOT NULL AND bottom IS NOT NULL")
    return owned.drop("from", "to").join(both, ["mask", "side"])


def prior_candidates(anchors: DataFrame, width: int, height: int) -> DataFrame:
    """(mask, side, outer, spine, top, bottom, score, confidence) of the anchors that make a page.

    Beside the anchors a row has contrast, paper, envelope (the share of content that the page holds) and continuation
    (content going on beyond its edges).  Pictures under 40 pixels wide or high have none.
    """
    if min(width, height) < LEAST_SIZE:
        return prior_candidates(anchors.filter(F.lit(False)), LEAST_SIZE, LEAST_SIZE)
    near = (F.col("bottom") - F.col("top") >= height * LEAST_HEIGHT) & (F.col("outer_support") >= LEAST_OUTER) & (F.col("top_support") >= LEAST_LEVEL) & (F.col("bottom_support") >= LEAST_LEVEL)
    near = near & (F.col("envelope") >= LEAST_ENVELOPE) & (F.col("continuation") < MOST_CONTINUATION)
    left, right = F.least("outer", "spine") / float(width), F.greatest("outer", "spine") / float(width)
    top, bottom = F.col("top") / float(height), F.col("bottom") / float(height)
    a = anchors.filter(near).withColumns({"l": left, "r": right, "t": top, "b": bottom})
    unit = G.Quad([F.col("l"), F.col("r"), F.col("r"), F.col("l")], [F.col("t"), F.col("t"), F.col("b"), F.col("b")])
    a = a.withColumn("area", unit.area)
    page = F.lit(False)
    a = a.withColumns({"occupancy": N.occupancy(F.col("area"), page), "border": N.border_proximity(unit, F.col("side")), "small": N.small_penalty(F.col("area"), page)})
    a = a.withColumn("line", N.internal_line(F.col("contrast"), F.col("border"), F.col("small"), F.col("continuation"))).filter((F.col("area") >= LEAST_AREA) & (F.col("line") < MOST_PENALTY))
    a = a.withColumn("held", clamp(weighted((0.42, "outer_support"), (0.27, "top_support"), (0.27, "bottom_support"), (0.04, "spine_support"))))
    # corners are right angles
    score = weighted((0.24, "occupancy"), (0.17, "border"), (0.11, "contrast"), (0.13, "paper"), (0.06, 1.0), (0.14, "held"), (0.08, "envelope"), (0.07, "outer_support"), (-0.28, "line"), (-0.22, "small"))
    base = clamp(weighted((0.23, "occupancy"), (0.15, "border"), (0.17, "contrast"), (0.16, "paper"), (0.10, 1.0), (0.19, "held"), (-0.24, "line"), (-0.18, "small")))
    a = a.withColumns({"score": score, "base": base})
    sure = F.greatest("base", clamp(F.col("base") * 0.78 + clamp(F.col("outer_support") / 0.16) * 0.22))
    return a.select("mask", "side", "outer", "spine", "top", "bottom", "score", sure.alias("confidence"))
