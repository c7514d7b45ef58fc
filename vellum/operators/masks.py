"""Components of masks, from rows: a line of a mask is its runs of set pixels, never a picture in one task.

Runs of neighbouring lines that touch are links, and components are found by contracting links to stars: every round, each run
points to the least run that it knows of, so rounds grow with the logarithm of a component's length.  The work spreads
over masks, lines and stretches of lines; what one task gathers of a mask is the neighbours of one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.numbers import clamp
from vellum.sources.shared import dropped, kept

#: Runs meet by stretches of so many pixels of a line; a stretch holds at most half as many runs.
STRETCH = 64
#: A run is known by its line and, in these lower bits, its first pixel; numbers follow the order of reading.
PIXEL_BITS = 32
#: Rounds of contraction; a mask would need more than 2^40 runs to need them all.
ROUNDS = 60

# fixed values: limits and weights of the choice among components
LEAST_SHARE, GREATEST_SHARE, LONGEST_SIDE = 0.02, 0.995, 8.0
ALONE = (0.70, 0.20, 0.10)
GUIDED = (0.64, 0.18, 0.08, 0.10)


def runs(lines: DataFrame, pixels: str = "pixels") -> DataFrame:
    """(mask, y, x0, x1, run): the runs of set pixels of each line (mask, y, array of booleans).

    Null pixels are not set; a line without pixels, or null, has no run.  Each line of a mask is expected once.
    """

    def ends(step: int) -> Column:
        places = F.sequence(F.lit(0), F.size(pixels) - 1)
        return F.filter(places, lambda i: F.get(pixels, i) & ~F.coalesce(F.get(pixels, i + step), F.lit(False)))

    some = lines.filter(F.size(pixels) > 0)
    found = some.select("mask", "y", F.explode(F.arrays_zip(ends(-1).alias("x0"), ends(1).alias("x1"))).alias("r"))
    found = found.select("mask", F.col("y").cast("long").alias("y"), F.col("r.x0").cast("long").alias("x0"), F.col("r.x1").cast("long").alias("x1"))
    return found.withColumn("run", F.shiftleft("y", PIXEL_BITS) + F.col("x0"))


def touching(runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """(mask, a, b): pairs of runs of neighbouring lines that touch, corner to corner too if ``diagonal``; a is the lower one.

    Runs join on the stretches of a line that they cover; a pair counts in the stretch where its overlap starts, so it comes once.
    """
    reach = 1 if diagonal else 0

    def covered(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / STRETCH), F.floor(hi / STRETCH)))

    lower = runs.select("mask", "y", F.col("run").alias("a"), (F.col("x0") - reach).alias("lo"), (F.col("x1") + reach).alias("hi"))
    lower = lower.select("*", covered(F.col("lo"), F.col("hi")).alias("stretch"))
    upper = runs.select("mask", (F.col("y") + 1).alias("y"), F.col("run").alias("b"), "x0", "x1", covered(F.col("x0"), F.col("x1")).alias("stretch"))
    met = lower.join(upper, ["mask", "y", "stretch"])
    overlap = (F.col("lo") <= F.col("x1")) & (F.col("x0") <= F.col("hi")) & (F.col("stretch") == F.floor(F.greatest("lo", "x0") / STRETCH))
    return met.filter(overlap).select("mask", "a", "b")


def _pointed(pairs: DataFrame, large: bool) -> DataFrame:
    """One star operation on pairs a > b: larger neighbours (``large``), or smaller ones and the run itself, come to point to the least."""
    if large:
        pairs = pairs.unionByName(pairs.select("mask", F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("mask", "a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    met = pairs.join(least, ["mask", "a"])
    if large:
        new = met.filter("b > a").select("mask", F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        new = met.select("mask", F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return new.filter("a <> b").distinct()


def labelled(runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """runs with ``label``, the first run, in order of reading, of the component that a run belongs to."""
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("mask", "a", "b").cast("decimal(38,0)")))
    stars = kept(touching(runs, diagonal), "stars")
    before, now = None, stars.agg(state).first()
    for _ in range(ROUNDS):
        if now == before:
            break
        last, stars = stars, kept(_pointed(_pointed(stars, True), False), "stars")
        before, now = now, stars.agg(state).first()
        dropped(last)
    else:
        raise RuntimeError("components did not settle")
    return runs.join(stars.select("mask", F.col("a").alias("run"), F.col("b").alias("label")), ["mask", "run"], "left").withColumn("label", F.coalesce("label", "run"))


def components(labelled: DataFrame, width: int, height: int) -> DataFrame:
    """(mask, label, area, bounds, central): pixels and bounds of each component, and whether it covers the mask's middle."""
    middle = (F.col("y") == height // 2) & (F.col("x0") <= width // 2) & (F.col("x1") >= width // 2)
    return labelled.groupBy("mask", "label").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.bool_or(middle).alias("central")
    )


def chosen(components: DataFrame, width: int, height: int, guide: tuple[str, str] | None = None) -> DataFrame:
    """The component of each mask that a page most likely is, with its score; the larger of equal ones, then the first.

    Size, closeness to the middle and shape count; where the columns of ``guide`` are not null, closeness to that point too.
    Components that are too small, too large or too long for a page are left out, so a mask may have none.
    """
    wide, high = F.col("x_max") - F.col("x_min") + 1, F.col("y_max") - F.col("y_min") + 1
    share, sides = F.col("area") / float(width * height), F.greatest(wide, high) / F.least(wide, high)
    c = components.withColumns({"share": share, "sides": sides, "_cx": F.col("x_min") + wide / 2.0, "_cy": F.col("y_min") + high / 2.0})
    c = c.filter(F.col("share").between(LEAST_SHARE, GREATEST_SHARE) & (F.col("sides") <= LONGEST_SIDE))

    def away(x: Column, y: Column) -> Column:
        dx, dy = F.col("_cx") - x, F.col("_cy") - y
        return F.sqrt(dx * dx + dy * dy)

    half = max((width * width / 4.0 + height * height / 4.0) ** 0.5, 1.0)
    central = F.when(F.col("central"), 1.0).otherwise(clamp(F.lit(1.0) - away(F.lit(width / 2.0), F.lit(height / 2.0)) / half))
    shape = clamp(F.lit(1.0) - (F.col("sides") - 1.0) / (LONGEST_SIDE - 1.0))
    score = F.col("share") * ALONE[0] + central * ALONE[1] + shape * ALONE[2]
    if guide:
        near = clamp(F.lit(1.0) - away(F.col(guide[0]), F.col(guide[1])) / max((width * width + height * height) ** 0.5, 1.0))
        led = F.col("share") * GUIDED[0] + central * GUIDED[1] + shape * GUIDED[2] + near * GUIDED[3]
        score = F.when(F.col(guide[0]).isNotNull() & F.col(guide[1]).isNotNull(), led).otherwise(score)
    best = c.withColumn("score", score).groupBy("mask").agg(F.max_by(F.struct("label", "area", "score", "x_min", "y_min", "x_max", "y_max"), F.struct("score", "area", -F.col("label"))).alias("b"))
    return best.select("mask", "b.*")
