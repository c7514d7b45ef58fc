"""Long straight lines through edge points, by voting.

Each point votes for every line through it: an angle and a distance from the origin.  Votes are counts that combine before the
shuffle, so a picture with many points costs as much to move as its accumulator has cells.  Distances are whole numbers,
from directions in 1024ths, so results are the same everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions.numbers import clamp

SCALE_BITS = 10
SCALE = 1 << SCALE_BITS


def directions(angles: int) -> list[tuple[int, int, int]]:
    """(angle, cosine, sine) of so many angles of a half turn, in 1024ths."""
    return [(k, round(math.cos(math.pi * k / angles) * SCALE), round(math.sin(math.pi * k / angles) * SCALE)) for k in range(angles)]


def _distance(x: Column, y: Column, cos: Column, sin: Column) -> Column:
    return F.shiftright(x * cos + y * sin + SCALE // 2, SCALE_BITS)


def votes(points: DataFrame, angles: int = 180) -> DataFrame:
    """(mask, angle, distance, votes) of points (mask, x, y) of whole numbers."""
    each = F.array(*[F.struct(F.lit(k).alias("angle"), F.lit(c).cast("long").alias("cos"), F.lit(s).cast("long").alias("sin")) for k, c, s in directions(angles)])
    laid = points.select("mask", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.explode(each).alias("d"))
    cells = laid.select("mask", "d.angle", _distance(F.col("x"), F.col("y"), F.col("d.cos"), F.col("d.sin")).alias("distance"))
    return cells.groupBy("mask", "angle", "distance").agg(F.count(F.lit(1)).alias("votes"))


def peaks(votes: DataFrame, least: int) -> DataFrame:
    """Cells of so many votes that no neighbour in angle or distance beats; of two equal neighbours the one before goes first.

    Cells of fewer votes cannot beat one that has enough, so they go before anything is sorted.
    """
    many = votes.filter(F.col("votes") >= least)

    def beside(along: str, across: str, step: int) -> Column:
        near = F.max("votes").over(W.partitionBy("mask", across).orderBy(along).rangeBetween(step, step))
        return F.coalesce(near, F.lit(0))

    n = F.col("votes")
    around = many.withColumns({"_l": beside("distance", "angle", -1), "_r": beside("distance", "angle", 1), "_u": beside("angle", "distance", -1), "_d": beside("angle", "distance", 1)})
    return around.filter((n > F.col("_l")) & (n >= F.col("_r")) & (n > F.col("_u")) & (n >= F.col("_d"))).drop("_l", "_r", "_u", "_d")


def strongest(lines: DataFrame, number: int = 80) -> DataFrame:
    """The lines of most votes of each mask, with their rank; of equal ones the first by angle and distance."""
    rank = F.row_number().over(W.partitionBy("mask").orderBy(F.desc("votes"), "angle", "distance"))
    return lines.withColumn("rank", rank).filter(F.col("rank") <= number)


def segments(points: DataFrame, lines: DataFrame, length: float, gap: float, angles: int = 180) -> DataFrame:
    """(mask, angle, distance, x0, y0, x1, y1, points): stretches of a line's points without a gap beyond ``gap``, at least ``length`` long.

    A line's points are those that voted for it; lines come in hundreds a mask at most, so points join them by mask.
    """
    table = F.array(*[F.struct(F.lit(c).cast("long").alias("cos"), F.lit(s).cast("long").alias("sin")) for _, c, s in directions(angles)])
    sought = lines.select("mask", "angle", "distance", F.get(table, F.col("angle")).alias("d")).select("mask", "angle", "distance", "d.cos", "d.sin")
    x, y = F.col("x"), F.col("y")
    on = points.select("mask", x.cast("long").alias("x"), y.cast("long").alias("y")).join(sought, "mask").filter(_distance(x, y, F.col("cos"), F.col("sin")) == F.col("distance"))
    on = on.withColumn("t", y * F.col("cos") - x * F.col("sin"))
    along = W.partitionBy("mask", "angle", "distance").orderBy("t", "y", "x")
    parted = on.withColumn("_new", (F.col("t") - F.lag("t").over(along) > int(gap * SCALE)).cast("int")).withColumn("_part", F.sum(F.coalesce("_new", F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0)))
    place, point = F.struct("t", "y", "x"), F.struct("x", "y")
    found = parted.groupBy("mask", "angle", "distance", "_part").agg(F.min_by(point, place).alias("a"), F.max_by(point, place).alias("b"), F.count(F.lit(1)).alias("points"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    long = found.filter((dx * dx + dy * dy).cast("double") >= length * length)
    return long.select("mask", "angle", "distance", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "points")


def support(quads: DataFrame, segments: DataFrame, margin: float) -> DataFrame:
    """(mask, supported, score): how many segments lie along an edge of the mask's quad (x0, y0 to x3, y3), by their middles; four are full support."""
    quad = G.Quad.of("qx", "qy")
    middles = segments.select("mask", ((F.col("x0") + F.col("x1")) / 2.0).alias("_x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("_y"))
    named = quads.select("mask", *[F.col(f"{a}{k}").cast("double").alias(f"q{a}{k}") for k in range(4) for a in ("x", "y")])
    nearest = F.least(*[G.to_segment(F.col("_x"), F.col("_y"), *quad.point(k), *quad.point(k + 1)) for k in range(4)])
    counted = named.join(middles, "mask", "left").withColumn("_near", nearest <= margin).groupBy("mask").agg(F.count_if("_near").alias("supported"))
    return counted.select("mask", "supported", clamp(F.col("supported") / 4.0).alias("score"))
