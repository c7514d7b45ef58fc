"""Signals along an edge or across a page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import stats as S
from vellum.functions.numbers import clamp, rounded


def robust_edge_fit(samples: DataFrame, edge: str) -> DataFrame:
    """offset, continuity, occlusion and inliers of an edge's samples (pos, offset, color).

    Two rounds of grouped percentiles give medians and median deviations; inliers are then counted in order.
    A sample is an inlier within 2.8 deviations in offset, and not beyond them in color.
    """
    median = samples.groupBy(edge).agg(F.percentile("offset", 0.5).alias("mo"), F.percentile("color", 0.5).alias("mc"), F.count(F.lit(1)).alias("n"))
    near = samples.join(median, edge)
    spread = near.groupBy(edge).agg(
        F.greatest(F.percentile(F.abs(F.col("offset") - F.col("mo")), 0.5), F.lit(0.5)).alias("do"), F.greatest(F.percentile(F.abs(F.col("color") - F.col("mc")), 0.5), F.lit(1.0)).alias("dc")
    )
    inliers = near.join(spread, edge).filter((F.abs(F.col("offset") - F.col("mo")) <= F.col("do") * 2.8) & (F.col("color") <= F.col("mc") + F.col("dc") * 2.8))
    step = F.abs(F.col("offset") - F.lag("offset").over(W.partitionBy(edge).orderBy("pos")))
    counted = inliers.withColumn("jump", step > F.greatest(F.lit(3.0), F.col("do") * 3.0))
    fits = counted.groupBy(edge).agg(F.array_sort(F.collect_list("offset")).alias("kept"), F.count(F.lit(1)).alias("inliers"), F.count_if("jump").alias("jumps"))
    fits = median.select(edge, "n").join(fits, edge, "left")
    count = F.coalesce("inliers", F.lit(0))
    broken = F.when(count < 2, 1.0).otherwise(F.col("jumps") / (count - 1))
    offset = F.when(count == 0, 0.0).otherwise(F.greatest(S.trimmed_mean(F.col("kept"), 0.18), F.lit(0.0)))
    lost = F.lit(1.0) - count / F.col("n")
    return fits.select(edge, rounded(offset).alias("offset"), rounded(clamp(F.lit(1.0) - broken)).alias("continuity"), rounded(clamp(lost * 0.70 + broken * 0.30)).alias("occlusion"), count.alias("inliers"))


def spine_of_profiles(profiles: DataFrame, key: str) -> DataFrame:
    """The gutter of each luminance profile (x, mean, variance), as wide as it has columns: x, score, confidence and whether the middle had to do.

    Means and variances are smoothed, then each column near the middle is judged by how dark it is, how deep a valley, how calm and how central.
    """
    by_x = W.partitionBy(key).orderBy("x")
    size = F.count(F.lit(1)).over(W.partitionBy(key))
    p = profiles.withColumn("w", size)
    start, end = F.floor(F.col("w") * 0.35 + 0.5), F.floor(F.col("w") * 0.65 + 0.5)
    shoulder, radius = F.greatest(F.lit(2), F.floor(F.col("w") * 0.04 + 0.5)), 1
    p = p.withColumns({"start": start, "end": end, "far": shoulder, "center": F.floor(F.col("w") / 2)})
    p = p.filter((F.col("x") >= F.greatest(F.col("start") - F.col("far"), F.lit(0))) & (F.col("x") <= F.least(F.col("end") + F.col("far"), F.col("w") - 1)))
    near = by_x.rowsBetween(-radius, radius)
    p = p.withColumns({"smooth": F.avg("mean").over(near), "varies": F.avg("variance").over(near)})
    series = p.groupBy(key, "start", "end", "far", "center").agg(F.sort_array(F.collect_list(F.struct("x", "smooth", "varies"))).alias("s"))
    # each place meets its shoulders before it becomes a row, so no row carries its series
    placed = F.transform(
        "s",
        lambda p, i: F.struct(
            p["x"].alias("x"), p["smooth"].alias("m"), p["varies"].alias("v"), F.get("s", i - F.col("far").cast("int"))["smooth"].alias("before"), F.get("s", i + F.col("far").cast("int"))["smooth"].alias("after")
        ),
    )
    at = series.select(key, "start", "end", "center", F.explode(placed).alias("p")).select(key, "start", "end", "center", "p.*")
    at = at.filter((F.col("x") >= F.col("start")) & (F.col("x") <= F.col("end")))
    all_ = W.partitionBy(key)
    at = at.withColumns({"low": F.min("m").over(all_), "high": F.max("m").over(all_), "calmest": F.min("v").over(all_), "wildest": F.max("v").over(all_)})
    dark = clamp((F.col("high") - F.col("m")) / F.greatest(F.lit(1.0), F.col("high") - F.col("low")))
    valley = clamp(((F.col("before") + F.col("after")) / 2.0 - F.col("m")) / 30.0)
    central = clamp(F.lit(1.0) - F.abs(F.col("x") - F.col("center")) / F.greatest(F.lit(1.0), (F.col("end") - F.col("center")).cast("double")))
    calm = clamp((F.col("wildest") - F.col("v")) / F.greatest(F.lit(1.0), F.col("wildest") - F.col("calmest")))
    at = at.withColumns({"dark": dark, "valley": valley, "calm": calm, "central": central})
    at = at.withColumn("score", F.col("dark") * 0.38 + F.col("valley") * 0.32 + F.col("calm") * 0.18 + F.col("central") * 0.12)
    best = at.groupBy(key, "center").agg(F.max_by(F.struct("x", "score", "valley", "dark", "central"), F.struct("score", -F.col("x"))).alias("b"))
    sure = clamp(F.col("b.valley") * 0.55 + F.col("b.dark") * 0.30 + F.col("b.central") * 0.15)
    best = best.withColumn("c", sure).withColumn("fallback", (F.col("c") < 0.28) | (F.col("b.valley") < 0.08))
    return best.select(key, F.when(F.col("fallback"), F.col("center")).otherwise(F.col("b.x")).cast("long").alias("x"), rounded("b.score").alias("score"), rounded("c").alias("confidence"), "fallback")


def ranked_statistics(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Median, percentiles by three rules, a trimmed mean (0.18 off either end) and the outer offset of each series.

    All are read off the ranks of one sorted pass, so no series has to fit an array.  Nulls do not count.
    """
    own, n, v = W.partitionBy(key), F.col("_n"), F.col(value)
    ranked = samples.filter(v.isNotNull()).withColumns({"_r": F.row_number().over(own.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(own)})

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_r") == place, v))

    def between(part: float, size: Column, first: Column) -> Column:
        """The value between two ranks of those from ``first`` on."""
        place = F.lit(part) * (size - 1)
        low, high = F.floor(place), F.ceil(place)
        weight = F.when(low == high, F.when(F.col("_r") == first + low, v)).otherwise(F.when(F.col("_r") == first + low, v * (high - place)).when(F.col("_r") == first + high, v * (place - low)))
        return F.sum(weight)

    ranked = ranked.withColumn("_mid", between(0.5, n, F.lit(0)).over(own)).withColumn("_outer", F.count_if(v >= F.col("_mid")).over(own))
    cut = F.floor(n * 0.18)
    within = (F.col("_r") >= cut) & (F.col("_r") < n - cut)
    found = ranked.groupBy(key).agg(
        F.first("_mid").alias("median"), between(0.88, n, F.lit(0)).alias("p88"), at(F.floor((n - 1) * 0.90 + 0.5)).alias("rank90"), at(F.least(F.floor(n * 0.75), n - 1)).alias("rank75"),
        F.avg(F.when(within, v)).alias("trimmed"), (between(0.88, F.col("_outer"), n - F.col("_outer")) - F.first("_mid")).alias("outer"),
    )
    return found.select(key, *[rounded(c).alias(c) for c in ("median", "p88", "rank90", "rank75", "trimmed", "outer")])


def narrow_places(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Where each series (pos from 1) of eight samples or more is lowest, counted from 0, if that is low against the upper quarter; an eighth at each end does not count.  The first of equals."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    core = samples.withColumn("_n", n).filter("_n >= 8").withColumn("_cut", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.12 + 0.5)))
    core = core.filter((F.col("pos") > F.col("_cut")) & (F.col("pos") <= F.col("_n") - F.col("_cut")))
    ranked = core.withColumns({"_r": F.row_number().over(W.partitionBy(key).orderBy(value, "pos")) - 1, "_m": F.count(F.lit(1)).over(W.partitionBy(key))})
    place = (F.col("_m") - 1) * 0.75
    low, high, v, r = F.floor(place), F.ceil(place), F.col(value), F.col("_r")
    upper = F.sum(F.when(low == high, F.when(r == low, v)).otherwise(F.when(r == low, v * (high - place)).when(r == high, v * (place - low))))
    found = ranked.groupBy(key).agg(upper.alias("upper"), F.min(F.when(r == 0, v)).alias("low"), F.min(F.when(r == 0, F.col("pos"))).alias("at"))
    return found.select(key, F.when((F.col("upper") > 0) & (F.col("low") / F.col("upper") <= 0.42), F.col("at") - 1).cast("int").alias("place"))


def apart(samples: DataFrame, key: str, pos: str, value: str, limit: float) -> DataFrame:
    """Samples (key, pos, value) that differ by more than ``limit`` from the last that was kept of their series; the first is kept.

    Which are kept depends on all before, so it is one pass along each series, in order, that holds the last value alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            kept = []
            for i, (k, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if k != at:
                    at, last = k, None
                if v is not None and (last is None or abs(last - v) > limit):
                    last = v
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = samples.select(key, pos, value).repartition(key).sortWithinPartitions(key, pos)
    return ordered.mapInArrow(run, ordered.schema)
