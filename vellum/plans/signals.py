"""Queries over one-dimensional signals and robust statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import stats as S
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.operators import signals as O
from vellum.sources.tables import oracle, view
from vellum.streaming.throttle import throttle_batch

def signal(spark, d):
    return view(spark, d, "signal")


def window():
    return W.partitionBy("series_id").orderBy("pos")


def robust_edges(spark, d):
    s = signal(spark, d).select("series_id", "pos", (F.col("value") / 10.0).alias("offset"), F.pmod(F.col("value") * 7.0, F.lit(40.0)).alias("color"))
    return O.robust_edge_fit(s, "series_id")


def series_ranks(spark, d):
    """Percentiles by three rules, a trimmed mean, and the outer offset."""
    return O.ranked_statistics(signal(spark, d), "series_id", "value")


def column_inliers(spark, d):
    """Values within three median deviations of their column's median, and how many columns have one."""
    s = signal(spark, d).withColumn("x", F.floor("pos").cast("int") % 12)
    keys = ["series_id", "x"]
    median = s.groupBy(*keys).agg(F.percentile("value", 0.5).alias("m"))
    near = s.join(median, keys)
    spread = near.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.percentile(F.abs(F.col("value") - F.col("m")), 0.5) * 3.0).alias("limit"))
    kept = near.join(spread, keys).filter(F.abs(F.col("value") - F.col("m")) <= F.col("limit"))
    return kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("inliers"), r6(F.count_distinct("x") / F.lit(12.0)).alias("coverage"))


def direction_votes(spark, d):
    s = signal(spark, d).withColumn("v", F.col("value") - 50.0)
    limit = F.max(F.abs("v")).over(W.partitionBy("series_id")) * 0.25
    votes = s.withColumn("limit", limit).filter(F.abs("v") >= F.col("limit")).groupBy("series_id").agg(F.count_if(F.col("v") > 0).alias("p"), F.count_if(F.col("v") < 0).alias("n"))
    return votes.select("series_id", F.signum(F.col("p") - F.col("n")).cast("int").alias("direction"), r6(S.consistency(F.col("p"), F.col("n"))).alias("consistency"))


def gap_interpolation(spark, d):
    """Values that are missing, filled on the line between their neighbours; flat at the ends."""
    s = signal(spark, d).withColumn("v", F.when(F.col("pos") % 4 != 1, F.col("value"))).withColumn("p", F.when(F.col("v").isNotNull(), F.col("pos")))
    back, ahead = window().rowsBetween(W.unboundedPreceding, 0), window().rowsBetween(0, W.unboundedFollowing)
    s = s.withColumns({n: f(c, True).over(w) for n, f, c, w in (("v0", F.last, "v", back), ("p0", F.last, "p", back), ("v1", F.first, "v", ahead), ("p1", F.first, "p", ahead))})
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.col("pos") - F.col("p0")) / F.when(F.col("p1") > F.col("p0"), F.col("p1") - F.col("p0")).otherwise(1))
    return s.select("series_id", "pos", r6(F.coalesce(F.when(F.col("p0") == F.col("p1"), F.col("v0")), line, "v0", "v1")).alias("value"))


def moving_averages(spark, d):
    return signal(spark, d).select("series_id", "pos", r6(F.avg("value").over(window().rowsBetween(-2, 2))).alias("average"))


def moving_medians(spark, d):
    near = F.array_sort(F.collect_list("value").over(window().rowsBetween(-2, 2)))
    return signal(spark, d).withColumn("near", near).select("series_id", "pos", r6(S.percentile(F.col("near"), 0.5)).alias("median"))


def smoothed_twice(spark, d):
    """Each value with half the weight and its neighbours with a quarter, two times; ends stay."""
    s = signal(spark, d).select("series_id", "pos", "value")
    for _ in range(2):
        s = s.withColumn("value", F.coalesce((F.lag("value").over(window()) + F.col("value") * 2.0 + F.lead("value").over(window())) / 4.0, "value"))
    return s.select("series_id", "pos", r6("value").alias("value"))


def shoulder_contrast(spark, d):
    """How far a value lies below the mean of those three places to either side."""
    depth = (F.lag("value", 3).over(window()) + F.lead("value", 3).over(window())) / 2.0 - F.col("value")
    return signal(spark, d).select("series_id", "pos", r6(depth).alias("depth")).filter("depth IS NOT NULL")


def valley_places(spark, d):
    """The lowest place of the core of a series if it is low against the upper quarter: a narrow connection."""
    return O.narrow_places(signal(spark, d), "series_id", "value").select("series_id", "place")


def systematic_samples(spark, d):
    """Every so many-th point, at most 24 of them."""
    step = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(W.partitionBy("series_id")) / 24.0))
    return signal(spark, d).withColumn("step", step).filter((F.col("pos") - 1) % F.col("step") == 0).select("series_id", "pos", r6("value").alias("value"))


def column_statistics(spark, d):
    """Mean, deviation and share of dark values of each column, as a gutter is judged by."""
    p = view(spark, d, "profile")
    mean, square = F.avg("mean"), F.avg(F.col("mean") * F.col("mean"))
    by_x = p.groupBy("x").agg(mean.alias("m"), square.alias("q"), F.avg(F.when(F.col("mean") < 120, 1.0).otherwise(0.0)).alias("dark"))
    return by_x.select("x", F.round("m", 4).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m"))), 4).alias("deviation"), F.round("dark", 4).alias("dark"))


def grid_coverage(spark, d):
    """The share of a grid's rows and columns that have content."""
    s = signal(spark, d).select("series_id", (F.col("pos") % 10).alias("r"), (F.floor("value") % 8).alias("c"), (F.col("value") < 6).cast("int").alias("dark"))

    def share(key, cells):
        return s.groupBy("series_id", key).agg(F.avg("dark").alias("d")).groupBy("series_id").agg((F.count_if(F.col("d") >= 0.05) / F.lit(float(cells))).alias(key))

    return share("r", 10).join(share("c", 8), "series_id").select("series_id", r6("r").alias("rows"), r6("c").alias("columns"))


def point_deduplication(spark, d):
    """Values that differ by more than a limit from the last that was kept."""
    kept = O.apart(signal(spark, d).select("series_id", "pos", "value"), "series_id", "pos", "value", 15.0)
    return kept.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("kept"), r6(F.sum("value")).alias("total"))


def spine_profiles(spark, d):
    p = view(spark, d, "profile").withColumn("variance", ((F.col("x") * 37 + F.col("vec_id") * 11) % 97).cast("double"))
    return O.spine_of_profiles(p, "vec_id")


def frame_throttle(spark, d):
    """Frames that are analysed: 250 ms at least after the last that was."""
    return throttle_batch(view(spark, d, "frames"))


def snapshot_asof(spark, d):
    """The latest confident frame at each shutter, at most 750 ms old."""
    f = view(spark, d, "frames")
    shutters = f.filter("event_id % 10 = 0").select("stream_id", F.col("t_ms").alias("t"), F.lit(1).alias("shutter"), "event_id", F.lit(None).cast("bigint").alias("seen"))
    frames = f.filter("detected AND confidence >= 0.22").select("stream_id", F.col("t_ms").alias("t"), F.lit(0).alias("shutter"), "event_id", F.col("t_ms").alias("seen"))
    order = W.partitionBy("stream_id").orderBy("t", "shutter", "event_id").rowsBetween(W.unboundedPreceding, 0)
    both = shutters.unionByName(frames).withColumn("last", F.last("seen", True).over(order)).filter("shutter = 1")
    return both.select("stream_id", "event_id", "t", F.when(F.col("t") - F.col("last") <= 750, F.col("last")).alias("frame_t"))


def med(x, by):
    return f"quantile_cont({x}, 0.5) OVER (PARTITION BY {by})"


QUERIES = {
    f.__name__: f
    for f in (
        robust_edges, series_ranks, column_inliers, direction_votes, gap_interpolation, moving_averages, moving_medians, smoothed_twice, shoulder_contrast, valley_places, systematic_samples,
        column_statistics, grid_coverage, point_deduplication, spine_profiles, frame_throttle, snapshot_asof,
    )
}
ORACLE = {
    "robust_edges": oracle(f"""WITH s AS (SELECT series_id, pos, value/10e0 AS o, (value*7e0) % 40e0 AS c FROM {{signal}}), m AS (SELECT *, {med('o', 'series_id')} AS mo, {med('c', 'series_id')} AS mc FROM s),
v AS (SELECT *, greatest(0.5e0, {med('abs(o - mo)', 'series_id')}) AS d, greatest(1e0, {med('abs(c - mc)', 'series_id')}) AS e FROM m),
i AS (SELECT *, lag(o) OVER (PARTITION BY series_id ORDER BY pos) AS b, row_number() OVER (PARTITION BY series_id ORDER BY o, pos) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM v WHERE abs(o - mo) <= d*2.8e0 AND c <= mc + e*2.8e0),
f AS (SELECT series_id, any_value(n) AS n, count(*) FILTER (abs(o - b) > greatest(3e0, d*3e0)) AS jumps, sum(o ORDER BY o) FILTER (r > floor(n*0.18e0) AND r <= n - floor(n*0.18e0))/count(*) FILTER (r > floor(n*0.18e0) AND r <= n - floor(n*0.18e0)) AS t FROM i GROUP BY series_id),
a AS (SELECT series_id, count(*) AS total FROM s GROUP BY series_id), j AS (SELECT a.series_id, total, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 2 THEN 1e0 ELSE jumps/(n - 1)::DOUBLE END AS k, coalesce(greatest(t, 0e0), 0e0) AS t FROM a LEFT JOIN f USING (series_id))
SELECT series_id, {R('t')} AS "offset", {R('1e0 - k')} AS continuity, {R('(1e0 - n/total::DOUBLE)*0.7e0 + k*0.3e0')} AS occlusion, n AS inliers FROM j"""),
    "series_ranks": oracle(f"""WITH l AS (SELECT series_id, list(value ORDER BY value) AS o, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.88) AS p88 FROM {{signal}} GROUP BY series_id),
c AS (SELECT *, floor(len(o)*0.18e0)::BIGINT AS cut, list_sort(list_filter(list_transform(o, lambda v: v - mid), lambda v: v >= 0)) AS u FROM l)
SELECT series_id, {R('mid')} AS median, {R('p88')} AS p88, {R('o[floor((len(o) - 1)*0.9e0 + 0.5e0)::BIGINT + 1]')} AS rank90, {R('o[least(floor(len(o)*0.75e0)::BIGINT, len(o) - 1) + 1]')} AS rank75,
  {R('list_reduce(o[cut + 1 : len(o) - cut], lambda a, b: a + b)/(len(o) - 2*cut)')} AS trimmed, {R("list_aggregate(u, 'quantile_cont', 0.88)")} AS "outer" FROM c"""),
    "column_inliers": oracle(f"""WITH s AS (SELECT series_id, pos % 12 AS x, value FROM {{signal}}), m AS (SELECT *, {med('value', 'series_id, x')} AS m FROM s), v AS (SELECT *, greatest(1e0, {med('abs(value - m)', 'series_id, x')}*3e0) AS lim FROM m)
SELECT series_id, count(*) AS inliers, {R('count(DISTINCT x)/12e0')} AS coverage FROM v WHERE abs(value - m) <= lim GROUP BY series_id"""),
    "direction_votes": oracle(f"""WITH s AS (SELECT series_id, value - 50e0 AS v, max(abs(value - 50e0)) OVER (PARTITION BY series_id)*0.25e0 AS lim FROM {{signal}}),
c AS (SELECT series_id, count(*) FILTER (v > 0) AS p, count(*) FILTER (v < 0) AS n FROM s WHERE abs(v) >= lim GROUP BY series_id) SELECT series_id, sign(p - n)::INTEGER AS direction, {R('greatest(p, n)/(p + n)::DOUBLE')} AS consistency FROM c"""),
    "gap_interpolation": oracle(f"""WITH s AS (SELECT series_id, pos, CASE WHEN pos % 4 <> 1 THEN value END AS v, CASE WHEN pos % 4 <> 1 THEN pos END AS p FROM {{signal}}),
f AS (SELECT series_id, pos, last_value(v IGNORE NULLS) OVER b AS v0, last_value(p IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(p IGNORE NULLS) OVER a AS p1 FROM s
  WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, pos, {R('CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL OR p0 = p1 THEN v0 ELSE v0 + (v1 - v0)*((pos - p0)/(p1 - p0)::DOUBLE) END')} AS value FROM f"""),
    "moving_averages": oracle(f"SELECT series_id, pos, {R('avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS average FROM {{signal}}"),
    "moving_medians": oracle(f"SELECT series_id, pos, {R('quantile_cont(value, 0.5) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS median FROM {{signal}}"),
    "smoothed_twice": oracle(f"""WITH a AS (SELECT series_id, pos, coalesce((lag(value) OVER w + value*2e0 + lead(value) OVER w)/4e0, value) AS v FROM {{signal}} WINDOW w AS (PARTITION BY series_id ORDER BY pos))
SELECT series_id, pos, {R('coalesce((lag(v) OVER w + v*2e0 + lead(v) OVER w)/4e0, v)')} AS value FROM a WINDOW w AS (PARTITION BY series_id ORDER BY pos)"""),
    "shoulder_contrast": oracle(f"""WITH a AS (SELECT series_id, pos, (lag(value, 3) OVER w + lead(value, 3) OVER w)/2e0 - value AS v FROM {{signal}} WINDOW w AS (PARTITION BY series_id ORDER BY pos)) SELECT series_id, pos, {R('v')} AS depth FROM a WHERE v IS NOT NULL"""),
    "valley_places": oracle("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM {signal}), c AS (SELECT *, greatest(1, floor(n*0.12e0 + 0.5e0)) AS cut FROM n WHERE n >= 8),
k AS (SELECT series_id, quantile_cont(value, 0.75) AS ref, min(value) AS low, arg_min(pos, (value, pos)) - 1 AS place FROM c WHERE pos > cut AND pos <= n - cut GROUP BY series_id)
SELECT series_id, CASE WHEN ref > 0 AND low/ref <= 0.42e0 THEN place END::INTEGER AS place FROM k"""),
    "systematic_samples": oracle(f"""WITH n AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY series_id)/24e0))::BIGINT AS step FROM {{signal}}) SELECT series_id, pos, {R('value')} AS value FROM n WHERE (pos - 1) % step = 0"""),
    "column_statistics": oracle("""WITH s AS (SELECT x, avg(mean) AS m, avg(mean*mean) AS q, avg(CASE WHEN mean < 120 THEN 1e0 ELSE 0e0 END) AS dark FROM {profile} GROUP BY x)
SELECT x::INTEGER AS x, round(m, 4) AS mean, round(sqrt(greatest(0e0, q - m*m)), 4) AS deviation, round(dark, 4) AS dark FROM s"""),
    "grid_coverage": oracle(f"""WITH s AS (SELECT series_id, pos % 10 AS r, floor(value)::BIGINT % 8 AS c, (value < 6)::INTEGER AS dark FROM {{signal}}), a AS (SELECT series_id, r, avg(dark) AS d FROM s GROUP BY 1, 2), b AS (SELECT series_id, c, avg(dark) AS d FROM s GROUP BY 1, 2)
SELECT series_id, {R('x')} AS rows, {R('y')} AS columns FROM (SELECT series_id, count(*) FILTER (d >= 0.05e0)/10e0 AS x FROM a GROUP BY 1) JOIN (SELECT series_id, count(*) FILTER (d >= 0.05e0)/8e0 AS y FROM b GROUP BY 1) USING (series_id)"""),
    "point_deduplication": oracle(f"""WITH RECURSIVE s AS (SELECT series_id, pos, value FROM {{signal}}), f AS (SELECT series_id, pos, value AS last, 1 AS kept, value AS total FROM s WHERE pos = 1
  UNION ALL SELECT s.series_id, s.pos, CASE WHEN abs(last - value) > 15 THEN value ELSE last END, kept + CASE WHEN abs(last - value) > 15 THEN 1 ELSE 0 END, total + CASE WHEN abs(last - value) > 15 THEN value ELSE 0e0 END FROM f JOIN s ON s.series_id = f.series_id AND s.pos = f.pos + 1)
SELECT series_id, arg_max(kept, pos) AS kept, {R('arg_max(total, pos)')} AS total FROM f GROUP BY series_id"""),
    "spine_profiles": oracle(f"""WITH p AS (SELECT *, (x*37 + vec_id*11) % 97 AS va, count(*) OVER (PARTITION BY vec_id) AS w FROM {{profile}}), g AS (SELECT *, floor(w*0.35e0 + 0.5e0) AS s, floor(w*0.65e0 + 0.5e0) AS e, greatest(2, floor(w*0.04e0 + 0.5e0)) AS far, w // 2 AS c FROM p),
a AS (SELECT *, avg(mean) OVER (PARTITION BY vec_id ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m, avg(va) OVER (PARTITION BY vec_id ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM g WHERE x >= greatest(s - far, 0) AND x <= least(e + far, w - 1)),
b AS (SELECT a.vec_id, a.x, a.m, a.c, a.e, l.m AS m0, r.m AS m1, a.v, min(a.v) OVER (PARTITION BY a.vec_id) AS vl, max(a.v) OVER (PARTITION BY a.vec_id) AS vh, min(a.m) OVER (PARTITION BY a.vec_id) AS low, max(a.m) OVER (PARTITION BY a.vec_id) AS high FROM a LEFT JOIN a l ON l.vec_id = a.vec_id AND l.x = a.x - a.far LEFT JOIN a r ON r.vec_id = a.vec_id AND r.x = a.x + a.far WHERE a.x BETWEEN a.s AND a.e),
k AS (SELECT *, least(1e0, greatest(0e0, (high - m)/greatest(1e0, high - low))) AS dark, least(1e0, greatest(0e0, ((m0 + m1)/2e0 - m)/30e0)) AS valley, least(1e0, greatest(0e0, 1e0 - abs(x - c)/greatest(1e0, (e - c)::DOUBLE))) AS central FROM b),
t AS (SELECT *, dark*0.38e0 + valley*0.32e0 + least(1e0, greatest(0e0, (vh - v)/greatest(1e0, vh - vl)))*0.18e0 + central*0.12e0 AS score FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, x) = 1), u AS (SELECT *, least(1e0, valley*0.55e0 + dark*0.3e0 + central*0.15e0) AS q FROM t)
SELECT vec_id, CASE WHEN q < 0.28e0 OR valley < 0.08e0 THEN c ELSE x END::BIGINT AS x, {R('score')} AS score, {R('q')} AS confidence, q < 0.28e0 OR valley < 0.08e0 AS fallback FROM u"""),
    "frame_throttle": oracle("""WITH RECURSIVE s AS (SELECT stream_id, t_ms, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t_ms, event_id) AS n FROM {frames}), f AS (SELECT stream_id, n, t_ms, event_id, t_ms AS last, true AS kept FROM s WHERE n = 1
  UNION ALL SELECT s.stream_id, s.n, s.t_ms, s.event_id, CASE WHEN s.t_ms - last >= 250 THEN s.t_ms ELSE last END, s.t_ms - last >= 250 FROM f JOIN s ON s.stream_id = f.stream_id AND s.n = f.n + 1)
SELECT stream_id, t_ms, event_id FROM f WHERE kept"""),
    "snapshot_asof": oracle("""WITH s AS (SELECT stream_id, event_id, t_ms AS t FROM {frames} WHERE event_id % 10 = 0), f AS (SELECT stream_id, t_ms AS seen FROM {frames} WHERE detected AND confidence >= 0.22e0)
SELECT s.stream_id, s.event_id, s.t, max(f.seen) AS frame_t FROM s LEFT JOIN f ON f.stream_id = s.stream_id AND f.seen <= s.t AND s.t - f.seen <= 750 GROUP BY 1, 2, 3"""),
}
