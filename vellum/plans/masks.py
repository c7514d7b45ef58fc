"""Queries over masks: components, the page among them, its corners, and long lines along it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import hull as H
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.operators import lines as L
from vellum.operators import masks as M
from vellum.sources.tables import oracle, view

WIDTH, HEIGHT = 64, 32
#: Votes that make a line, and the least length and widest gap of a stretch of it.
VOTES, LENGTH, GAP = 12, 10.0, 4.0


def mask_runs(spark, d):
    return M.runs(view(spark, d, "masks"))


def mask_components(spark, d):
    """Every component with its pixels and bounds; pixels that touch at a corner are neighbours."""
    return M.components(M.labelled(mask_runs(spark, d)), WIDTH, HEIGHT)


def mask_components_by_sides(spark, d):
    """As above, with neighbours by sides only: more and smaller components."""
    found = M.components(M.labelled(mask_runs(spark, d), diagonal=False), WIDTH, HEIGHT)
    return found.groupBy("mask").agg(F.count(F.lit(1)).alias("components"), F.max("area").alias("largest"))


def mask_pages(spark, d):
    """The component of each mask that a page most likely is; every other mask has a guide."""
    guided = F.col("mask") % 2 == 0
    c = mask_components(spark, d).withColumns({"guide_x": F.when(guided, F.lit(20.0)), "guide_y": F.when(guided, F.lit(10.0))})
    return M.chosen(c, WIDTH, HEIGHT, ("guide_x", "guide_y")).select("mask", "label", "area", r6("score").alias("score"), "x_min", "y_min", "x_max", "y_max")


def component_rectangles(spark, d):
    """The corners of each component of six pixels or more: four extremes, or the smallest rectangle where two of them coincide."""
    runs = M.labelled(mask_runs(spark, d))
    large = runs.groupBy("mask", "label", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    ends = F.array(*[F.struct(F.col(x).alias("x"), F.col("y").alias("y")) for x in ("x0", "x1")])
    points = large.groupBy("mask", "label").agg(F.flatten(F.collect_list(ends)).alias("points"), F.sum("n").alias("n")).filter("n >= 6")
    shaped = points.withColumn("hull", H.hull(F.col("points"))).withColumn("r", H.smallest_rectangle(F.col("hull"))).withColumn("e", H.representative(F.col("points")))
    apart = F.size(F.array_distinct("e")) == 4
    corner = [F.when(apart, F.get("e", F.lit(k))[a].cast("double")).otherwise(F.get("r.corners", F.lit(k))[a]) for k in range(4) for a in ("x", "y")]
    named = [r6(c).alias(f"{a}{k}") for c, (k, a) in zip(corner, [(k, a) for k in range(4) for a in ("x", "y")], strict=True)]
    return shaped.select("mask", "label", F.size("hull").cast("long").alias("hull_size"), r6("r.area").alias("area"), apart.alias("extremes"), *named)


def edge_points(spark, d):
    """First and last pixels of runs: where a line crosses an edge."""
    return mask_runs(spark, d).select("mask", "y", F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"))


def mask_lines(spark, d):
    """The long lines of a mask's edges, 80 at most, by votes."""
    found = L.strongest(L.peaks(L.votes(edge_points(spark, d)), VOTES))
    return found.select("mask", F.col("angle").cast("long").alias("angle"), "distance", "votes", F.col("rank").cast("long").alias("rank"))


def mask_segments(spark, d):
    """Stretches of the long lines without a wide gap."""
    points = edge_points(spark, d)
    lines = L.strongest(L.peaks(L.votes(points), VOTES))
    return L.segments(points, lines, LENGTH, GAP)


def line_support(spark, d):
    """How well the long lines bear out the bounds of the page."""
    p = mask_pages(spark, d)
    bounds = [F.col(c).cast("double") for c in ("x_min", "y_min", "x_max", "y_min", "x_max", "y_max", "x_min", "y_max")]
    quads = p.select("mask", *[b.alias(f"{'xy'[i % 2]}{i // 2}") for i, b in enumerate(bounds)])
    return L.support(quads, mask_segments(spark, d), min(WIDTH, HEIGHT) * 0.035).select("mask", "supported", r6("score").alias("score"))


QUERIES = {f.__name__: f for f in (mask_runs, mask_components, mask_components_by_sides, mask_pages, component_rectangles, mask_lines, mask_segments, line_support)}

RUNS = """runs AS (SELECT mask, y, min(x) AS x0, max(x) AS x1, y * 4294967296 + min(x) AS run
  FROM (SELECT mask, y, x, x - row_number() OVER (PARTITION BY mask, y ORDER BY x) AS g FROM {pixels}) i GROUP BY mask, y, g)"""


def labels(reach: int) -> str:
    return f"""{RUNS},
links AS (SELECT a.mask, a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.mask = b.mask AND abs(a.y - b.y) = 1 AND a.x0 - {reach} <= b.x1 AND b.x0 - {reach} <= a.x1),
reached AS (SELECT mask, run, run AS label FROM runs UNION SELECT l.mask, l.b, r.label FROM reached r JOIN links l ON l.mask = r.mask AND l.a = r.run AND r.label < l.b),
labelled AS (SELECT r.*, label FROM runs r JOIN (SELECT mask, run, min(label) AS label FROM reached GROUP BY ALL) USING (mask, run)),
parts AS (SELECT mask, label, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area, min(x0) AS x_min, max(x1) AS x_max, min(y) AS y_min, max(y) AS y_max,
  bool_or(y = {HEIGHT // 2} AND x0 <= {WIDTH // 2} AND x1 >= {WIDTH // 2}) AS central FROM labelled GROUP BY mask, label)"""


CENTER = f"least(1e0, greatest(0e0, 1e0 - sqrt((cx - {WIDTH / 2}e0)*(cx - {WIDTH / 2}e0) + (cy - {HEIGHT / 2}e0)*(cy - {HEIGHT / 2}e0)) / {(WIDTH * WIDTH / 4 + HEIGHT * HEIGHT / 4) ** 0.5!r}::DOUBLE))"
GUIDE = f"least(1e0, greatest(0e0, 1e0 - sqrt((cx - 20e0)*(cx - 20e0) + (cy - 10e0)*(cy - 10e0)) / {(WIDTH * WIDTH + HEIGHT * HEIGHT) ** 0.5!r}::DOUBLE))"
PAGES = f"""{labels(1)},
sized AS (SELECT *, area / {WIDTH * HEIGHT}e0 AS share, greatest(x_max - x_min + 1, y_max - y_min + 1) / CAST(least(x_max - x_min + 1, y_max - y_min + 1) AS DOUBLE) AS sides,
  x_min + (x_max - x_min + 1) / 2e0 AS cx, y_min + (y_max - y_min + 1) / 2e0 AS cy FROM parts),
rated AS (SELECT *, CASE WHEN central THEN 1e0 ELSE {CENTER} END AS middle, least(1e0, greatest(0e0, 1e0 - (sides - 1e0)/7e0)) AS shape, {GUIDE} AS near FROM sized WHERE share BETWEEN 0.02e0 AND 0.995e0 AND sides <= 8),
scored AS (SELECT *, CASE WHEN mask % 2 = 0 THEN share*0.64e0 + middle*0.18e0 + shape*0.08e0 + near*0.1e0 ELSE share*0.7e0 + middle*0.2e0 + shape*0.1e0 END AS score FROM rated),
pages AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY mask ORDER BY score DESC, area DESC, label) = 1)"""
DIRECTIONS = ", ".join(f"({k}, {c}, {s})" for k, c, s in L.directions(180))
LINES = f"""edges AS (SELECT mask, y, x0 AS x FROM runs UNION SELECT mask, y, x1 FROM runs),
directions(angle, c, s) AS (VALUES {DIRECTIONS}),
cells AS (SELECT mask, angle, CAST(floor((x*c + y*s + 512) / 1024e0) AS BIGINT) AS distance, count(*) AS votes FROM edges, directions GROUP BY ALL HAVING count(*) >= {VOTES}),
tops AS (SELECT * FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.mask = a.mask AND ((b.angle = a.angle AND b.distance = a.distance - 1 AND b.votes >= a.votes) OR (b.angle = a.angle AND b.distance = a.distance + 1 AND b.votes > a.votes)
  OR (b.angle = a.angle - 1 AND b.distance = a.distance AND b.votes >= a.votes) OR (b.angle = a.angle + 1 AND b.distance = a.distance AND b.votes > a.votes)))),
long AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY votes DESC, angle, distance) AS rank FROM tops QUALIFY rank <= 80)"""
SEGMENTS = f"""{LINES},
placed AS (SELECT e.mask, l.angle, l.distance, e.x, e.y, e.y*d.c - e.x*d.s AS t FROM edges e JOIN long l ON l.mask = e.mask JOIN directions d ON d.angle = l.angle AND CAST(floor((e.x*d.c + e.y*d.s + 512) / 1024e0) AS BIGINT) = l.distance),
cut AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mask, angle, distance ORDER BY t, y, x) > {int(GAP * 1024)} THEN 1 ELSE 0 END AS starts FROM placed),
stretches AS (SELECT *, sum(starts) OVER (PARTITION BY mask, angle, distance ORDER BY t, y, x ROWS UNBOUNDED PRECEDING) AS part FROM cut),
segments AS (SELECT mask, angle, distance, first(x ORDER BY t, y, x) AS x0, first(y ORDER BY t, y, x) AS y0, last(x ORDER BY t, y, x) AS x1, last(y ORDER BY t, y, x) AS y1, count(*) AS points FROM stretches GROUP BY mask, angle, distance, part
  HAVING (x1 - x0)*(x1 - x0) + (y1 - y0)*(y1 - y0) >= {LENGTH * LENGTH})"""


def _to_segment(ax: str, ay: str, bx: str, by: str) -> str:
    dx, dy = f"(CAST({bx} AS DOUBLE) - {ax})", f"(CAST({by} AS DOUBLE) - {ay})"
    length = f"({dx}*{dx} + {dy}*{dy})"
    t = f"(CASE WHEN {length} <= 0 THEN 0e0 ELSE least(1e0, greatest(0e0, ((mx - {ax})*{dx} + (my - {ay})*{dy}) / {length})) END)"
    x, y = f"(mx - ({ax} + {dx}*{t}))", f"(my - ({ay} + {dy}*{t}))"
    return f"sqrt({x}*{x} + {y}*{y})"


BOX = [("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max")]
NEAREST = ", ".join(_to_segment(*BOX[k], *BOX[(k + 1) % 4]) for k in range(4))
CORNERS = [("p0", "n0"), ("p1", "n0"), ("p1", "n1"), ("p0", "n1")]
EXTREMES = ("x + y", "y - x", "-x - y", "x - y")
ORACLE = {
    "mask_runs": oracle(f"WITH {RUNS} SELECT * FROM runs"),
    "mask_components": oracle(f"WITH RECURSIVE {labels(1)} SELECT * FROM parts"),
    "mask_components_by_sides": oracle(f"WITH RECURSIVE {labels(0)} SELECT mask, count(*) AS components, max(area) AS largest FROM parts GROUP BY mask"),
    "mask_pages": oracle(f"WITH RECURSIVE {PAGES} SELECT mask, label, area, {R('score')} AS score, x_min, y_min, x_max, y_max FROM pages"),
    "component_rectangles": oracle(f"""WITH RECURSIVE {labels(1)},
points AS (SELECT DISTINCT mask, label, y, unnest([min(x0), max(x1)]) AS x FROM labelled WHERE (mask, label) IN (SELECT (mask, label) FROM parts WHERE area >= 6) GROUP BY mask, label, y),
sides AS (SELECT a.mask, a.label, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy, min(c.x*(b.x - a.x) + c.y*(b.y - a.y)) AS p0, max(c.x*(b.x - a.x) + c.y*(b.y - a.y)) AS p1,
  min(c.y*(b.x - a.x) - c.x*(b.y - a.y)) AS n0, max(c.y*(b.x - a.x) - c.x*(b.y - a.y)) AS n1
  FROM points a JOIN points b ON b.mask = a.mask AND b.label = a.label AND (a.x <> b.x OR a.y <> b.y) JOIN points c ON c.mask = a.mask AND c.label = a.label GROUP BY ALL
  HAVING bool_and((b.x - a.x)*(c.y - a.y) - (b.y - a.y)*(c.x - a.x) > 0 OR ((b.x - a.x)*(c.y - a.y) - (b.y - a.y)*(c.x - a.x) = 0 AND (c.x - a.x)*(b.x - a.x) + (c.y - a.y)*(b.y - a.y) BETWEEN 0 AND (b.x - a.x)*(b.x - a.x) + (b.y - a.y)*(b.y - a.y)))),
rated AS (SELECT *, CAST((p1 - p0)*(n1 - n0) AS DOUBLE) / CAST(dx*dx + dy*dy AS DOUBLE) AS area, CAST(dx*dx + dy*dy AS DOUBLE) AS sq, count(*) OVER (PARTITION BY mask, label) AS hull_size FROM sides),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY mask, label ORDER BY area, ax, ay) = 1),
ends AS (SELECT mask, label, {", ".join(f"first({a} ORDER BY {e}, y, x) AS e{a}{k}" for k, e in enumerate(EXTREMES) for a in ("x", "y"))} FROM points GROUP BY mask, label),
told AS (SELECT *, {" AND ".join(f"(ex{i} <> ex{j} OR ey{i} <> ey{j})" for i in range(4) for j in range(i))} AS extremes FROM best JOIN ends USING (mask, label))
SELECT mask, label, hull_size, {R("area")} AS area, extremes,
  {", ".join(f"{R(f'CASE WHEN extremes THEN CAST(ex{k} AS DOUBLE) ELSE CAST({p}*dx - {n}*dy AS DOUBLE) / sq END')} AS x{k}, {R(f'CASE WHEN extremes THEN CAST(ey{k} AS DOUBLE) ELSE CAST({p}*dy + {n}*dx AS DOUBLE) / sq END')} AS y{k}" for k, (p, n) in enumerate(CORNERS))} FROM told"""),
    "mask_lines": oracle(f"WITH {RUNS}, {LINES} SELECT mask, angle, distance, votes, rank FROM long"),
    "mask_segments": oracle(f"WITH {RUNS}, {SEGMENTS} SELECT * FROM segments"),
    "line_support": oracle(f"""WITH RECURSIVE {PAGES}, {SEGMENTS},
middles AS (SELECT mask, (x0 + x1) / 2e0 AS mx, (y0 + y1) / 2e0 AS my FROM segments),
counted AS (SELECT p.mask, count(*) FILTER (least({NEAREST}) <= {min(WIDTH, HEIGHT) * 0.035!r}::DOUBLE) AS supported FROM pages p LEFT JOIN middles m ON m.mask = p.mask GROUP BY p.mask)
SELECT mask, supported, {R("least(1e0, supported / 4e0)")} AS score FROM counted"""),
}
