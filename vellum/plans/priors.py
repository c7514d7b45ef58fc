"""Queries over spreads whose pages are found by their strongest lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.operators import priors as O
from vellum.sources.tables import oracle, view

WIDTH, HEIGHT = 64, 50


def pictures(spark, d):
    edge = F.transform("shades", lambda v, x: F.abs(F.get("shades", x + 1) - F.get("shades", x - 1)) > 40)
    return view(spark, d, "shades").filter("shades IS NOT NULL").withColumn("edges", edge)


def anchors(spark, d):
    lines = pictures(spark, d)
    return O.level_anchors(lines, O.upright_anchors(lines, WIDTH, HEIGHT), WIDTH, HEIGHT)


def spread_anchors(spark, d):
    """The strongest outer edge, spine, top and bottom of either page of a spread."""
    found = anchors(spark, d)
    return found.select("mask", "side", *[F.col(n).cast("long").alias(n) for n in ("outer", "spine", "top", "bottom")], *[r6(f"{n}_support").alias(f"{n}_support") for n in ("outer", "spine", "top", "bottom")])


def spread_priors(spark, d):
    """Pages that such lines make, with score and confidence."""
    left = F.when(F.col("side") == "left", 1).otherwise(0)
    told = anchors(spark, d).withColumns({
        "contrast": ((F.col("mask") * 2 + left) % 5) / 10.0 + 0.3, "paper": (F.col("mask") % 7) / 10.0 + 0.3, "envelope": (F.col("mask") % 10) / 50.0 + 0.79, "continuation": (F.col("mask") % 6) / 12.0,
    })
    found = O.prior_candidates(told, WIDTH, HEIGHT)
    return found.select("mask", "side", *[F.col(n).cast("long").alias(n) for n in ("outer", "spine", "top", "bottom")], r6("score").alias("score"), r6("confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (spread_anchors, spread_priors)}


def C(x: str) -> str:  # noqa: N802 - an abbreviation in SQL texts
    return f"least(1e0, greatest(0e0, {x}))"


FIRST, LAST = O.held(HEIGHT * O.LINES_FROM, 1, HEIGHT - 2), O.held(HEIGHT * O.LINES_TO, 3, HEIGHT - 1)
UPRIGHT = ", ".join(f"('{s}', '{r}', {O.reach(a, b, WIDTH)[0]}, {O.reach(a, b, WIDTH)[1]}, {b - a!r}::DOUBLE, {t}e0)" for s, r, a, b, t in O.UPRIGHT)
LEVEL = ", ".join(f"('{r}', {O.reach(a, b, HEIGHT)[0]}, {O.reach(a, b, HEIGHT)[1]}, {b - a!r}::DOUBLE, {t}e0)" for r, a, b, t in O.LEVEL)
ANCHORS = f"""p AS (SELECT mask, y, x, v, abs(lead(v) OVER h - lag(v) OVER h) AS gx, abs(coalesce(lead(v, 2) OVER h, last(v) OVER hh) - coalesce(lag(v, 2) OVER h, first(v) OVER hh)) AS cx,
  abs(lead(v) OVER u - lag(v) OVER u) AS gy, abs(coalesce(lead(v, 2) OVER u, last(v) OVER uu) - coalesce(lag(v, 2) OVER u, first(v) OVER uu)) AS cy FROM {{shaded}}
  WINDOW h AS (PARTITION BY mask, y ORDER BY x), hh AS (PARTITION BY mask, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), u AS (PARTITION BY mask, x ORDER BY y), uu AS (PARTITION BY mask, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cols AS (SELECT mask, x AS place, count(*) FILTER (gx > 40) / CAST(count(gx) AS DOUBLE) * 0.75e0 + {C("sum(gx) / 255e0 / count(gx)")} * 0.25e0 AS support, {C("sum(cx) / 255e0 / count(cx) * 3.2e0")} AS contrast FROM p WHERE y >= {FIRST} AND y < {LAST} GROUP BY mask, x HAVING count(gx) > 0),
roles(side, role, lo, hi, span, target) AS (VALUES {UPRIGHT}),
upright AS (SELECT mask, side, role, place, support FROM cols JOIN roles ON place BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY mask, side, role ORDER BY support*0.5e0 + contrast*0.3e0 + {C(f"1e0 - abs(place / {WIDTH}e0 - target) / span")}*0.2e0 DESC, place) = 1),
owned AS (SELECT o.mask, o.side, o.place AS "outer", o.support AS outer_support, s.place AS spine, s.support AS spine_support, least(o.place, s.place) AS l, greatest(o.place, s.place) AS r FROM upright o JOIN upright s ON s.mask = o.mask AND s.side = o.side AND o.role = 'outer' AND s.role = 'spine'
  WHERE (o.side = 'left') = (o.place < s.place) AND abs(o.place - s.place) >= {WIDTH * O.LEAST_WIDTH!r}::DOUBLE),
levels(role, lo, hi, span, target) AS (VALUES {LEVEL}),
lines AS (SELECT o.mask, o.side, role, any_value(span) AS span, any_value(target) AS target, y AS place, count(*) FILTER (gx > 40) / CAST(count(gy) AS DOUBLE) * 0.75e0 + {C("sum(gy) / 255e0 / count(gy)")} * 0.25e0 AS support, {C("sum(cy) / 255e0 / count(cy) * 3.2e0")} AS contrast
  FROM owned o JOIN levels ON true JOIN p ON p.mask = o.mask AND y BETWEEN lo AND hi AND x >= greatest(1, least(l, {WIDTH - 2})) AND x < least(r, {WIDTH - 1}) GROUP BY o.mask, o.side, role, y HAVING count(gy) > 0),
level AS (SELECT mask, side, role, place, support FROM lines QUALIFY row_number() OVER (PARTITION BY mask, side, role ORDER BY support*0.5e0 + contrast*0.3e0 + {C(f"1e0 - abs(place / {HEIGHT}e0 - target) / span")}*0.2e0 DESC, place) = 1),
anchors AS (SELECT o.*, t.place AS top, t.support AS top_support, b.place AS bottom, b.support AS bottom_support FROM owned o JOIN level t ON t.mask = o.mask AND t.side = o.side AND t.role = 'top' JOIN level b ON b.mask = o.mask AND b.side = o.side AND b.role = 'bottom')"""
NEAR = f"""{C("1e0 - og / 0.26e0")}*0.36e0 + {C("1e0 - t / 0.3e0")}*0.27e0 + {C("1e0 - (1e0 - b) / 0.3e0")}*0.27e0 + {C("1e0 - sg / 0.4e0")}*0.1e0"""
ORACLE = {
    "spread_anchors": oracle(f"""WITH {ANCHORS} SELECT mask, side, "outer", spine, top, bottom, {", ".join(f"{R(f'{n}_support')} AS {n}_support" for n in ("outer", "spine", "top", "bottom"))} FROM anchors"""),
    "spread_priors": oracle(f"""WITH {ANCHORS},
told AS (SELECT *, (mask*2 + CASE side WHEN 'left' THEN 1 ELSE 0 END) % 5 / 10e0 + 0.3e0 AS contrast, mask % 7 / 10e0 + 0.3e0 AS paper, mask % 10 / 50e0 + 0.79e0 AS envelope, mask % 6 / 12e0 AS continuation,
  l / {WIDTH}e0 AS lx, r / {WIDTH}e0 AS rx, top / {HEIGHT}e0 AS t, bottom / {HEIGHT}e0 AS b FROM anchors),
near AS (SELECT *, (rx - lx)*(b - t) AS area, CASE side WHEN 'left' THEN lx ELSE 1e0 - rx END AS og, CASE side WHEN 'left' THEN 1e0 - rx ELSE lx END AS sg FROM told
  WHERE bottom - top >= {HEIGHT * O.LEAST_HEIGHT!r}::DOUBLE AND outer_support >= 0.045e0 AND top_support >= 0.035e0 AND bottom_support >= 0.035e0 AND envelope >= 0.8e0 AND continuation < 0.42e0),
m AS (SELECT *, {C("(area - 0.24e0)/(0.68e0 - 0.24e0)")} AS occupancy, {C("(0.48e0 - area)/0.48e0")} AS small, {NEAR} AS border, {C("outer_support*0.42e0 + top_support*0.27e0 + bottom_support*0.27e0 + spine_support*0.04e0")} AS held FROM near),
n AS (SELECT *, {C("(1e0 - contrast)*(1e0 - border)*0.42e0 + small*0.28e0 + continuation*0.3e0")} AS line FROM m),
k AS (SELECT *, {C("occupancy*0.23e0 + border*0.15e0 + contrast*0.17e0 + paper*0.16e0 + 0.1e0 + held*0.19e0 - line*0.24e0 - small*0.18e0")} AS base FROM n WHERE area >= 0.24e0 AND line < 0.82e0)
SELECT mask, side, "outer", spine, top, bottom, {R("occupancy*0.24e0 + border*0.17e0 + contrast*0.11e0 + paper*0.13e0 + 0.06e0 + held*0.14e0 + envelope*0.08e0 + outer_support*0.07e0 - line*0.28e0 - small*0.22e0")} AS score,
  {R(f"greatest(base, {C('base*0.78e0 + ' + C('outer_support/0.16e0') + '*0.22e0')})")} AS confidence FROM k"""),
}
