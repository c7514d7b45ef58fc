"""Queries over samples around a page's edges.  A made-up picture gives every place its colours, so that samples are arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.operators import evidence as O
from vellum.sources.tables import oracle, view

# the picture, in the words of both engines: brightness, two colours, strength of edges
L = "(CASE WHEN {x} BETWEEN 95 AND 905 AND {y} BETWEEN 145 AND 1275 THEN 190e0 ELSE 70e0 END + ({x}*7 + {y}*13 + page_id) % 23)"
A = "(128e0 + ({x}*3 + {y}*5) % 7)"
B = "(120e0 + ({x} + {y}*11) % 9)"
G = "(0e0 + ({x}*5 + {y}*3 + page_id) % 97)"


def at(text: str, x: str, y: str) -> str:
    return text.format(x=x, y=y)


def sheets(spark, d):
    return view(spark, d, "sheets")


def looked_up(spark, d):
    places = O.edge_places(sheets(spark, d))
    colours = {f"{side[0]}{c}": O.each(at(t, f"get({side}_x, {{k}})", f"get({side}_y, {{k}})")) for side in ("in", "out") for c, t in zip("lab", (L, A, B), strict=True)}
    gradient = F.expr(f"zip_with(x, y, (x, y) -> {at(G, 'x', 'y')})")
    return places.select("page_id", "edge", "limit", "step", "offset", *[c.alias(n) for n, c in colours.items()], gradient.alias("gradient"))


def edge_evidence(spark, d):
    found = O.edge_evidence(looked_up(spark, d))
    return found.select("page_id", "edge", r6("offset").alias("offset"), *[r6(c).alias(c) for c in ("score", "support", "continuity", "occlusion")])


def edge_moves(spark, d):
    found = O.edge_moves(O.edge_evidence(looked_up(spark, d)))
    return found.select("page_id", "edge", r6("offset").alias("offset"), r6("evidence").alias("evidence"), "reliable", "conservative")


def below_bottoms(spark, d):
    s = sheets(spark, d).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    s = s.withColumns({"x": 110 + F.col("i") * 40 + F.col("page_id") % 7, "y": 1265 + (F.col("page_id") * 3 + F.col("i")) % 40})
    tests = {"l": L, "a": A, "b": B, "gradient": at(G, "{x}", "{y}") + "/4e0"}
    s = s.select("page_id", *[F.expr(at(t, "x", "y")).alias(n) for n, t in tests.items()], ((F.col("page_id") + F.col("i")) % 90 == 0).alias("mask"))
    return O.below_bottom(s)


def boundary_signals(spark, d):
    places = O.band_places(sheets(spark, d))
    samples = places.select("page_id", "band", F.expr(at(L, "x", "y")).alias("brightness"), ((F.col("x") + F.col("y") * 3 + F.col("page_id")) % 29 == 0).alias("edge"))
    contrast = sheets(spark, d).select("page_id", (F.col("page_id") % 11 / 10.0).alias("contrast"))
    return O.boundary_signals(samples, contrast).select("page_id", *[r6(c).alias(c) for c in ("top", "bottom", "containment", "continuity")])


def envelope_shares(spark, d):
    points = view(spark, d, "outline").filter("pos % 5 > 0").select("page_id", (F.col("px") * 0.9 + 60.0).alias("x"), (F.col("py") + 30.0).alias("y"))
    return O.contained(points, sheets(spark, d), 1000).select("page_id", r6("share").alias("share"))


def paper_region_candidates(spark, d):
    c = view(spark, d, "candidates").withColumn("vertices", F.floor(F.col("aspect_ratio") * 20.0))
    return c.select("page_id", "ord", O.is_paper_region().alias("fits"))


QUERIES = {f.__name__: f for f in (edge_evidence, edge_moves, below_bottoms, boundary_signals, envelope_shares, paper_region_candidates)}
EDGES = " UNION ALL ".join(f"SELECT page_id, {k} AS edge, x{k} AS ax, y{k} AS ay, x{(k + 1) % 4} AS bx, y{(k + 1) % 4} AS b_y, 1000e0*CASE WHEN side = '{s}' THEN 0.055e0 ELSE 0.1e0 END AS lim FROM {{sheets}}" for k, s in enumerate(("-", "left", "-", "right")))
EVIDENCE = f"""e AS ({EDGES}), n AS (SELECT *, sqrt((ax - bx)*(ax - bx) + (ay - b_y)*(ay - b_y)) AS len, (b_y - ay)/len AS nx, (ax - bx)/len AS ny FROM e),
o AS (SELECT *, s*3e0 AS off, ax + (bx - ax)*(i/14e0) + nx*(s*3e0) AS fx, ay + (b_y - ay)*(i/14e0) + ny*(s*3e0) AS fy FROM n, range(34) r(s), range(1, 14) q(i) WHERE s*3e0 <= lim + 0.1e0),
p AS (SELECT page_id, edge, lim, off, i, floor(fx + 0.5e0)::INT AS x, floor(fy + 0.5e0)::INT AS y, floor(fx - nx*4e0 + 0.5e0)::INT AS ix, floor(fy - ny*4e0 + 0.5e0)::INT AS iy, floor(fx + nx*4e0 + 0.5e0)::INT AS ox, floor(fy + ny*4e0 + 0.5e0)::INT AS oy FROM o),
v AS (SELECT page_id, edge, lim, off, i, {at(L, "ix", "iy")} AS il, {at(A, "ix", "iy")} AS ia, {at(B, "ix", "iy")} AS ib, {at(L, "ox", "oy")} AS ol, {at(A, "ox", "oy")} AS oa, {at(B, "ox", "oy")} AS ob, {at(G, "x", "y")} AS g
  FROM p WHERE least(ix, ox) >= 1 AND greatest(ix, ox) < 999 AND least(iy, oy) >= 1 AND greatest(iy, oy) < 1399),
c AS (SELECT *, least(1e0, sqrt((il - ol)*(il - ol) + (ia - oa)*(ia - oa) + (ib - ob)*(ib - ob))/58e0*0.5e0 + abs(il - ol)/52e0*0.25e0 + g/96e0*0.25e0) AS sc FROM v),
m AS (SELECT page_id, edge, off, quantile_cont(sc, 0.5) AS ms, quantile_cont(il, 0.5) AS ml, quantile_cont(ia, 0.5) AS ma, quantile_cont(ib, 0.5) AS mb, count(*) AS n, count(*) FILTER (sc >= 0.22e0)/count(*)::DOUBLE AS support FROM c GROUP BY ALL),
d AS (SELECT c.page_id, c.edge, c.lim, c.off, c.i, sc, abs(sc - ms) AS ds, sqrt((il - ml)*(il - ml) + (ia - ma)*(ia - ma) + (ib - mb)*(ib - mb)) AS k, n, support FROM c JOIN m USING (page_id, edge, off)),
f AS (SELECT page_id, edge, off, greatest(0.025e0, quantile_cont(ds, 0.5)) AS sd, quantile_cont(k, 0.5) AS mk FROM d GROUP BY ALL), h AS (SELECT page_id, edge, off, greatest(2e0, quantile_cont(abs(k - mk), 0.5)) AS kd FROM d JOIN f USING (page_id, edge, off) GROUP BY ALL),
w AS (SELECT d.*, lag(sc) OVER (PARTITION BY page_id, edge, off ORDER BY i) AS b FROM d JOIN f USING (page_id, edge, off) JOIN h USING (page_id, edge, off) WHERE ds <= sd*2.8e0 AND k <= mk + kd*2.8e0),
z AS (SELECT page_id, edge, off, any_value(lim) AS lim, any_value(n) AS n, any_value(support) AS support, count(*) AS ins, CASE WHEN count(*) < 2 THEN 1e0 ELSE count(*) FILTER (abs(sc - b) > 0.34e0)/(count(*) - 1)::DOUBLE END AS br, list(sc ORDER BY sc) AS l, floor(count(*)*0.18e0)::BIGINT AS cut FROM w GROUP BY page_id, edge, off),
ev AS (SELECT page_id, edge, lim, off, list_reduce(l[cut + 1 : len(l) - cut], lambda u, t: u + t)/(len(l) - 2*cut) AS score, support, 1e0 - br AS continuity, least(1e0, (1e0 - ins/n::DOUBLE)*0.7e0 + br*0.3e0) AS occlusion FROM z)"""
ORACLE = {
    "edge_evidence": oracle(f"WITH {EVIDENCE} SELECT page_id, edge, {R('off')} AS \"offset\", {R('score')} AS score, {R('support')} AS support, {R('continuity')} AS continuity, {R('occlusion')} AS occlusion FROM ev"),
    "edge_moves": oracle(f"""WITH {EVIDENCE}, s AS (SELECT *, least(1e0, score + off/lim*0.04e0) AS sure FROM ev WHERE support >= 0.38e0), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page_id, edge ORDER BY sure DESC, off) = 1),
a AS (SELECT x.page_id, x.edge, x.lim, b.score, coalesce(b.off, 0e0) AS o, coalesce(b.sure, 0e0) AS sure, coalesce(b.continuity, 0e0) AS co, coalesce(b.occlusion, 1e0) AS oc FROM (SELECT DISTINCT page_id, edge, lim FROM ev) x LEFT JOIN b ON b.page_id = x.page_id AND b.edge = x.edge),
k AS (SELECT *, edge = 2 AND oc > 0.48e0 AS held, least(1e0, least(1e0, greatest(0e0, (sure - 0.18e0)/0.34e0))*0.42e0 + co*0.18e0 + 0.2e0 + 0.14e0 + (1e0 - oc)*0.06e0) AS safe FROM a), j AS (SELECT *, CASE WHEN held THEN 0e0 ELSE o END AS want FROM k)
SELECT page_id, edge, {R("least(want, lim*safe)")} AS "offset", {R("sure")} AS evidence, NOT held AND coalesce(score >= 0.24e0, false) AND oc <= 0.48e0 AS reliable, least(want, lim*safe) + 0.1e0 < want AS conservative FROM j"""),
    "below_bottoms": oracle(f"""WITH p AS (SELECT page_id, i, 110 + i*40 + page_id % 7 AS x, 1265 + (page_id*3 + i) % 40 AS y FROM {{sheets}}, range(20) r(i)), v AS (SELECT page_id, i, {at(L, "x", "y")} AS l, {at(A, "x", "y")} AS a, {at(B, "x", "y")} AS b, {at(G, "x", "y")}/4e0 AS g FROM p)
SELECT page_id, count(*) FILTER (g >= 28) >= 0.018e0*20 OR count(*) FILTER (l <= 112) >= 0.018e0*20 OR count(*) FILTER ((page_id + i) % 90 = 0) >= 0.018e0*20 AS foreground, count(*) FILTER (l >= 135 AND abs(a - 128) <= 38 AND abs(b - 128) <= 38) >= 9 AS continues FROM v GROUP BY page_id"""),
    "boundary_signals": oracle(f"""WITH s AS (SELECT page_id, least(x0, x1, x2, x3) AS l, greatest(x0, x1, x2, x3) AS r, (y0 + y1)/2e0 AS t, (y2 + y3)/2e0 AS b FROM {{sheets}}), g AS (SELECT *, (b - t)*0.18e0 AS deep, (b - t)*0.02e0 AS gap, l + (r - l)*0.12e0 AS xa, r - (r - l)*0.12e0 AS xb FROM s),
n AS (SELECT page_id, xa, xb, 'ti' AS band, t + gap AS ya, t + deep AS yb FROM g UNION ALL SELECT page_id, xa, xb, 'to', t - deep, t - gap FROM g UNION ALL SELECT page_id, xa, xb, 'bi', b - deep, b - gap FROM g UNION ALL SELECT page_id, xa, xb, 'bo', b + gap, b + deep FROM g),
i AS (SELECT page_id, band, greatest(0, least(999, floor(xa + 0.5e0)))::INT AS x1, greatest(0, least(999, floor(xb + 0.5e0)))::INT AS x2, greatest(0, least(1399, floor(ya + 0.5e0)))::INT AS y1, greatest(0, least(1399, floor(yb + 0.5e0)))::INT AS y2 FROM n),
c AS (SELECT page_id, band, unnest(range(x1, x2 + 1, greatest(1, (x2 - x1) // 48))) AS x, y1, y2 FROM i WHERE x2 > x1 AND y2 > y1), k AS (SELECT page_id, band, x, unnest(range(y1, y2 + 1, greatest(1, (y2 - y1) // 14))) AS y FROM c),
m AS (SELECT page_id, band, count(*) AS n, avg({at(L, "x", "y")}) AS mean, count(*) FILTER ((x + y*3 + page_id) % 29 = 0)/count(*)::DOUBLE AS e FROM k GROUP BY page_id, band),
q AS (SELECT i.page_id, i.band, CASE WHEN least(i.n, o.n) < 20 THEN 0e0 ELSE least(1e0, least(least(1e0, o.e/greatest(i.e, 0.012e0)), least(1e0, o.e*12e0))*0.78e0 + greatest(0e0, 1e0 - abs(i.mean - o.mean)/55e0)*0.22e0) END AS c FROM m i JOIN m o ON o.page_id = i.page_id AND (i.band = 'ti' AND o.band = 'to' OR i.band = 'bi' AND o.band = 'bo')),
u AS (SELECT page_id, max(c) FILTER (band = 'ti') AS top, max(c) FILTER (band = 'bi') AS bottom, max(c) AS most FROM q GROUP BY page_id)
SELECT page_id, {R("top")} AS top, {R("bottom")} AS bottom, {R("1e0 - most*0.55e0")} AS containment, {R("page_id % 11/10e0*0.7e0 + (1e0 - most)*0.3e0")} AS continuity FROM u"""),
    "envelope_shares": oracle(f"""WITH p AS (SELECT o.page_id, px*0.9e0 + 60e0 AS x, py + 30e0 AS y, s.* EXCLUDE (page_id) FROM {{outline}} o JOIN {{sheets}} s ON s.page_id = o.page_id WHERE pos % 5 > 0),
k AS (SELECT page_id, ({" + ".join(f"CASE WHEN (y{k} > y) <> (y{(k + 3) % 4} > y) THEN (x < (x{(k + 3) % 4} - x{k})*(y - y{k})/(y{(k + 3) % 4} - y{k}) + x{k})::INT ELSE 0 END" for k in range(4))}) % 2 = 1 AS inside FROM p
  WHERE x >= CASE WHEN side = 'right' THEN 200 ELSE 20 END AND x <= CASE WHEN side = 'left' THEN 799 ELSE 979 END)
SELECT page_id, {R("CASE WHEN count(*) < 16 THEN 1e0 ELSE count(*) FILTER (inside)/count(*)::DOUBLE END")} AS share FROM k GROUP BY page_id"""),
    "paper_region_candidates": oracle("""SELECT page_id, ord, area_ratio >= CASE WHEN side = 'single' THEN 0.2e0 ELSE 0.24e0 END AND floor(aspect_ratio*20e0) BETWEEN 4 AND 28 AND width_ratio >= CASE WHEN side = 'single' THEN 0.46e0 ELSE 0.42e0 END AND height_ratio >= 0.48e0
  AND greatest(width_ratio, height_ratio)/least(width_ratio, height_ratio) <= 8 AND envelope >= 0.78e0 AS fits FROM {candidates}"""),
}
