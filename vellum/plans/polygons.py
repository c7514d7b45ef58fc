"""Queries for the polygon that a page is cut by, and for search regions in the source's pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions.geometry import Quad
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.operators import polygons as O
from vellum.plans.refinement import VERDICT, VIS
from vellum.sources.tables import oracle, view

W, H = 1000.0, 1400.0
CORNERS = [f"{a}{k}" for k in range(4) for a in "xy"]


def pages(spark, d):
    """A page is the first of its outlines, with the first of its evidence."""
    outline = view(spark, d, "quads").groupBy("page_id").agg(F.min(F.struct("ord", "side", *CORNERS)).alias("q")).select("page_id", "q.*").drop("ord")
    candidate = F.col("paper_score").isNotNull()
    first = F.struct("ord", F.when(candidate, F.col("ownership")).alias("ownership"), F.when(candidate, F.col("adjacent")).alias("adjacent"), (P.refinement_verdict() == "accepted").alias("accepted"), "expansion")
    head = view(spark, d, "evidence").groupBy("page_id").agg(F.min(first).alias("e")).select("page_id", "e.*").drop("ord")
    q = Quad.of()
    dx, dy = F.greatest(q.width * 0.10, F.lit(W * 0.02)), F.greatest(q.height * 0.14, F.lit(H * 0.02))
    region = [F.greatest(q.left - dx, F.lit(0.0)).alias("roi_left"), F.greatest(q.top - dy, F.lit(0.0)).alias("roi_top"), F.least(q.right + dx, F.lit(W)).alias("roi_right"), F.least(q.bottom + dy, F.lit(H)).alias("roi_bottom")]
    grown = [(F.lit(m) + (F.col(f"{a}{k}") - m) * F.col("expansion")).alias(f"r{a}{k}") for k in range(4) for a, m in (("x", W / 2), ("y", H / 2))]
    return outline.join(head, "page_id").select("*", F.lit(1000).alias("width"), F.lit(1400).alias("height"), *region, *grown)


def edges(spark, d):
    return view(spark, d, "evidence").select("page_id", "edge", "ord", P.edge_visibility().alias("visibility"), (F.col("requested") * W).alias("offset"), F.col("agree").alias("foreground_beyond"), F.col("conflict").alias("paper_beyond"))


def safe_polygons(spark, d):
    """Each page's polygon: refined, raw edges moved by what is seen of them, raw edges with margins, or none."""
    found = O.safe_polygons(pages(spark, d), edges(spark, d))
    return found.select("page_id", "source", *[r6(c).alias(c) for c in CORNERS])


def source_regions(spark, d):
    """Search regions of a scaled picture in pixels of its source."""
    q = Quad.of()
    scale = (F.col("ord") % 5 + 4) / 10.0
    found = O.to_source(F.floor(q.left), F.floor(q.top), F.ceil(q.width), F.ceil(q.height), scale, 1600, 2400)
    return view(spark, d, "quads").select("page_id", "ord", *[v.alias(n) for v, n in zip(found, ("left", "top", "width", "height"), strict=True)])


def shifted_sql(offset: str, name: str) -> str:
    """Corners after the move, held within the picture."""
    out = []
    for k in range(4):
        lines = []
        for i in ((k + 3) % 4, k):
            n = (i + 1) % 4
            length = f"greatest(sqrt((x{i} - x{n})*(x{i} - x{n}) + (y{i} - y{n})*(y{i} - y{n})), 1e0)"
            lines.append((f"(x{i} + (y{n} - y{i})/{length}*{offset}{i})", f"(y{i} + (x{i} - x{n})/{length}*{offset}{i})", f"(x{n} - x{i})", f"(y{n} - y{i})"))
        (px, py, dx, dy), (qx, qy, ex, ey) = lines
        t = f"(CASE WHEN abs({dx}*{ey} - {dy}*{ex}) >= 1e-6 THEN (({qx} - {px})*{ey} - ({qy} - {py})*{ex})/({dx}*{ey} - {dy}*{ex}) END)"
        for a, p, s, most in (("x", px, dx, W), ("y", py, dy, H)):
            value = f"({p} + {s}*{t})"
            out.append(f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, 0e0), {most}e0) END AS {name}_{a}{k}")
    return ", ".join(out)


def area_sql(p: str) -> str:
    return "abs(" + " + ".join(f"({p}x{i}*{p}y{(i + 1) % 4} - {p}x{(i + 1) % 4}*{p}y{i})" for i in range(4)) + ")/2e0"


def safe_sql(p: str) -> str:
    turns = [f"((floor({p}x{b}) - floor({p}x{a}))*(floor({p}y{c}) - floor({p}y{b})) - (floor({p}y{b}) - floor({p}y{a}))*(floor({p}x{c}) - floor({p}x{b})))" for a, b, c in ((i, (i + 1) % 4, (i + 2) % 4) for i in range(4))]
    return f"coalesce({area_sql(p)}/greatest({area_sql('')}, 1e0) BETWEEN 0.96e0 AND 1.7e0 AND ({' AND '.join(t + ' > 0' for t in turns)} OR {' AND '.join(t + ' < 0' for t in turns)}), false)"


OCCLUDED = ["WHEN 'occluded' THEN 0.03e0", "WHEN 'occluded' THEN 0.03e0", "", "WHEN 'occluded' THEN 0.03e0"]


def offset_sql(k: int, edge: str) -> str:
    n = (k + 1) % 4
    x, y = f"(x{k} + x{n})/2e0", f"(y{k} + y{n})/2e0"
    frame = (y, f"1000e0 - {x}", f"1400e0 - {y}", x)[k]
    spine = {1: "coalesce(side = 'left', false)", 3: "coalesce(side = 'right', false)"}.get(k, "false")
    below = f"WHEN {edge}_f OR {edge}_p THEN greatest(100e0, rb - {y})" if k == 2 else ""
    least = f"CASE {edge}_v WHEN 'confirmed' THEN 0e0 WHEN 'weak' THEN {'0.035e0' if k == 2 else '0.012e0'} {OCCLUDED[k]} ELSE {'0.07e0' if k == 2 else '0.04e0'} END"
    return f"least(greatest({edge}_o, 1000e0*{least}), CASE WHEN {spine} THEN 1000e0*0.055e0 WHEN {edge}_v = 'outOfFrame' THEN greatest(1000e0*0.1e0, {frame}) {below} ELSE 1000e0*0.1e0 END) AS s{k}, {'70e0' if k == 2 else '12e0'} AS f{k}"


SEEN = " OR ".join(f"coalesce({e}_v, '') IN ('confirmed', 'weak', 'occluded')" for e in O.EDGES)
QUERIES = {f.__name__: f for f in (safe_polygons, source_regions)}
ORACLE = {
    "safe_polygons": oracle(f"""
WITH q AS (SELECT page_id, side, {', '.join(CORNERS)} FROM {{quads}} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord, side, {', '.join(CORNERS)}) = 1),
v AS (SELECT *, {VIS} AS vis, coalesce({VERDICT} = 'accepted', false) AS accepted, CASE WHEN paper_score IS NOT NULL THEN ownership END AS own, CASE WHEN paper_score IS NOT NULL THEN adjacent END AS adj FROM {{evidence}}),
h AS (SELECT page_id, own, adj, accepted, expansion FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord, own NULLS FIRST, adj NULLS FIRST, accepted, expansion) = 1),
o AS (SELECT page_id, edge, vis, requested*1000e0 AS off, agree, conflict FROM v QUALIFY row_number() OVER (PARTITION BY page_id, edge ORDER BY ord, vis, requested, agree, conflict) = 1),
p AS (SELECT page_id, {', '.join(f"max(vis) FILTER (edge = '{e}') AS {e}_v, max(off) FILTER (edge = '{e}') AS {e}_o, bool_or(agree) FILTER (edge = '{e}') AS {e}_f, bool_or(conflict) FILTER (edge = '{e}') AS {e}_p" for e in O.EDGES)} FROM o GROUP BY page_id),
j AS (SELECT *, least(greatest(y0, y1, y2, y3) + greatest((greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3))*0.14e0, 28e0), 1400e0) AS rb FROM q JOIN h USING (page_id) JOIN p USING (page_id)),
s AS (SELECT *, {', '.join(offset_sql(k, e) for k, e in enumerate(O.EDGES))} FROM j),
c AS (SELECT *, {shifted_sql('s', 'h')}, {shifted_sql('f', 'b')} FROM s),
d AS (SELECT *, CASE WHEN coalesce(own, 1e0) < 0.66e0 OR coalesce(adj, 0e0) >= 0.66e0 THEN NULL
  WHEN accepted AND {' AND '.join(f"coalesce({e}_v = 'confirmed', false)" for e in O.EDGES)} THEN 'ai_refined'
  WHEN (own IS NOT NULL OR {SEEN}) AND {safe_sql('h_')} THEN 'ai_hybrid' WHEN {safe_sql('b_')} THEN 'ai_raw_fallback' END AS source FROM c)
SELECT page_id, source, {', '.join(R(f"CASE source WHEN 'ai_refined' THEN {m}e0 + ({a}{k} - {m}e0)*expansion WHEN 'ai_hybrid' THEN h_{a}{k} WHEN 'ai_raw_fallback' THEN b_{a}{k} END") + f' AS {a}{k}' for k in range(4) for a, m in (('x', 500), ('y', 700)))} FROM d"""),
    "source_regions": oracle("""
WITH q AS (SELECT page_id, ord, (ord % 5 + 4)/10e0 AS s, floor(least(x0, x1, x2, x3)) AS l, floor(least(y0, y1, y2, y3)) AS t, ceil(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3)) AS w, ceil(greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3)) AS h FROM {quads}),
r AS (SELECT *, least(greatest(floor(l/s), 0e0), 1599e0) AS sl, least(greatest(floor(t/s), 0e0), 2399e0) AS st FROM q)
SELECT page_id, ord, sl::BIGINT AS "left", st::BIGINT AS top, least(greatest(ceil(w/s), 1e0), 1600e0 - sl)::BIGINT AS width, least(greatest(ceil(h/s), 1e0), 2400e0 - st)::BIGINT AS height FROM r"""),
}
