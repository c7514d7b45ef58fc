"""Queries over outlines of pages, their columns and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import stats as S
from vellum.functions.geometry import Quad
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.operators import outlines as O
from vellum.sources.tables import oracle, view

CORNERS = [f"{n}{k}" for k in range(4) for n in ("x", "y")]


def outer_envelopes(spark, d):
    found = O.envelopes(view(spark, d, "outline"), view(spark, d, "sheets"))
    return found.select("page_id", *[r6(c).alias(c) for c in CORNERS], r6("consistency").alias("consistency"))


def narrow_connections(spark, d):
    columns = view(spark, d, "profile").join(view(spark, d, "sheets").select(F.col("page_id").alias("vec_id"), "side"), "vec_id")
    columns = columns.select(F.col("vec_id").alias("page_id"), "x", F.floor(F.abs(F.col("mean") - 100.0)).alias("filled"), (F.lit(28) + F.col("vec_id") % 9).alias("centre"), F.lit(63).alias("last"), "side")
    return O.narrow_connections(columns).select("page_id", r6("penalty").alias("penalty"))


def native_spine_places(spark, d):
    columns = view(spark, d, "profile").select(F.col("vec_id").alias("page_id"), (F.col("x") * 3 + 16).alias("x"), "mean")
    lines = view(spark, d, "sheets").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    at = (F.col("page_id") * 7 + F.col("ord") * 31) % 160
    lines = lines.select("page_id", "ord", (at + 10.0).alias("ax"), F.lit(5.0).alias("ay"), (at + F.col("ord") * 20 + 10.0).alias("bx"), (F.lit(20.0) + (F.col("page_id") * 13 + F.col("ord") * 57) % 270).alias("by"))
    found = O.native_spines(columns, lines.filter("page_id % 4 <> 0"), 200, 300)
    return found.select("page_id", r6("x").alias("x"), r6("strength").alias("strength"))


def curve_fusion(spark, d):
    t = O.fused_curves(O.curve_signs(view(spark, d, "curves"), 1000.0))
    return t.select("page_id", *[r6(c).alias(c) for c in ("top", "bottom", "internal", "contour", "consistency")], "n_geometry", "n_internal", "agree", "conflict", "mild")


def clamped_contours(spark, d):
    return O.clamped_contours(view(spark, d, "curves"), 16, 1000.0).select("page_id", "curve", "x", r6("off").alias("off"))


def outline_boundaries(spark, d):
    b = O.boundaries_of_outlines(view(spark, d, "outline"), view(spark, d, "sheets"))
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"] + p["y"] * 2.0)
    return b.select("page_id", "edge", "n", r6(total).alias("total"))


def lattice_signals(spark, d):
    cells = O.lattice(view(spark, d, "sheets"))
    samples = cells.select("page_id", ((F.col("x") * 7 + F.col("y") * 13 + F.col("page_id")) % 256).cast("double").alias("brightness"), ((F.col("x") + F.col("y")) % 11 == 0).alias("edge"))
    return O.region_signals(samples).select("page_id", *[r6(c).alias(c) for c in ("text", "even", "mean", "bright")])


def text_curve_ranks(spark, d):
    q = view(spark, d, "placed_quads")
    boxes = q.select((F.col("page_id") % 500).alias("page_id"), (F.col("page_id") * 10 + F.col("ord")).alias("ord"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), ((F.col("jy") + 40.0) * 2.0).alias("h"))
    region = Quad([F.lit(v) for v in (60.0, 800.0, 800.0, 60.0)], [F.lit(v) for v in (30.0, 30.0, 1230.0, 1230.0)])
    return O.text_curves(boxes, region).select("page_id", "ord", "rank", "used")


def mask_probabilities(spark, d):
    """The mean of probabilities under a mask; 0 where it is empty."""
    p = view(spark, d, "profile").select(F.col("vec_id").alias("page_id"), (F.col("mean") / 256.0).alias("p"), ((F.col("x") % 3 > 0) & (F.col("vec_id") % 10 > 0)).alias("in"))
    return p.groupBy("page_id").agg(r6(F.coalesce(F.avg(F.when(F.col("in"), F.col("p"))), F.lit(0.0))).alias("probability"))


def tapered_curves(spark, d):
    """Offsets of curves that fade at the ends of their page, which starts and ends within the columns."""
    start, width = (F.col("page_id") % 4).cast("double"), (F.col("page_id") % 3 + 9).cast("double")
    return view(spark, d, "curves").select("page_id", "curve", F.col("x").cast("long").alias("x"), r6(S.tapered(F.col("off"), F.col("x"), start, width)).alias("off"))


QUERIES = {
    f.__name__: f for f in (outer_envelopes, narrow_connections, native_spine_places, curve_fusion, clamped_contours, outline_boundaries, lattice_signals, text_curve_ranks, mask_probabilities, tapered_curves)
}


def edges(table, extra=""):
    """One row per edge, from (ax, ay) to (bx, by)."""
    return " UNION ALL ".join(f"SELECT page_id{extra}, {k} AS edge, x{k} AS ax, y{k} AS ay, x{(k + 1) % 4} AS bx, y{(k + 1) % 4} AS \"by\" FROM {table}" for k in range(4))


CENTRAL = """n AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY page_id, curve) AS n FROM {curves} WINDOW w AS (PARTITION BY page_id, curve ORDER BY x)),
k AS (SELECT *, least(floor(n*0.1e0 + 0.5e0), floor((n - 1)/2e0)) AS trim FROM n),
g AS (SELECT page_id, curve, list(abs(off) ORDER BY abs(off)) AS s, quantile_cont(off, 0.5) AS m FROM k WHERE nth > trim AND nth <= n - trim GROUP BY page_id, curve),
c AS (SELECT page_id, curve, s[floor((len(s) - 1)*0.9e0 + 0.5e0)::BIGINT + 1]/1000e0 AS mag, CASE WHEN len(s) >= 3 AND abs(m) > 1e-6 THEN sign(m) END AS dir FROM g)"""
ORACLE = {
    "tapered_curves": oracle(f"""WITH c AS (SELECT *, CAST(page_id % 4 AS DOUBLE) AS a, CAST(page_id % 3 + 9 AS DOUBLE) AS w FROM {{curves}}), n AS (SELECT *, least(x - a, a + w - 1 - x) AS near FROM c)
SELECT page_id, curve, x, {R('CASE WHEN near < 0 THEN 0e0 ELSE off*least(1e0, near/2e0) END')} AS off FROM n"""),
    "outer_envelopes": oracle(f"""WITH e AS ({edges("{sheets}", ", side, width, height")}), l AS (SELECT *, sqrt((ax - bx)*(ax - bx) + (ay - "by")*(ay - "by")) AS d, greatest(d, 1e0) AS len FROM e),
p AS (SELECT l.*, (px - ax)*((bx - ax)/len) + (py - ay)*(("by" - ay)/len) AS along, (px - ax)*(("by" - ay)/len) - (py - ay)*((bx - ax)/len) AS outward FROM l JOIN {{outline}} USING (page_id)),
m AS (SELECT page_id, edge, coalesce(quantile_cont(outward, 0.88) FILTER (outward >= 0 AND along BETWEEN -0.08e0*len AND len*1.08e0), 0e0) AS o, any_value(least(width, height)*CASE WHEN side = 'left' AND edge = 1 OR side = 'right' AND edge = 3 THEN 0.055e0 ELSE 0.1e0 END) AS lim FROM p GROUP BY page_id, edge HAVING count(*) >= 4),
s AS (SELECT l.page_id, l.edge, ax, ay, bx - ax AS dx, "by" - ay AS dy, ax + ("by" - ay)/d*least(o, lim) AS mx, ay + (ax - bx)/d*least(o, lim) AS my FROM l JOIN m USING (page_id, edge)),
j AS (SELECT s.page_id, s.edge, s.ax, s.ay, b.mx AS px, b.my AS py, b.dx AS qx, b.dy AS qy, b.dx*s.dy - b.dy*s.dx AS det, (s.mx - b.mx)*s.dy - (s.my - b.my)*s.dx AS num FROM s JOIN s b ON b.page_id = s.page_id AND b.edge = (s.edge + 3) % 4),
t AS (SELECT page_id, edge, CASE WHEN abs(det) > 1e-9 THEN px + qx*(num/det) ELSE ax END AS x, CASE WHEN abs(det) > 1e-9 THEN py + qy*(num/det) ELSE ay END AS y FROM j),
w AS (SELECT page_id, {", ".join(f"max({n}) FILTER (edge = {k}) AS {n}{k}" for k in range(4) for n in "xy")} FROM t GROUP BY page_id), e2 AS ({edges("w")}),
o AS (SELECT e2.page_id, edge, abs(("by" - ay)*px - (bx - ax)*py + bx*ay - "by"*ax)/greatest(sqrt((ax - bx)*(ax - bx) + (ay - "by")*(ay - "by")), 1e0) AS off FROM e2 JOIN {{outline}} USING (page_id)),
h AS (SELECT *, greatest(quantile_cont(off, 0.75) OVER (PARTITION BY page_id, edge), 1e0) AS scale FROM o), f AS (SELECT page_id, edge, count(*) FILTER (off <= scale*0.45e0)/count(*)::DOUBLE AS share FROM h GROUP BY page_id, edge), v AS (SELECT page_id, avg(share) AS consistency FROM f GROUP BY page_id)
SELECT page_id, {", ".join(f"{R(c)} AS {c}" for c in CORNERS)}, {R("consistency")} AS consistency FROM w JOIN v USING (page_id)"""),
    "narrow_connections": oracle(f"""WITH c AS (SELECT vec_id AS page_id, x, floor(abs(mean - 100e0)) AS f, 28 + vec_id % 9 AS centre, side FROM {{profile}} JOIN {{sheets}} ON page_id = vec_id),
w AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x) AS nth, count(*) OVER (PARTITION BY page_id) AS n FROM c WHERE side = 'left' AND x >= centre AND x < 63 OR side = 'right' AND x <= centre AND x > 0),
k AS (SELECT page_id, quantile_cont(f, 0.75) AS hi, quantile_cont(f, 0.1) AS lo FROM w WHERE n >= 8 AND nth > greatest(1, floor(n*0.12e0 + 0.5e0)) AND nth <= n - greatest(1, floor(n*0.12e0 + 0.5e0)) GROUP BY page_id HAVING count(*) >= 4)
SELECT page_id, {R("coalesce(least(1e0, greatest(0e0, 1e0 - lo/greatest(hi, 1e0))), 0e0)")} AS penalty FROM (SELECT DISTINCT page_id FROM c) LEFT JOIN k USING (page_id)"""),
    "native_spine_places": oracle(f"""WITH c AS (SELECT vec_id AS page_id, x*3 + 16 AS x, mean FROM {{profile}} WHERE x*3 + 16 <= 184), d AS (SELECT page_id, arg_min(x, mean*1e6 + x/1e3) AS dx, min(mean) AS dm FROM c GROUP BY page_id),
s AS (SELECT d.page_id, dx, least(1e0, greatest(0e0, ((a.mean + b.mean)/2e0 - dm)/70e0)) AS shadow FROM d JOIN c a ON a.page_id = d.page_id AND a.x = greatest(dx - 9, 16) JOIN c b ON b.page_id = d.page_id AND b.x = least(dx + 9, 184)),
l AS (SELECT page_id, o, ((page_id*7 + o*31) % 160 + 10e0) AS ax, ((page_id*7 + o*31) % 160 + o*20 + 10e0) AS bx, 20e0 + (page_id*13 + o*57) % 270 - 5e0 AS dy FROM {{sheets}}, range(4) r(o) WHERE page_id % 4 <> 0),
u AS (SELECT page_id, o, (ax + bx)/2e0 AS x, least(1e0, dy/300e0*(least(1e0, greatest(0e0, 1e0 - abs((ax + bx)/2e0 - 100e0)/100e0))*0.45e0 + 0.55e0)) AS st FROM l WHERE dy >= 84 AND dy >= abs(bx - ax)*2.2e0 AND (ax + bx)/2e0 BETWEEN 16 AND 184),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY st DESC, o) = 1), j AS (SELECT s.*, b.x, b.st, greatest(shadow, coalesce(st, 0e0)) AS strength FROM s LEFT JOIN b USING (page_id))
SELECT page_id, {R("CASE WHEN st IS NULL THEN dx WHEN shadow >= 0.22e0 AND abs(x - dx) < 20e0 THEN x*0.55e0 + dx*0.45e0 WHEN st > shadow THEN x ELSE dx END")} AS x, {R("strength")} AS strength FROM j WHERE strength >= 0.28e0"""),
    "curve_fusion": oracle(f"""WITH {CENTRAL}, t AS (SELECT page_id, max(mag) FILTER (curve = 0) AS a, max(mag) FILTER (curve = 1) AS b, max(dir) FILTER (curve = 0) AS sa, max(dir) FILTER (curve = 1) AS sb, quantile_cont(mag, 0.5) FILTER (curve > 1) AS i, count(*) FILTER (curve > 1 AND mag >= 0.0015e0) AS ni,
  count(*) FILTER (curve < 2 AND mag >= 0.00105e0 AND dir = 1) AS gp, count(*) FILTER (curve < 2 AND mag >= 0.00105e0 AND dir = -1) AS gn, count(*) FILTER (curve > 1 AND mag >= 0.00105e0 AND dir = 1) AS ip, count(*) FILTER (curve > 1 AND mag >= 0.00105e0 AND dir = -1) AS im, first(dir ORDER BY mag DESC, curve) FILTER (curve > 1) AS si FROM c GROUP BY page_id),
q AS (SELECT *, greatest(a, b) AS con, (a >= 0.0015e0)::INT + (b >= 0.0015e0)::INT AS ng, CASE WHEN gp + gn + ip + im > 0 THEN greatest(gp + ip, gn + im)/(gp + gn + ip + im)::DOUBLE ELSE 0e0 END AS cs,
  gp > 0 AND gn > 0 AND greatest(gp, gn) < 0.67e0*(gp + gn) OR ip > 0 AND im > 0 AND greatest(ip, im) < 0.67e0*(ip + im) OR gp + gn >= 2 AND ip + im >= 2 AND gp <> gn AND ip <> im AND (gp > gn) <> (ip > im) AND greatest(gp, gn) >= 0.67e0*(gp + gn) AND greatest(ip, im) >= 0.67e0*(ip + im) AS bad,
  coalesce(CASE WHEN a >= b THEN sa ELSE sb END = si, false) AS ag FROM t)
SELECT page_id, {R("a")} AS top, {R("b")} AS bottom, {R("i")} AS internal, {R("con")} AS contour, {R("cs")} AS consistency, ng AS n_geometry, ni AS n_internal, ag AS agree, bad AS conflict, con >= 0.0015e0 AND NOT bad AND cs >= 0.67e0 AND (ng >= 2 OR ng >= 1 AND ni >= 1 AND ag) AS mild FROM q"""),
    "clamped_contours": oracle(f"""WITH l AS (SELECT page_id, curve, list(abs(off) ORDER BY abs(off)) AS s FROM {{curves}} WHERE x BETWEEN 2 AND 13 GROUP BY page_id, curve), m AS (SELECT page_id, curve, least(6e0, s[floor((len(s) - 1)*0.9e0 + 0.5e0)::BIGINT + 1]) AS lim FROM l)
SELECT page_id, curve, x, {R("least(greatest(off, -lim), lim)*least(1e0, least(x, 15 - x)/2e0)")} AS off FROM {{curves}} JOIN m USING (page_id, curve)"""),
    "outline_boundaries": oracle(f"""WITH RECURSIVE e AS ({edges("{sheets}")}),
p AS (SELECT e.*, pos, px, py, least(1e0, greatest(0e0, ((px - ax)*(bx - ax) + (py - ay)*("by" - ay))/((bx - ax)*(bx - ax) + ("by" - ay)*("by" - ay)))) AS t, sqrt((bx - ax)*(bx - ax) + ("by" - ay)*("by" - ay)) AS len FROM e JOIN {{outline}} USING (page_id)),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY page_id, pos ORDER BY sqrt((px - (ax + (bx - ax)*t))*(px - (ax + (bx - ax)*t)) + (py - (ay + ("by" - ay)*t))*(py - (ay + ("by" - ay)*t)))/greatest(1e0, len), edge) = 1),
k AS (SELECT page_id, edge, count(*) AS n FROM n GROUP BY page_id, edge), g AS (SELECT page_id FROM k GROUP BY page_id HAVING min(n) >= 2 AND count(*) = 4 AND sum(n) >= 12),
a AS (SELECT page_id, edge, 1 + row_number() OVER (PARTITION BY page_id, edge ORDER BY t, pos) AS i, px AS x, py AS y FROM n UNION ALL SELECT page_id, edge, 1, ax, ay FROM e UNION ALL SELECT e.page_id, e.edge, n + 2, bx, "by" FROM e JOIN k ON k.page_id = e.page_id AND k.edge = e.edge),
f AS (SELECT page_id, edge, i, x, y, 1 AS n, x + y*2e0 AS total FROM a WHERE i = 1
  UNION ALL SELECT a.page_id, a.edge, a.i, CASE WHEN far THEN a.x ELSE f.x END, CASE WHEN far THEN a.y ELSE f.y END, n + far::INT, CASE WHEN far THEN total + a.x + a.y*2e0 ELSE total END
  FROM f JOIN a ON a.page_id = f.page_id AND a.edge = f.edge AND a.i = f.i + 1, LATERAL (SELECT sqrt((f.x - a.x)*(f.x - a.x) + (f.y - a.y)*(f.y - a.y)) > 0.5e0 AS far) z)
SELECT page_id, edge, arg_max(n, i) AS n, {R("arg_max(total, i)")} AS total FROM f JOIN g USING (page_id) GROUP BY page_id, edge"""),
    "lattice_signals": oracle(f"""WITH b AS (SELECT *, least(greatest(floor(least(x0, x1, x2, x3) + 0.5e0), 0), 999)::INT AS xl, least(greatest(floor(greatest(x0, x1, x2, x3) + 0.5e0), 0), 999)::INT AS xh, least(greatest(floor(least(y0, y1, y2, y3) + 0.5e0), 0), 1399)::INT AS yl, least(greatest(floor(greatest(y0, y1, y2, y3) + 0.5e0), 0), 1399)::INT AS yh FROM {{sheets}}),
c AS (SELECT b.*, xl + (xh - xl)*j // 20 AS x, yl + (yh - yl)*i // 20 AS y FROM b, range(1, 20) r(i), range(1, 20) s(j)),
k AS (SELECT page_id, x, y FROM c WHERE ({" + ".join(f"CASE WHEN (y{k} > y) <> (y{(k + 3) % 4} > y) THEN (x < (x{(k + 3) % 4} - x{k})*(y - y{k})/(y{(k + 3) % 4} - y{k}) + x{k})::INT ELSE 0 END" for k in range(4))}) % 2 = 1),
v AS (SELECT page_id, ((x*7 + y*13 + page_id) % 256)::DOUBLE AS b, (x + y) % 11 = 0 AS e FROM k)
SELECT page_id, {R("least(1e0, count(*) FILTER (e)/count(*)::DOUBLE*9e0)")} AS "text", {R("least(1e0, greatest(0e0, 1e0 - stddev_pop(b)/90e0))")} AS even, {R("avg(b)")} AS mean, {R("count(*) FILTER (b >= 150)/count(*)::DOUBLE")} AS bright FROM v GROUP BY page_id"""),
    "text_curve_ranks": oracle("""SELECT page_id % 500 AS page_id, page_id*10 + ord AS ord, row_number() OVER (PARTITION BY page_id % 500 ORDER BY x1 - x0 DESC, page_id*10 + ord) AS rank, rank <= 8 AS used FROM {placed_quads}
WHERE x1 - x0 >= 133.2e0 AND (jy + 40e0)*2e0 <= 96 AND x0 < 800 AND x1 > 60 AND y0 >= 30 AND y0 + (jy + 40e0)*2e0 <= 1230 QUALIFY rank <= 24"""),
    "mask_probabilities": oracle(f"""SELECT vec_id AS page_id, {R("coalesce(avg(mean/256e0) FILTER (x % 3 > 0 AND vec_id % 10 > 0), 0e0)")} AS probability FROM {{profile}} GROUP BY vec_id"""),
}
