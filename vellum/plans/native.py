"""Queries over the device's own features and scores, and over the outlines of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import native as N
from vellum.functions import stats as S
from vellum.functions.geometry import Quad
from vellum.functions.numbers import clamp
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.plans.boundaries import UNIT, measures, unit
from vellum.sources.tables import oracle, view


def quads(spark, d):
    return view(spark, d, "quads")


def native_features(spark, d):
    u, q, single = unit(), Quad.of(), F.col("side") == "single"
    return view(spark, d, "placed_quads").select(
        "page_id", "ord", r6(N.occupancy(u.area, single)).alias("occupancy"), r6(N.small_penalty(u.area, single)).alias("small"), r6(N.border_proximity(u, F.col("side"))).alias("border"),
        r6(N.overlap_penalty(u, F.col("side"))).alias("overlap"), r6(N.right_angles(q)).alias("angles"), r6(N.edge_distance(q, 1000.0, 1400.0)).alias("edge_distance"),
        r6(N.guide_alignment(q, 1000.0, 1400.0)).alias("guide"),
    )


def native_penalties(spark, d):
    e = view(spark, d, "placed_evidence")
    return e.select(
        "page_id", "ord", r6(N.internal_line(F.col("support"), F.col("border"), F.col("occlusion"), F.col("adjacent"))).alias("internal"), r6(N.repeated_line(F.col("evidence") + F.col("n_geometry"))).alias("repeated"),
        r6(N.continuation(F.col("internal"), F.col("contour"), F.col("coverage") * 255.0, F.col("consistency") * 255.0, F.col("evidence") * 15)).alias("continuation"),
        r6(N.paper_interior(F.col("coverage") * 255.0, F.col("support"), F.col("continuity"), F.col("transition"))).alias("paper"),
    )


def native_clipping(spark, d):
    q = Quad.of().mapped(lambda x, y: F.when(x < 60, 0.0).when(x > 880, 999.0).otherwise(x), lambda x, y: F.when(y < 30, 0.0).otherwise(y))
    return view(spark, d, "placed_quads").select("page_id", "ord", N.clipping_evidence(q, 1000.0, 1400.0).alias("clipping"))


def native_spines(spark, d):
    q, spine = Quad.of(), F.lit(500.0) + F.col("jx") * 20.0
    return view(spark, d, "placed_quads").select(
        "page_id", "ord", r6(N.spine_proximity(q, spine, F.col("confidence"), 1000.0)).alias("proximity"), N.spine_side(q, spine).alias("spine_side"),
        r6(N.two_pages(F.col("confidence"), F.col("clipping"), F.col("clipping"), F.lit(0.5))).alias("two_pages"), r6(N.page_side(q, F.col("side"), (F.col("ord") % 4).cast("double"), 1000.0)).alias("side_score"),
    )


def paper_regions(spark, d):
    c = view(spark, d, "placed_candidates").withColumns({"center": F.col("spine_proximity"), "side_score": F.col("outer_anchor")})
    return c.select("page_id", "ord", r6(N.paper_region_score()).alias("score"), r6(N.paper_region_confidence()).alias("confidence"))


def native_base_scores(spark, d):
    c = view(spark, d, "placed_candidates").select(
        "page_id", "ord", "area_ratio", "rect", "edge", "contrast", F.col("border").alias("angle"), F.col("paper").alias("aspect"), F.col("outer_anchor").alias("guide"), F.col("two_page").alias("lines"),
        F.col("spine_proximity").alias("spine"), F.col("text_density").alias("text"), F.col("occupancy").alias("even"), F.col("curvature").alias("curve"),
    )
    document, book = N.base_scores()
    kind = F.when((F.col("spine") >= 0.55) | (F.col("curve") >= 0.28), "bookPage").otherwise("document")
    return c.select("page_id", "ord", r6(document).alias("document"), r6(book).alias("book"), kind.alias("kind"))


def components_with_guide(spark, d):
    c = view(spark, d, "candidates")
    aspect = F.greatest(F.col("aspect_ratio"), F.lit(1.0) / F.col("aspect_ratio"))
    return c.select("page_id", "ord", r6(N.component_with_guide(F.col("area_ratio"), F.col("paper"), aspect, F.col("border"))).alias("score"))


def second_papers(spark, d):
    """The penalty for a second sheet: the largest component beside the one nearest to the mask's center."""
    away = F.sqrt((F.col("border") - 0.5) * (F.col("border") - 0.5) + (F.col("paper") - 0.5) * (F.col("paper") - 0.5))
    c = view(spark, d, "placed_candidates").filter("area_ratio >= 0.2").withColumn("away", away)
    main = c.groupBy("page_id").agg(F.min_by(F.struct("ord", "area_ratio", "border"), F.struct("away", "ord")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    rest = c.join(main, "page_id").filter(F.col("ord") != F.col("m.ord"))
    second = rest.groupBy("page_id").agg(F.max_by(F.struct("area_ratio", "border"), F.struct(F.col("area_ratio"), -F.col("ord"))).alias("s"), F.first("m").alias("m"))
    ratio, apart = clamp(F.col("s.area_ratio") / F.col("m.area_ratio")), F.abs(F.col("s.border") - F.col("m.border"))
    return second.select("page_id", r6(F.when(apart > 0.18, clamp(ratio * 0.72 + clamp(apart) * 0.28)).otherwise(ratio * 0.25)).alias("penalty"))


def shifted_corners(spark, d):
    """Corners after each edge moved outward by its own distance."""
    q, out = Quad.of(), [F.abs("jx"), F.abs("jy"), F.abs("jx") / 2.0, F.abs("jy") / 3.0]
    return quads(spark, d).select("page_id", "ord", *[r6(v).alias(f"{n}{k}") for k in range(4) for n, v in zip(("x", "y"), N.moved_corner(q, k, out), strict=True)])


def contour_metrics(spark, d):
    """How far and to which side the samples of an outline leave the chord between its ends."""
    s = view(spark, d, "signal").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    n = F.size("p")
    central = F.filter(F.transform("p", lambda x, i: F.struct((i / F.greatest(n - 1, F.lit(1))).alias("t"), ((x["value"] - 20.0) / 1000.0).alias("v"))), lambda x: (x["t"] >= 0.10) & (x["t"] <= 0.90))
    s = s.filter(n >= 6).select("series_id", F.transform(central, lambda x: x["v"]).alias("v"))
    s = s.withColumn("size", S.nearest_rank(F.array_sort(F.transform("v", lambda v: F.abs(v))), 0.90))
    strong = F.filter("v", lambda v: F.abs(v) >= F.col("size") * 0.25)
    plus, minus = F.size(F.filter(strong, lambda v: v > 0)), F.size(F.filter(strong, lambda v: v < 0))
    return s.select("series_id", r6("size").alias("magnitude"), F.signum((plus - minus).cast("double")).cast("int").alias("direction"), r6(S.consistency(plus, minus)).alias("consistency"))


def nearest_pairs(spark, d):
    """The middle of the two points of neighbouring edges that lie nearest to each other; of equal pairs the first."""
    q = view(spark, d, "placed_quads")

    def points(k, shift):
        return F.array(*[F.struct((F.col(f"x{k}") + F.col("jx") * i * shift).alias("x"), (F.col(f"y{k}") + F.col("jy") * (i + 1)).alias("y"), F.lit(i).alias("i")) for i in range(3)])

    def away(p, r):
        return (p["x"] - r["x"]) * (p["x"] - r["x"]) + (p["y"] - r["y"]) * (p["y"] - r["y"])

    def pairs(r):
        return lambda p: F.struct(away(p, r).alias("d"), p["i"].alias("i"), r["i"].alias("j"), ((p["x"] + r["x"]) / 2.0).alias("x"), ((p["y"] + r["y"]) / 2.0).alias("y"))

    q = q.select("page_id", "ord", points(0, 1.0).alias("one"), points(3, -2.0).alias("two"))
    best = F.array_min(F.flatten(F.transform("two", lambda r: F.transform("one", pairs(r)))))
    return q.select("page_id", "ord", best["i"].alias("i"), best["j"].alias("j"), r6(best["x"]).alias("x"), r6(best["y"]).alias("y"))


def resampled_edges(spark, d):
    """Five points at equal distances along the way over four corners."""
    q = Quad.of()
    lengths = [N.distance(*q.point(k), *q.point(k + 1)) for k in range(3)]
    at = [F.lit(0.0), lengths[0], lengths[0] + lengths[1], lengths[0] + lengths[1] + lengths[2]]
    out = []
    for i in range(5):
        target = at[3] * (i / 4)
        for n, values in (("x", q.xs), ("y", q.ys)):
            pieces = [values[k] + (values[k + 1] - values[k]) * ((target - at[k]) / (at[k + 1] - at[k])) for k in range(3)]
            out.append(r6(F.when(at[1] >= target, pieces[0]).when(at[2] >= target, pieces[1]).otherwise(pieces[2])).alias(f"{n}{i}"))
    return quads(spark, d).select("page_id", "ord", *out)


def contracts(spark, d):
    """Shapes that a model's tensors may have."""
    e = view(spark, d, "evidence").select("page_id", "ord", F.array(F.lit(1), (F.col("evidence") * 64 + 256).cast("int"), F.lit(256), (F.col("n_geometry") + 1).cast("int")).alias("shape"), F.col("agree"))
    ok = (F.size("shape") == 4) & (F.get("shape", F.lit(0)) == 1) & (F.get("shape", F.lit(3)) == 3) & F.col("agree") & F.forall("shape", lambda x: x > 0)
    return e.select("page_id", "ord", ok.alias("valid"))


def c01(x):
    return f"least(1e0, greatest(0e0, {x}))"


def spread_border(outer, spine):
    return f"{c01(f'1e0 - ({outer})/0.26e0')}*0.36e0 + top*0.27e0 + bottom*0.27e0 + {c01(f'1e0 - ({spine})/0.4e0')}*0.1e0"


def angle_sql():
    terms = []
    for k in range(4):
        p, n = (k + 3) % 4, (k + 1) % 4
        ax, ay, bx, by = f"(x{p} - x{k})", f"(y{p} - y{k})", f"(x{n} - x{k})", f"(y{n} - y{k})"
        size = f"(sqrt({ax}*{ax} + {ay}*{ay})*sqrt({bx}*{bx} + {by}*{by}))"
        terms.append(f"CASE WHEN {size} > 0 THEN abs(({ax}*{bx} + {ay}*{by})/{size}) ELSE 0e0 END")
    return c01(f"1e0 - ({' + '.join(terms)})/4e0")


def corner_sql(k):
    out = ["abs(jx)", "abs(jy)", "abs(jx)/2e0", "abs(jy)/3e0"]

    def line(i):
        i, n = i % 4, (i + 1) % 4
        length = f"sqrt((x{i} - x{n})*(x{i} - x{n}) + (y{i} - y{n})*(y{i} - y{n}))"
        return f"(x{i} + (y{n} - y{i})/{length}*{out[i]})", f"(y{i} + (x{i} - x{n})/{length}*{out[i]})", f"(x{n} - x{i})", f"(y{n} - y{i})"

    (px, py, dx, dy), (qx, qy, ex, ey) = line(k + 3), line(k)
    det = f"({dx}*{ey} - {dy}*{ex})"
    t = f"(CASE WHEN abs({det}) > 1e-9 THEN (({qx} - {px})*{ey} - ({qy} - {py})*{ex})/{det} END)"
    return f"{R(f'coalesce({px} + {dx}*{t}, x{k})')} AS x{k}, {R(f'coalesce({py} + {dy}*{t}, y{k})')} AS y{k}"


def resample_sql(n, i):
    target = f"(c3*{i / 4}e0)"
    pieces = [f"{n}{k} + ({n}{k + 1} - {n}{k})*(({target} - c{k})/(c{k + 1} - c{k}))" for k in range(3)]
    return f"{R(f'CASE WHEN c1 >= {target} THEN {pieces[0]} WHEN c2 >= {target} THEN {pieces[1]} ELSE {pieces[2]} END')} AS {n}{i}"


LEN = [f"sqrt((x{k} - x{k + 1})*(x{k} - x{k + 1}) + (y{k} - y{k + 1})*(y{k} - y{k + 1}))" for k in range(3)]
QUERIES = {
    f.__name__: f
    for f in (
        native_features, native_penalties, native_clipping, native_spines, paper_regions, native_base_scores, components_with_guide, second_papers, shifted_corners, contour_metrics, nearest_pairs,
        resampled_edges, contracts,
    )
}
ORACLE = {
    "native_features": oracle(f"""WITH {UNIT}, m AS (SELECT *, {measures('u')} FROM u), b AS (SELECT *, {c01('1e0 - u_t/0.3e0')} AS top, {c01('1e0 - (1e0 - u_b)/0.3e0')} AS bottom FROM m)
SELECT page_id, ord, {R(f"CASE WHEN side = 'single' THEN {c01('(u_a - 0.14e0)/(0.72e0 - 0.14e0)')} ELSE {c01('(u_a - 0.24e0)/(0.68e0 - 0.24e0)')} END")} AS occupancy,
  {R(f"CASE WHEN side = 'single' THEN {c01('(0.42e0 - u_a)/0.42e0')} ELSE {c01('(0.48e0 - u_a)/0.48e0')} END")} AS small,
  {R(f"CASE side WHEN 'single' THEN ({c01('1e0 - u_l/0.3e0')} + {c01('1e0 - (1e0 - u_r)/0.3e0')} + top + bottom)/4e0 WHEN 'left' THEN {spread_border('u_l', '1e0 - u_r')} ELSE {spread_border('1e0 - u_r', 'u_l')} END")} AS border,
  {R(f"CASE side WHEN 'left' THEN {c01('((ux1 + ux2)/2e0 - 0.94e0)/0.06e0')} WHEN 'right' THEN {c01('(1e0 - (ux0 + ux3)/2e0 - 0.94e0)/0.06e0')} ELSE 0e0 END")} AS overlap, {R(angle_sql())} AS angles,
  {R('1e0 - (' + ' + '.join(f'(x{k} <= 15 OR y{k} <= 15 OR x{k} >= 985 OR y{k} >= 1385)::INTEGER' for k in range(4)) + ')/4e0')} AS edge_distance,
  {R(c01('1e0 - sqrt((abs((x0 + x1 + x2 + x3)/4e0 - 500e0)/500e0)*(abs((x0 + x1 + x2 + x3)/4e0 - 500e0)/500e0) + (abs((y0 + y1 + y2 + y3)/4e0 - 700e0)/700e0)*(abs((y0 + y1 + y2 + y3)/4e0 - 700e0)/700e0))/sqrt(2e0)'))} AS guide FROM b"""),
    "native_penalties": oracle(f"""SELECT page_id, ord, {R(c01('(1e0 - support)*(1e0 - border)*0.42e0 + occlusion*0.28e0 + adjacent*0.3e0'))} AS internal,
  CASE WHEN evidence + n_geometry >= 5 THEN 0.92e0 WHEN evidence + n_geometry >= 3 THEN 0.74e0 WHEN evidence + n_geometry >= 2 THEN 0.52e0 ELSE 0e0 END AS repeated,
  {R('CASE WHEN evidence*15 < 20 THEN 0e0 ELSE ' + c01(f"least({c01('contour/greatest(internal, 0.012e0)')}, {c01('contour*12e0')})*0.78e0 + {c01('1e0 - abs(coverage*255e0 - consistency*255e0)/55e0')}*0.22e0") + ' END')} AS continuation,
  {R(c01(f"{c01('coverage*255e0/210e0')}*0.3e0 + support*0.32e0 + continuity*0.2e0 + {c01('transition/0.55e0')}*0.18e0"))} AS paper FROM {{placed_evidence}}"""),
    "native_clipping": oracle("""WITH p AS (SELECT page_id, ord, unnest([x0, x1, x2, x3]) AS x, unnest([y0, y1, y2, y3]) AS y FROM {placed_quads}),
q AS (SELECT page_id, ord, CASE WHEN x < 60 THEN 0e0 WHEN x > 880 THEN 999e0 ELSE x END AS x, CASE WHEN y < 30 THEN 0e0 ELSE y END AS y FROM p),
c AS (SELECT page_id, ord, count(*) FILTER (x <= 6) >= 2 AND max(y) FILTER (x <= 6) - min(y) FILTER (x <= 6) >= 84 AS l, count(*) FILTER (x >= 993) >= 2 AND max(y) FILTER (x >= 993) - min(y) FILTER (x >= 993) >= 84 AS r,
  count(*) FILTER (y <= 6) >= 2 AND max(x) FILTER (y <= 6) - min(x) FILTER (y <= 6) >= 60 AS t, count(*) FILTER (y >= 1393) >= 2 AND max(x) FILTER (y >= 1393) - min(x) FILTER (y >= 1393) >= 60 AS b FROM q GROUP BY page_id, ord)
SELECT page_id, ord, least(1e0, (coalesce(l, false)::INTEGER + coalesce(r, false)::INTEGER + coalesce(t, false)::INTEGER + coalesce(b, false)::INTEGER)/2e0) AS clipping FROM c"""),
    "native_spines": oracle(f"""WITH s AS (SELECT *, 500e0 + jx*20e0 AS spine, (x0 + x3)/2e0 AS l, (x1 + x2)/2e0 AS r FROM {{placed_quads}})
SELECT page_id, ord, {R(c01('1e0 - least(abs(l - spine), abs(r - spine))/280.00000000000006e0') + '*confidence')} AS proximity, CASE WHEN abs(l - spine) <= abs(r - spine) THEN 'left' ELSE 'right' END AS spine_side,
  {R('least(confidence, clipping)*0.72e0 + least(clipping, 0.5e0)*0.28e0')} AS two_pages,
  {R(f"CASE side WHEN 'single' THEN 0e0 WHEN 'left' THEN {c01('1e0 - l/620e0')}*0.72e0 + {c01('(ord % 4)/2e0')}*0.28e0 ELSE {c01('1e0 - (1000e0 - r)/620e0')}*0.72e0 + {c01('(ord % 4)/2e0')}*0.28e0 END")} AS side_score FROM s"""),
    "paper_regions": oracle(f"""SELECT page_id, ord, {R('occupancy*0.26e0 + paper*0.22e0 + contrast*0.14e0 + rect*0.1e0 + spine_proximity*0.09e0 + border*0.09e0 + envelope*0.06e0 + outer_anchor*0.04e0')} AS score,
  {R(c01('paper*0.29e0 + contrast*0.21e0 + occupancy*0.2e0 + rect*0.12e0 + spine_proximity*0.1e0 + envelope*0.08e0'))} AS confidence FROM {{placed_candidates}}"""),
    "native_base_scores": oracle(f"""SELECT page_id, ord, {R('least(area_ratio, 1e0)*0.32e0 + (border*0.24e0 + rect*0.1e0 + edge*0.1e0 + paper*0.08e0 + outer_anchor*0.06e0 + two_page*0.04e0 + contrast*0.06e0)')} AS document,
  {R('least(area_ratio, 0.65e0)/0.65e0*0.18e0 + (border*0.08e0 + outer_anchor*0.1e0 + spine_proximity*0.16e0 + text_density*0.15e0 + occupancy*0.09e0 + curvature*0.12e0 + contrast*0.07e0 + two_page*0.05e0)')} AS book,
  CASE WHEN spine_proximity >= 0.55e0 OR curvature >= 0.28e0 THEN 'bookPage' ELSE 'document' END AS kind FROM {{placed_candidates}}"""),
    "components_with_guide": oracle(f"SELECT page_id, ord, {R('area_ratio*0.64e0 + paper*0.18e0 + ' + c01('1e0 - (greatest(aspect_ratio, 1e0/aspect_ratio) - 1e0)/7e0') + '*0.08e0 + border*0.1e0')} AS score FROM {{candidates}}"),
    "second_papers": oracle(f"""WITH c AS (SELECT *, sqrt((border - 0.5e0)*(border - 0.5e0) + (paper - 0.5e0)*(paper - 0.5e0)) AS away, count(*) OVER (PARTITION BY page_id) AS n FROM {{placed_candidates}} WHERE area_ratio >= 0.2e0),
m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY away, ord) AS i FROM c WHERE n >= 2), s AS (SELECT * FROM m WHERE i > 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area_ratio DESC, ord) = 1),
j AS (SELECT s.page_id, {c01('s.area_ratio/m.area_ratio')} AS ratio, abs(s.border - m.border) AS apart FROM s JOIN m ON m.page_id = s.page_id AND m.i = 1)
SELECT page_id, {R(f"CASE WHEN apart > 0.18e0 THEN {c01('ratio*0.72e0 + least(1e0, apart)*0.28e0')} ELSE ratio*0.25e0 END")} AS penalty FROM j"""),
    "shifted_corners": oracle("SELECT page_id, ord, " + ", ".join(corner_sql(k) for k in range(4)) + " FROM {quads}"),
    "contour_metrics": oracle(f"""WITH n AS (SELECT series_id, (pos - 1)/greatest(count(*) OVER (PARTITION BY series_id) - 1, 1)::DOUBLE AS t, (value - 20e0)/1000e0 AS v, count(*) OVER (PARTITION BY series_id) AS n FROM {{signal}}),
c AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(v)) AS r, count(*) OVER (PARTITION BY series_id) AS k FROM n WHERE n >= 6 AND t BETWEEN 0.1e0 AND 0.9e0),
s AS (SELECT *, max(abs(v)) FILTER (r = floor((k - 1)*0.9e0 + 0.5e0) + 1) OVER (PARTITION BY series_id) AS size FROM c),
g AS (SELECT series_id, any_value(size) AS size, count(*) FILTER (abs(v) >= size*0.25e0 AND v > 0) AS p, count(*) FILTER (abs(v) >= size*0.25e0 AND v < 0) AS m FROM s GROUP BY series_id)
SELECT series_id, {R('size')} AS magnitude, sign(p - m)::INTEGER AS direction, {R('CASE WHEN p + m > 0 THEN greatest(p, m)/(p + m)::DOUBLE ELSE 0e0 END')} AS consistency FROM g"""),
    "nearest_pairs": oracle(f"""WITH a AS (SELECT page_id, ord, i, j, x0 + jx*i*1e0 AS ax, y0 + jy*(i + 1) AS ay, x3 + jx*j*-2e0 AS bx, y3 + jy*(j + 1) AS by_ FROM {{placed_quads}}, range(3) p(i), range(3) r(j))
SELECT page_id, ord, i::INTEGER AS i, j::INTEGER AS j, {R('(ax + bx)/2e0')} AS x, {R('(ay + by_)/2e0')} AS y FROM a QUALIFY row_number() OVER (PARTITION BY page_id, ord ORDER BY (ax - bx)*(ax - bx) + (ay - by_)*(ay - by_), i, j) = 1"""),
    "resampled_edges": oracle(f"WITH c AS (SELECT *, 0e0 AS c0, {LEN[0]} AS c1, {LEN[0]} + {LEN[1]} AS c2, {LEN[0]} + {LEN[1]} + {LEN[2]} AS c3 FROM {{quads}}) SELECT page_id, ord, " + ", ".join(resample_sql(n, i) for i in range(5) for n in ("x", "y")) + " FROM c"),
    "contracts": oracle("SELECT page_id, ord, n_geometry + 1 = 3 AND agree AS valid FROM {evidence}"),
}
