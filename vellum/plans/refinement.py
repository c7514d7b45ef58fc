"""Queries over evidence for the edges of a page: visibility, refinement, curvature, spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions.numbers import clamp
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.sources.tables import oracle, view


def evidence(spark, d):
    return view(spark, d, "evidence")


def edge_visibility(spark, d):
    e = view(spark, d, "placed_evidence").withColumn("visibility", P.edge_visibility())
    return e.select("page_id", "ord", "edge", "visibility", P.outward_margin(F.col("edge"), F.col("visibility")).alias("margin"))


def edge_visibility_counts(spark, d):
    """A page's edges by visibility, one column a class."""
    e = evidence(spark, d).select("page_id", P.edge_visibility().alias("v"))
    return e.groupBy("page_id").agg(*[F.count_if(F.col("v") == v).alias(v) for v in ("confirmed", "weak", "occluded", "outOfFrame", "unknown")])


def paper_candidates(spark, d):
    return view(spark, d, "placed_evidence").select("page_id", "ord", r6(P.paper_candidate_score(F.col("agree"))).alias("score"))


def refinement_verdicts(spark, d):
    e = view(spark, d, "placed_evidence").withColumn("verdict", P.refinement_verdict()).withColumn("c", P.refined_confidence(F.col("convex")))
    status = P.refinement_status(F.col("verdict"), F.col("c"), F.col("agree"))
    return e.select("page_id", "ord", "verdict", r6("c").alias("confidence"), status.alias("status"))


def edge_expansion(spark, d):
    applied, held, reliable = P.edge_expansion()
    return view(spark, d, "placed_evidence").select("page_id", "ord", r6(applied).alias("applied"), held.alias("conservative"), reliable.alias("reliable"))


def page_ownership(spark, d):
    e = view(spark, d, "placed_evidence")
    return e.select(
        "page_id", "ord", r6(P.ownership(F.col("containment"), F.col("support"), F.col("continuity"))).alias("ownership"),
        r6(P.adjacent_penalty(F.col("expansion"), F.col("border"), F.col("occlusion"))).alias("adjacent"),
    )


def partial_masks(spark, d):
    part = P.is_partial_raw(F.col("border"), F.col("transition") + 0.2, F.col("support"), F.col("agree"), F.col("ownership"), F.col("reliable"), F.col("side"))
    return view(spark, d, "placed_evidence").select("page_id", "ord", part.alias("partial"))


def bottom_recovery(spark, d):
    """The bottom edge's outward move, and whether a side of a spread has the edges that it needs."""
    e = evidence(spark, d)
    move = F.greatest(F.col("border"), F.when(F.col("occlusion") <= 0.48, F.col("support")).otherwise(F.coalesce("paper_score", "border")))
    outer = F.col("edge") == F.when(F.col("side") == "left", "left").otherwise("right")
    flat = F.col("edge").isin("top", "bottom")
    pages = e.groupBy("page_id").agg(
        F.max(F.when((F.col("edge") == "bottom"), move)).alias("m"),
        (F.count_if(outer & F.col("reliable") & F.col("side").isNotNull()) > 0).alias("outer"),
        (F.count_if(flat & F.col("reliable")) > 0).alias("flat"),
    )
    return pages.select("page_id", r6("m").alias("bottom"), (F.col("outer") & F.col("flat")).alias("supported"))


def curvature_classes(spark, d):
    e = view(spark, d, "placed_evidence").withColumn("direction", F.col("support")).withColumn("state", P.curvature_class())
    size = P.deformation(F.col("state"))
    return e.select("page_id", "ord", "state", r6(size * 1000.0).alias("deformation"), (size > 0.025).alias("excessive"))


def curve_adoption(spark, d):
    e = view(spark, d, "placed_evidence").withColumn("direction", F.col("support")).withColumn("state", P.curvature_class())
    return e.select("page_id", "ord", (F.col("state").isin("mildCurve", "strongCurve") & P.adopts_curve(F.col("state")) & P.keeps_canvas()).alias("adopted"))


def curved_confidence(spark, d):
    c = F.col("coverage") * 0.45 + F.col("support") * 0.30 + F.col("consistency") * 0.25
    return view(spark, d, "placed_evidence").select("page_id", "ord", r6(c).alias("confidence"), (c >= 0.68).alias("enough"))


def direction_conflicts(spark, d):
    """Whether the curve directions of a page's outline and of its lines contradict each other."""
    e = view(spark, d, "placed_evidence")
    way = F.col("reliable_edges") % 3 - 1
    sums = e.withColumn("g", F.col("ord") % 2 == 0).groupBy("page_id").agg(
        *[F.count_if((F.col("g") == g) & (F.sign(way) == s)).alias(f"{n}{t}") for g, n in ((True, "g"), (False, "i")) for s, t in ((1, "p"), (-1, "n"))]
    )

    def consistency(n):
        total = F.col(f"{n}p") + F.col(f"{n}n")
        return F.when(total > 0, F.greatest(f"{n}p", f"{n}n") / total).otherwise(0.0)

    def within(n):
        return (F.col(f"{n}p") > 0) & (F.col(f"{n}n") > 0) & (consistency(n) < 0.67)

    def main(n):
        return F.signum(F.col(f"{n}p") - F.col(f"{n}n"))

    across = (F.col("gp") + F.col("gn") >= 2) & (F.col("ip") + F.col("in") >= 2) & (main("g") * main("i") < 0) & (consistency("g") >= 0.67) & (consistency("i") >= 0.67)
    return sums.select("page_id", (within("g") | within("i") | across).alias("conflict"))


def spread_classes(spark, d):
    e = view(spark, d, "placed_evidence").select(
        "page_id", "ord", (F.col("expansion") + 0.2).alias("aspect"), F.col("ownership").alias("left"), F.col("consistency").alias("right"), F.col("confidence").alias("structure"),
        F.col("support").alias("gutter"),
    )
    e = e.withColumn("balance", P.balance(F.col("left"), F.col("right"))).withColumn("c", P.spread_confidence())
    layout, reason = P.spread_class(F.col("c"))
    return e.select("page_id", "ord", r6("c").alias("confidence"), layout.alias("layout"), reason.alias("reason"))


def production_crop(spark, d):
    """Which crop is used: of the segmentation where it is trustworthy, else of the detector, else the guide."""
    e = view(spark, d, "placed_evidence")
    final = F.when(F.col("evidence") == 0, "rawFallback").when(F.col("evidence") < 3, "refined").otherwise("hybrid")
    trusted = F.col("has_corners") & (F.col("confidence") >= 0.45) & F.col("support").between(0.02, 0.995) & ((F.col("ownership") == 0) | (F.col("ownership") >= 0.66)) & (F.col("adjacent") < 0.66) & F.col("in_bounds")
    trusted = trusted & ((final != "rawFallback") | (F.col("confidence") >= 0.58))
    ran = ~F.col("partial_raw")
    found = F.when(F.col("coverage") >= 0.7, "openCv")
    source = F.when(ran & trusted, F.concat(F.lit("ai_"), final)).when(ran & found.isNotNull(), F.lit("openCvFallback")).when(found.isNotNull(), found).otherwise(F.lit("guide"))
    return e.select("page_id", "ord", source.alias("source"))


def guide_levels(spark, d):
    e = view(spark, d, "placed_evidence")
    return e.select("page_id", "ord", P.guide_level(F.col("has_corners"), F.col("in_bounds"), F.col("agree"), F.col("coverage")).alias("level"))


def quality_warnings(spark, d):
    """Results that lost sharpness or gained speckles."""
    e = view(spark, d, "placed_evidence")
    soft = F.col("straight_after") < F.col("straight_before") * 0.90
    speckled = (F.col("internal") > F.col("contour") * 1.75) & (F.col("internal") > F.col("contour") + 0.001)
    return e.filter(soft | speckled).select("page_id", "ord", soft.alias("soft"), speckled.alias("speckled"))


def conservative_corners(spark, d):
    """Which corners are taken when refinement is unsure."""
    e = view(spark, d, "placed_evidence")
    choice = F.when(F.col("reliable_edges") >= 2, "edges").when(F.col("paper_score") >= 0.56, "paper").when(F.col("expansion") >= 0.98, "area").otherwise("none")
    safe = F.when(F.col("convex") & (F.col("expansion").between(0.96, 1.70)), "refined").when(F.col("in_bounds"), "hybrid").when(F.col("has_corners"), "raw").otherwise("none")
    return e.select("page_id", "ord", choice.alias("choice"), safe.alias("polygon"))


def smooth_step(t):
    return t * t * (F.lit(3.0) - t * 2.0)


def tone_tables(spark, d):
    """Look-up tables of tone: paper is lifted from 120 on by a smooth step, foreground below 205 pulled down."""
    values = spark.range(256).select(F.col("id").cast("int").alias("v"))
    up, down = clamp((F.col("v") - 120.0) / 120.0), clamp((F.lit(205.0) - F.col("v")) / 205.0)
    paper = F.col("v") + (255.0 - F.col("v")) * 0.86 * smooth_step(up)
    fore = F.col("v") * (F.lit(1.0) - smooth_step(down) * 0.20)
    return values.select("v", F.floor(paper + 0.5).cast("int").alias("paper"), F.floor(fore + 0.5).cast("int").alias("foreground"))


VIS = """CASE WHEN occlusion >= 0.48e0 THEN 'occluded' WHEN border <= 0.025e0 AND transition < 0.3e0 THEN 'outOfFrame'
  WHEN reliable AND transition >= 0.3e0 AND support >= 0.46e0 THEN 'confirmed' WHEN transition >= 0.16e0 OR support >= 0.28e0 THEN 'weak' ELSE 'unknown' END"""


def c01(x: str) -> str:
    return f"least(1e0, greatest(0e0, {x}))"


PAPER = "coalesce(paper_score >= 0.56e0, false)"
VERDICT = f"""CASE WHEN partial_raw THEN 'partial_ai_raw' WHEN NOT has_corners THEN 'refined_corners_unavailable' WHEN NOT in_bounds THEN 'refined_corners_out_of_bounds'
  WHEN NOT convex THEN 'refined_boundary_not_convex' WHEN expansion < 0.96e0 THEN 'excessive_inward_refinement' WHEN expansion > 1.55e0 THEN 'excessive_refinement_expansion'
  WHEN containment < 0.94e0 THEN 'ai_foreground_clipped' WHEN ownership < 0.66e0 THEN 'main_page_ownership_lost' WHEN adjacent >= 0.66e0 THEN 'adjacent_page_merge'
  WHEN reliable_edges < 2 AND NOT {PAPER} THEN 'paper_transition_unreliable' WHEN transition < 0.18e0 AND NOT {PAPER} THEN 'paper_transition_weak' ELSE 'accepted' END"""
CONF = c01(
    f"{c01('containment')}*0.24e0 + {c01('1e0 - abs(expansion - 1.16e0)/0.55e0')}*0.13e0 + {c01('transition')}*0.14e0 + {c01('envelope')}*0.14e0 + {c01('continuity')}*0.13e0"
    f" + CASE WHEN convex THEN 0.12e0 ELSE 0e0 END - {c01('adjacent')}*0.18e0 - {c01('occlusion')}*0.12e0"
)
SPINE = "coalesce((side = 'left' AND edge = 'right') OR (side = 'right' AND edge = 'left'), false)"
ALLOWED = (
    f"CASE WHEN {SPINE} THEN 0.055e0 ELSE 0.1e0 END * "
    + c01(f"{c01('(transition - 0.18e0)/0.34e0')}*0.42e0 + {c01('continuity')}*0.18e0 + {c01('(ownership - 0.66e0)/(1e0 - 0.66e0)')}*0.2e0 + (1e0 - {c01('adjacent')})*0.14e0 + (1e0 - {c01('occlusion')})*0.06e0")
)
STATE = """CASE WHEN evidence < 2 OR coverage < 0.48e0 OR conflict THEN 'unreliable' WHEN magnitude < 0.0015e0 AND contour < 0.0015e0 AND internal < 0.0015e0 THEN 'flat'
  WHEN magnitude < 0.008e0 AND ((confidence >= 0.56e0 AND coverage >= 0.52e0 AND consistency >= 0.72e0) OR (contour >= 0.0015e0 AND support >= 0.67e0 AND confidence >= 0.5e0 AND consistency >= 0.6e0
    AND (n_geometry >= 2 OR (n_geometry >= 1 AND n_internal >= 1 AND agree)))) THEN 'mildCurve'
  WHEN magnitude >= 0.008e0 AND confidence >= 0.68e0 THEN 'strongCurve' ELSE 'unreliable' END"""
QUERIES = {
    f.__name__: f
    for f in (
        edge_visibility, edge_visibility_counts, paper_candidates, refinement_verdicts, edge_expansion, page_ownership, partial_masks, bottom_recovery, curvature_classes, curve_adoption,
        curved_confidence, direction_conflicts, spread_classes, production_crop, guide_levels, quality_warnings, conservative_corners, tone_tables,
    )
}
ORACLE = {
    "edge_visibility": oracle(f"""
WITH v AS (SELECT *, {VIS} AS visibility FROM {{placed_evidence}})
SELECT page_id, ord, edge, visibility, CASE WHEN visibility = 'confirmed' THEN 0e0 WHEN visibility = 'weak' THEN CASE WHEN edge = 'bottom' THEN 0.035e0 ELSE 0.012e0 END
  WHEN edge = 'bottom' THEN 0.07e0 WHEN visibility = 'occluded' THEN 0.03e0 ELSE 0.04e0 END AS margin FROM v"""),
    "edge_visibility_counts": oracle(f"""
WITH v AS (SELECT page_id, {VIS} AS v FROM {{evidence}})
SELECT page_id, count(*) FILTER (v = 'confirmed') AS confirmed, count(*) FILTER (v = 'weak') AS weak, count(*) FILTER (v = 'occluded') AS occluded,
  count(*) FILTER (v = 'outOfFrame') AS "outOfFrame", count(*) FILTER (v = 'unknown') AS unknown FROM v GROUP BY page_id"""),
    "paper_candidates": oracle(f"""
SELECT page_id, ord, CASE WHEN agree AND containment >= 0.82e0 AND expansion BETWEEN 0.9e0 AND 1.85e0
  THEN {R(c01('containment') + '*0.52e0 + ' + c01('1e0 - abs(expansion - 1.16e0)/0.75e0') + '*0.2e0 + ' + c01('transition') + '*0.28e0')} END AS score FROM {{placed_evidence}}"""),
    "refinement_verdicts": oracle(f"""
WITH v AS (SELECT *, {VERDICT} AS verdict, {CONF} AS c FROM {{placed_evidence}})
SELECT page_id, ord, verdict, {R('c')} AS confidence, CASE WHEN verdict = 'accepted' THEN CASE WHEN agree OR c < 0.58e0 THEN 'acceptedConservative' WHEN occlusion >= 0.16e0 THEN 'acceptedOcclusionRecovered' ELSE 'accepted' END
  ELSE coalesce(map {{'partial_ai_raw': 'rejectedPartialRaw', 'adjacent_page_merge': 'rejectedAdjacentPage', 'main_page_ownership_lost': 'rejectedAdjacentPage', 'occlusion_unresolved': 'rejectedOcclusion',
    'excessive_refinement_expansion': 'rejectedExpansion', 'excessive_inward_refinement': 'rejectedShrink', 'ai_foreground_clipped': 'rejectedForegroundClipped',
    'refined_boundary_not_convex': 'rejectedGeometry', 'refined_corners_out_of_bounds': 'rejectedGeometry'}}[verdict], 'rawFallback') END AS status FROM v"""),
    "edge_expansion": oracle(f"""
WITH a AS (SELECT *, least({ALLOWED}, greatest(requested, 0e0)) AS a FROM {{placed_evidence}})
SELECT page_id, ord, {R('a')} AS applied, a + 1e-9 < requested AS conservative, transition >= 0.18e0 AND ownership >= 0.66e0 AND adjacent < 0.66e0 AND occlusion <= 0.48e0 AS reliable FROM a"""),
    "page_ownership": oracle(f"""
SELECT page_id, ord, {R(c01('containment') + '*0.55e0 + ' + c01('support') + '*0.25e0 + ' + c01('continuity') + '*0.2e0')} AS ownership,
  {R(c01(c01('(expansion - 1.24e0)/0.34e0') + '*0.42e0 + ' + c01('border/0.12e0') + '*0.38e0 + ' + c01('occlusion') + '*0.2e0'))} AS adjacent FROM {{placed_evidence}}"""),
    "partial_masks": oracle("""
SELECT page_id, ord, transition + 0.2e0 < 0.28e0 OR support < 0.34e0 OR (reliable AND transition + 0.2e0 < CASE WHEN side IS NULL THEN 0.72e0 ELSE 0.64e0 END AND support < 0.7e0 AND ownership < 0.78e0)
  OR (border < 0.045e0 AND NOT agree AND support < 0.52e0) AS partial FROM {placed_evidence}"""),
    "bottom_recovery": oracle(f"""
SELECT page_id, {R("max(greatest(border, CASE WHEN occlusion <= 0.48e0 THEN support ELSE coalesce(paper_score, border) END)) FILTER (edge = 'bottom')")} AS bottom,
  count(*) FILTER (reliable AND side IS NOT NULL AND edge = CASE WHEN side = 'left' THEN 'left' ELSE 'right' END) > 0 AND count(*) FILTER (reliable AND edge IN ('top', 'bottom')) > 0 AS supported
FROM {{evidence}} GROUP BY page_id"""),
    "curvature_classes": oracle(f"""
WITH s AS (SELECT *, {STATE} AS state FROM {{placed_evidence}}),
m AS (SELECT *, CASE WHEN n_internal > 0 THEN abs(internal) ELSE least(abs(contour), 0.006e0) END * CASE state WHEN 'mildCurve' THEN 0.55e0 WHEN 'strongCurve' THEN 1e0 ELSE 0e0 END AS size FROM s)
SELECT page_id, ord, state, {R('size * 1000e0')} AS deformation, size > 0.025e0 AS excessive FROM m"""),
    "curve_adoption": oracle(f"""
WITH s AS (SELECT *, {STATE} AS state FROM {{placed_evidence}})
SELECT page_id, ord, state IN ('mildCurve', 'strongCurve') AND stretch <= 0.025e0 AND ((straight_before > 0 AND straight_after >= straight_before * CASE WHEN state = 'mildCurve' THEN 1.0005e0 ELSE 1.005e0 END)
    OR (state = 'mildCurve' AND contour >= 0.0015e0 AND internal <= contour * 0.995e0))
  AND abs(after_w - before_w)/before_w <= 0.02e0 AND abs(after_h - before_h)/before_h <= 0.02e0 AND abs(after_w/after_h - before_w/before_h)/(before_w/before_h) <= 0.02e0 AS adopted FROM s"""),
    "curved_confidence": oracle(f"SELECT page_id, ord, {R('coverage*0.45e0 + support*0.3e0 + consistency*0.25e0')} AS confidence, coverage*0.45e0 + support*0.3e0 + consistency*0.25e0 >= 0.68e0 AS enough FROM {{placed_evidence}}"),
    "direction_conflicts": oracle("""
WITH w AS (SELECT page_id, ord % 2 = 0 AS g, reliable_edges % 3 - 1 AS s FROM {placed_evidence}),
n AS (SELECT page_id, count(*) FILTER (g AND s > 0) AS gp, count(*) FILTER (g AND s < 0) AS gn, count(*) FILTER (NOT g AND s > 0) AS ip, count(*) FILTER (NOT g AND s < 0) AS im FROM w GROUP BY page_id),
c AS (SELECT *, CASE WHEN gp + gn > 0 THEN greatest(gp, gn)/(gp + gn)::DOUBLE ELSE 0e0 END AS cg, CASE WHEN ip + im > 0 THEN greatest(ip, im)/(ip + im)::DOUBLE ELSE 0e0 END AS ci FROM n)
SELECT page_id, (gp > 0 AND gn > 0 AND cg < 0.67e0) OR (ip > 0 AND im > 0 AND ci < 0.67e0) OR (gp + gn >= 2 AND ip + im >= 2 AND sign(gp - gn) * sign(ip - im) < 0 AND cg >= 0.67e0 AND ci >= 0.67e0) AS conflict FROM c"""),
    "spread_classes": oracle(f"""
WITH e AS (SELECT page_id, ord, expansion + 0.2e0 AS aspect, ownership AS l, consistency AS r, confidence AS structure, support AS gutter FROM {{placed_evidence}}),
b AS (SELECT *, CASE WHEN greatest(l, r) <= 0.001e0 THEN 0e0 ELSE {c01('least(l, r)/greatest(l, r)')} END AS balance FROM e),
p AS (SELECT *, gutter*0.3e0 + sqrt(l*r)*balance*0.34e0 + structure*0.24e0 + {c01('(aspect - 1.1e0)/0.38e0')}*0.12e0 AS p FROM b),
c AS (SELECT *, {c01("CASE WHEN aspect >= 1.28e0 AND l >= 0.52e0 AND r >= 0.52e0 AND balance >= 0.68e0 AND structure >= 0.5e0 AND gutter >= 0.44e0 THEN greatest(p, 0.75e0) ELSE p END")} AS c FROM p),
k AS (SELECT *, CASE WHEN aspect < 1.1e0 THEN 'single/not_landscape' WHEN least(l, r) < 0.34e0 THEN 'single/one_sided_content' WHEN balance < 0.48e0 THEN 'single/content_unbalanced'
  WHEN structure < 0.38e0 THEN 'single/not_page_like' WHEN gutter < 0.32e0 THEN CASE WHEN c < 0.45e0 THEN 'single/no_central_gutter' ELSE 'uncertain/weak_central_gutter' END
  WHEN c >= 0.72e0 THEN 'spread/none' WHEN c < 0.45e0 THEN 'single/low_confidence' ELSE 'uncertain/below_spread_threshold' END AS k FROM c)
SELECT page_id, ord, {R('c')} AS confidence, split_part(k, '/', 1) AS layout, split_part(k, '/', 2) AS reason FROM k"""),
    "production_crop": oracle("""
WITH s AS (SELECT *, CASE WHEN evidence = 0 THEN 'rawFallback' WHEN evidence < 3 THEN 'refined' ELSE 'hybrid' END AS f FROM {placed_evidence})
SELECT page_id, ord, CASE WHEN NOT partial_raw AND has_corners AND confidence >= CASE WHEN f = 'rawFallback' THEN 0.58e0 ELSE 0.45e0 END AND support BETWEEN 0.02e0 AND 0.995e0 AND (ownership = 0 OR ownership >= 0.66e0)
  AND adjacent < 0.66e0 AND in_bounds THEN 'ai_' || f WHEN coverage >= 0.7e0 THEN CASE WHEN partial_raw THEN 'openCv' ELSE 'openCvFallback' END ELSE 'guide' END AS source FROM s"""),
    "guide_levels": oracle("""
SELECT page_id, ord, CASE WHEN NOT has_corners THEN 'none' WHEN NOT in_bounds THEN 'low' WHEN agree AND coverage >= 0.45e0 THEN 'stable' WHEN coverage >= 0.3e0 THEN 'medium' ELSE 'low' END AS level FROM {placed_evidence}"""),
    "quality_warnings": oracle("""
WITH w AS (SELECT page_id, ord, straight_after < straight_before*0.9e0 AS soft, internal > contour*1.75e0 AND internal > contour + 0.001e0 AS speckled FROM {placed_evidence}) SELECT * FROM w WHERE soft OR speckled"""),
    "conservative_corners": oracle("""
SELECT page_id, ord, CASE WHEN reliable_edges >= 2 THEN 'edges' WHEN paper_score >= 0.56e0 THEN 'paper' WHEN expansion >= 0.98e0 THEN 'area' ELSE 'none' END AS choice,
  CASE WHEN convex AND expansion BETWEEN 0.96e0 AND 1.7e0 THEN 'refined' WHEN in_bounds THEN 'hybrid' WHEN has_corners THEN 'raw' ELSE 'none' END AS polygon FROM {placed_evidence}"""),
    "tone_tables": """
WITH v AS (SELECT range::INTEGER AS v, least(1e0, greatest(0e0, (range - 120e0)/120e0)) AS u, least(1e0, greatest(0e0, (205e0 - range)/205e0)) AS d FROM range(256))
SELECT v, floor(v + (255e0 - v)*0.86e0*(u*u*(3e0 - u*2e0)) + 0.5e0)::INTEGER AS paper, floor(v*(1e0 - d*d*(3e0 - d*2e0)*0.2e0) + 0.5e0)::INTEGER AS foreground FROM v""",
}
