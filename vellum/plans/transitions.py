"""Queries over what becomes of pages and sessions, and over values that come from outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import transitions as T
from vellum.functions.numbers import clamp
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.sources.tables import oracle, view

KEYS = ["page_id", "ord"]
TIMINGS = ("backgroundAnalysisMilliseconds", "sharpeningMilliseconds")

# one row per page and event: what the page was, what the event brings
PAGES = """
SELECT page_id, ord, CASE (l % 6) WHEN 0 THEN 'detection' WHEN 1 THEN 'corners' WHEN 2 THEN 'correction' WHEN 3 THEN 'curvature' WHEN 4 THEN 'enhancement' ELSE 'spread_fallback' END AS event,
  CASE WHEN l % 5 = 0 THEN NULL ELSE 'old' END AS corners, CASE l % 3 WHEN 0 THEN 'guideFallback' WHEN 1 THEN 'aiPrimary' ELSE NULL END AS crop_source, l % 4 = 0 AS adjusted,
  CASE l % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS correction, CASE WHEN l % 7 < 4 THEN 'perspective' ELSE 'curved' END AS correction_type,
  CASE WHEN l % 4 = 2 THEN 'completed' ELSE 'none' END AS outcome, CASE WHEN l % 4 = 3 THEN 'lowConfidence' END AS failure, CASE WHEN l % 11 > 4 THEN 'old.png' END AS corrected_path,
  l % 13 > 6 AS perspective_applied, CASE l % 8 WHEN 0 THEN 'flat' WHEN 1 THEN 'mildCurve' ELSE 'none' END AS curvature, l % 8 = 1 AS curved_applied, l % 17 = 0 AS spread_fallback,
  CASE WHEN l % 9 > 4 THEN 'completed' ELSE 'none' END AS enhancement, l % 9 > 4 AS enhancement_applied, CASE WHEN l % 9 > 4 THEN 'old-enhanced.png' END AS enhanced_path,
  CASE WHEN m % 3 = 0 THEN NULL ELSE 'new' END AS new_corners, CASE WHEN m % 4 = 0 THEN 'paper' END AS new_crop_source, CASE m % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'processing' END AS new_status,
  CASE WHEN m % 5 < 3 THEN 'perspective' ELSE 'curved' END AS new_type, CASE WHEN m % 7 = 0 THEN 'unsafeDeformation' END AS new_outcome, CASE WHEN m % 6 = 1 THEN 'canvas' END AS new_failure,
  CASE WHEN m % 11 > 2 THEN 'new.png' END AS new_path, m % 2 = 0 AS new_applied, CASE m % 4 WHEN 0 THEN 'mildCurve' WHEN 1 THEN 'flat' WHEN 2 THEN 'strongCurve' ELSE 'unreliable' END AS new_curvature
FROM (SELECT page_id, ord, CAST(floor(border * 120e0 + 0.5e0) AS BIGINT) + page_id AS l, CAST(floor(support * 20e0 + 0.5e0) AS BIGINT) + page_id * 3 + ord AS m FROM {evidence}) z
"""


def pages(spark, d):
    e = view(spark, d, "evidence")
    return spark.sql(PAGES, evidence=e)


def page_transitions(spark, d):
    after = T.after_event(F.col("event"), lambda name: F.col(f"new_{name}"))
    return pages(spark, d).select(*KEYS, "event", *[after[c].alias(f"after_{c}") for c in T.STATE])


def curve_adoptions(spark, d):
    p = pages(spark, d)
    error = F.when(F.col("new_outcome").isNotNull() | (F.col("correction") == "failed"), F.coalesce("new_failure", F.lit("curvature_analysis_failed")))
    error_state = F.when(F.col("crop_source").isNotNull(), F.col("curvature"))
    found = T.curve_adoption(F.col("new_curvature"), error, error_state, F.col("adjusted"))
    return p.select(*KEYS, *[v.alias(n) for n, v in found.items()])


def correction_results(spark, d):
    found = T.correction_result(F.col("new_type"), F.col("corners").isNotNull(), F.col("correction") != "failed", F.col("new_status") == "completed", F.col("new_crop_source").isNull(), F.col("new_failure"))
    return pages(spark, d).select(*KEYS, *[v.alias(n) for n, v in found.items()])


def spread_results(spark, d):
    source = F.coalesce("crop_source", F.lit("none"))
    return pages(spark, d).select(*KEYS, T.spread_result(F.col("corners").isNotNull(), source, F.col("new_status") == "completed", F.col("new_path").isNotNull()).alias("result"))


def curve_boundaries(spark, d):
    found = T.curve_boundary(F.col("evidence") * 4, F.col("convex"), F.col("has_corners"), F.col("n_geometry") + 1, F.col("n_internal") * 2)
    return view(spark, d, "evidence").select(*KEYS, found.alias("boundary"))


def curve_improvements(spark, d):
    state = F.when(F.col("agree"), "mildCurve").otherwise("strongCurve")
    found = T.curve_improves(state, F.col("straight_before"), F.col("straight_after"), F.col("contour"), F.when(F.col("conflict"), F.lit(None)).otherwise(F.col("stretch") / 40.0), F.when(F.col("reliable"), F.lit(0.55)))
    return view(spark, d, "evidence").select(*KEYS, found.alias("adopted"))


def enhancement_problems(spark, d):
    e = view(spark, d, "evidence")
    mode = F.element_at(F.array(*[F.lit(m) for m in (*T.MODES, "sepia")]), (F.col("evidence") + 1).cast("int"))
    name = F.when(F.col("convex"), "Page.PNG").otherwise("page.jpg")
    size, out = (F.col("before_w"), F.col("before_h")), (F.when(F.col("agree"), F.col("before_w")).otherwise(F.col("after_w")), F.col("before_h"))
    return e.select(*KEYS, T.enhancement_problem(mode, F.col("has_corners"), size, out, name).alias("problem"))


def policies_of(spark, d):
    e = view(spark, d, "evidence")
    v = {
        "inset": F.col("requested"), "confidence": F.col("confidence"), "least_deformation": F.col("magnitude"), "most_deformation": F.when(F.col("convex"), F.col("contour") * 4.0).otherwise(F.lit(float("nan"))), "adjacent": F.col("internal") * 11.0,
        "coverage": F.col("coverage"), "consistency": F.col("consistency"), "mild_magnitude": F.col("contour"), "mild_confidence": F.col("paper_score"), "mild_coverage": F.col("expansion") - 0.8, "mild_consistency": F.col("adjacent"), "mild_strength": F.lit(0.55),
    }
    return e, v


def policy_problems(spark, d):
    e, v = policies_of(spark, d)
    return e.select(*KEYS, T.policy_problem(v).alias("problem"))


JSON = """
SELECT page_id, ord, '{"sourceWidth": ' || CASE WHEN l % 7 = 0 THEN '"900"' WHEN l % 11 = 0 THEN '900.5' WHEN l % 13 = 0 THEN '-4' ELSE '900' END || ', "sourceHeight": ' || CASE WHEN l % 17 = 0 THEN 'null' ELSE '1400' END
  || ', "confidence": ' || CASE WHEN l % 5 = 0 THEN '1' WHEN l % 19 = 0 THEN 'true' ELSE '0.25' END || CASE WHEN l % 23 = 0 THEN '' ELSE ', "detected": true' END || ', "outputWidth": ' || CASE WHEN l % 29 = 0 THEN '0' ELSE '10' END
  || ', "outputHeight": 12, "processingMilliseconds": ' || CASE WHEN l % 31 = 0 THEN '-1' WHEN l % 37 = 0 THEN '"1"' ELSE '0' END || CASE WHEN l % 3 = 0 THEN ', "sharpeningMilliseconds": ' || CASE WHEN l % 2 = 0 THEN '5' ELSE '-5' END ELSE '' END
  || ', "fullText": "t", "sourcePageId": ' || CASE WHEN l % 9 = 0 THEN '5' ELSE '"p"' END || ', "blocks": ' || CASE WHEN l % 8 = 0 THEN '{}' ELSE '[]' END || '}' AS json
FROM (SELECT page_id, ord, page_id * 3 + ord AS l FROM {evidence}) z
"""


def native_problems(spark, d):
    """What speaks against answers of a detector, an enhancer and a text recogniser."""
    rows = spark.sql(JSON.replace("{\"", "{{\"").replace("'{}'", "'{{}}'").replace("'}'", "'}}'"), evidence=view(spark, d, "evidence")).withColumn("v", F.parse_json("json"))
    v = F.col("v")
    return rows.select(*KEYS, T.detection_problem(v).alias("detection"), T.enhancer_problem(v, TIMINGS).alias("enhancer"), T.recognition_problem(v).alias("recognition"))


def inset_regions(spark, d):
    found = T.inset_region(F.col("before_w") + F.col("support"), F.col("before_h"), F.col("convex"))
    return view(spark, d, "evidence").select(*KEYS, *[v.alias(n) for n, v in zip(("x", "y", "w", "h"), found, strict=True)])


def boundary_points(spark, d):
    """An edge's points in another picture's size, with the sheet's corners as ends."""
    q = view(spark, d, "quads").select(*KEYS, "width", "height", *[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")).alias(f"p{k}") for k in range(4)], "jx", "jy")
    middle = F.transform(F.sequence(F.lit(1), (F.abs("jx") / 6.0).cast("int") + 1), lambda i: F.struct((F.col("p0.x") + F.col("jx") * i).alias("x"), (F.col("p0.y") + F.col("jy") * i).alias("y")))
    moved = T.with_ends(F.concat(F.array("p2"), middle, F.array("p3")), F.col("p0"), F.col("p1"))
    small = T.scaled_points(F.col("moved"), F.col("width"), F.col("height"), F.lit(500), F.lit(350))
    total = F.aggregate("small", F.lit(0.0), lambda a, p: a + p["x"] + p["y"] * 2.0)
    return q.select(*KEYS, "width", "height", moved.alias("moved")).select(*KEYS, F.size("moved").alias("n"), small.alias("small")).select(*KEYS, "n", r6(total).alias("total"), r6(F.element_at("small", -1)["x"]).alias("last"))


def content_crops(spark, d):
    e = view(spark, d, "evidence")
    numbers = {"left": F.col("before_w") * 0.1, "top": F.col("before_h") * 0.1, "confidence": clamp("confidence"), "components": F.col("evidence").cast("double"), "margin": F.col("border")}
    return e.select(*KEYS, *[r6(v).alias(n) for n, v in T.content_safe(F.col("convex"), F.col("support") + 0.25, numbers).items()])


def failure_records(spark, d):
    e = view(spark, d, "evidence").filter("NOT has_corners OR NOT in_bounds")
    reason = F.when(~F.col("has_corners"), "model_missing").otherwise("inference_failed")
    return e.select(*KEYS, *[v.alias(n) for n, v in T.failure_record(reason, F.col("side"), {"coverage": F.col("paper_score"), "source_width": F.when(F.col("agree"), F.col("before_w"))}).items()])


def scene_points(spark, d):
    """A corner in the scene of an editor, and another scene point back in the picture."""
    q = view(spark, d, "quads").withColumns({"w": F.col("width") + (F.col("page_id") % 500), "h": F.lit(700) + F.col("ord") * 150})
    scale = T.scene_scale(F.col("w"), F.col("h"))
    scene = T.to_scene(F.col("x1"), F.col("y1"), F.col("scale"))
    source = T.to_source(F.col("x2") * 1.2 - 150.0, F.col("y2") - 900.0, F.col("scale"), F.col("w"), F.col("h"))
    return q.withColumn("scale", scale).select(*KEYS, r6("scale").alias("scale"), *[r6(v).alias(n) for n, v in zip(("scene_x", "scene_y", "source_x", "source_y"), (*scene, *source), strict=True)])


def session_fates(spark, d):
    """Sessions after the last thing that happened to them; those that were deleted leave with all their pages."""
    s = view(spark, d, "scans").groupBy("session_id").agg(F.count(F.lit(1)).alias("pages"))
    kinds = F.array(*[F.lit(x) for x in ("restore", "discard", "cancel", "exported", "delete", "capture")])
    event = F.element_at(kinds, (F.col("session_id") % 6 + 1).cast("int"))
    left = F.when(F.col("session_id") % 4 == 1, 0).otherwise(F.col("pages"))
    fate = T.session_fate(event, F.col("session_id") % 5 == 0, F.col("session_id") % 3 > 0, left)
    return s.select("session_id", event.alias("event"), fate.alias("fate")).filter("fate <> 'deleted'")


QUERIES = {
    f.__name__: f
    for f in (
        page_transitions, curve_adoptions, correction_results, spread_results, curve_boundaries, curve_improvements, enhancement_problems, policy_problems, native_problems, inset_regions, boundary_points, content_crops,
        failure_records, scene_points, session_fates,
    )
}
P = "p AS (" + PAGES + ")"


def sql(body: str) -> str:
    return oracle(f"WITH {P} {body}")


ORACLE = {
    "page_transitions": sql("""SELECT page_id, ord, event, CASE WHEN event IN ('detection', 'corners') AND new_corners IS NOT NULL THEN new_corners ELSE corners END AS after_corners,
  CASE WHEN event = 'detection' AND new_crop_source IS NOT NULL THEN new_crop_source WHEN event = 'corners' THEN 'manualCorners' ELSE crop_source END AS after_crop_source,
  CASE event WHEN 'detection' THEN false WHEN 'corners' THEN true ELSE adjusted END AS after_adjusted,
  CASE WHEN event = 'corners' THEN 'none' WHEN event = 'correction' THEN new_status WHEN event IN ('curvature', 'spread_fallback') THEN 'completed' ELSE correction END AS after_correction,
  CASE WHEN event = 'correction' THEN new_type WHEN event = 'curvature' THEN CASE WHEN new_applied THEN 'curved' ELSE 'perspective' END WHEN event = 'spread_fallback' THEN 'perspective' ELSE correction_type END AS after_correction_type,
  CASE WHEN event = 'correction' THEN coalesce(new_outcome, CASE WHEN new_status = 'completed' THEN 'completed' ELSE 'none' END) WHEN event = 'curvature' THEN CASE WHEN NOT new_applied AND new_curvature = 'flat' THEN 'nearlyFlat' ELSE 'completed' END WHEN event = 'spread_fallback' THEN 'completed' ELSE outcome END AS after_outcome,
  CASE WHEN event = 'curvature' OR event = 'correction' AND new_status <> 'failed' THEN NULL WHEN event = 'correction' THEN coalesce(new_failure, failure) ELSE failure END AS after_failure,
  CASE WHEN event IN ('correction', 'curvature', 'spread_fallback') THEN coalesce(new_path, corrected_path) ELSE corrected_path END AS after_corrected_path,
  perspective_applied OR event IN ('curvature', 'spread_fallback') OR event = 'correction' AND new_type = 'perspective' AND new_status = 'completed' AS after_perspective_applied,
  CASE WHEN event = 'correction' AND new_type = 'perspective' OR event = 'spread_fallback' THEN 'none' WHEN event = 'curvature' THEN new_curvature ELSE curvature END AS after_curvature,
  CASE WHEN event = 'correction' THEN new_type = 'curved' AND new_status = 'completed' WHEN event = 'curvature' THEN new_applied ELSE curved_applied END AS after_curved_applied,
  CASE event WHEN 'correction' THEN false WHEN 'spread_fallback' THEN true ELSE spread_fallback END AS after_spread_fallback,
  CASE WHEN event IN ('corners', 'correction', 'curvature') THEN 'none' WHEN event = 'enhancement' THEN new_status ELSE enhancement END AS after_enhancement,
  CASE WHEN event IN ('correction', 'curvature') THEN false WHEN event = 'enhancement' THEN new_status = 'completed' ELSE enhancement_applied END AS after_enhancement_applied,
  CASE WHEN event = 'enhancement' THEN coalesce(new_path, enhanced_path) ELSE enhanced_path END AS after_enhanced_path FROM p"""),
    "curve_adoptions": sql("""SELECT page_id, ord, CASE WHEN failed THEN CASE WHEN crop_source IS NOT NULL THEN curvature WHEN adjusted THEN 'flat' ELSE 'unreliable' END ELSE new_curvature END AS state, NOT failed AND new_curvature IN ('mildCurve', 'strongCurve') AS applied,
  CASE WHEN failed THEN coalesce(new_failure, 'curvature_analysis_failed') WHEN new_curvature NOT IN ('mildCurve', 'strongCurve') THEN 'missing_or_non_applicable_state' END AS reject_reason,
  CASE WHEN NOT failed AND new_curvature IN ('mildCurve', 'strongCurve') THEN 'curved' ELSE 'perspective' END AS correction_type FROM (SELECT *, new_outcome IS NOT NULL OR correction = 'failed' AS failed FROM p)"""),
    "correction_results": sql("""SELECT page_id, ord, CASE WHEN good THEN 'completed' ELSE 'failed' END AS status, CASE WHEN good THEN new_type WHEN safe THEN 'perspective' END AS path,
  CASE WHEN good THEN 'completed' WHEN corners IS NULL THEN 'none' WHEN safe AND new_status = 'completed' THEN 'unsafeDeformation' WHEN new_type = 'curved' THEN 'lowConfidence' ELSE 'none' END AS outcome,
  CASE WHEN good OR corners IS NULL THEN NULL WHEN safe AND new_status = 'completed' THEN 'canvas_changed' ELSE coalesce(new_failure, 'correction_failed') END AS reason, good OR safe AS enhance FROM (
  SELECT *, corners IS NOT NULL AND new_type = 'curved' AND correction <> 'failed' AS safe, corners IS NOT NULL AND new_status = 'completed' AND (new_type = 'perspective' OR correction <> 'failed' AND new_crop_source IS NULL) AS good FROM p)"""),
    "spread_results": sql("SELECT page_id, ord, CASE WHEN corners IS NOT NULL AND crop_source IS DISTINCT FROM 'guideFallback' AND new_status = 'completed' THEN 'corrected' WHEN new_path IS NULL THEN 'failed' ELSE 'safeCrop' END AS result FROM p"),
    "curve_boundaries": oracle("SELECT page_id, ord, CASE WHEN has_corners AND evidence > 0 AND convex THEN 'contour' WHEN n_geometry >= 3 OR n_internal >= 2 THEN 'existing' ELSE 'none' END AS boundary FROM {evidence}"),
    "curve_improvements": oracle("""SELECT page_id, ord, straight_before > 0 AND straight_after >= straight_before*CASE WHEN agree THEN 1.0005e0 ELSE 1.005e0 END
  OR agree AND contour >= 0.0015e0 AND greatest(0e0, contour - CASE WHEN conflict THEN contour*CASE WHEN reliable THEN 0.55e0 ELSE 1e0 END ELSE stretch/40e0 END) <= contour*0.995e0 AS adopted FROM {evidence}"""),
    "enhancement_problems": oracle("""SELECT page_id, ord, CASE WHEN NOT has_corners THEN 'not_decoded' WHEN evidence = 4 THEN 'unknown_mode' WHEN NOT agree AND after_w <> before_w THEN 'resolution_changed' WHEN NOT convex THEN 'lossy_file' END AS problem FROM {evidence}"""),
    "policy_problems": oracle("""SELECT page_id, ord, CASE WHEN requested > 0.2e0 THEN 'inset' WHEN NOT convex OR contour*4e0 > 0.1e0 THEN 'most_deformation' WHEN internal*11e0 > 0.1e0 THEN 'adjacent' WHEN paper_score IS NULL THEN 'mild_confidence'
  WHEN expansion - 0.8e0 < 0 OR expansion - 0.8e0 > 1 THEN 'mild_coverage' WHEN magnitude >= contour*4e0 THEN 'order' END AS problem FROM {evidence}"""),
    "native_problems": oracle(f"WITH j AS ({JSON})" + """, t AS (SELECT page_id, ord, json_type(json, '$.sourceWidth') AS w, json_type(json, '$.sourceHeight') AS h, json_type(json, '$.confidence') AS c, json_type(json, '$.detected') AS d, json_type(json, '$.sourcePageId') AS p, json_type(json, '$.blocks') AS b,
  (json->>'$.sourceWidth') AS sw, (json->>'$.outputWidth')::INT AS ow, json_type(json, '$.processingMilliseconds') AS m, (json->>'$.processingMilliseconds')::INT AS ms, (json->>'$.sharpeningMilliseconds')::INT AS s FROM j)
SELECT page_id, ord, CASE WHEN w IN ('UBIGINT', 'BIGINT') AND h IN ('UBIGINT', 'BIGINT') AND c IN ('UBIGINT', 'DOUBLE') AND d = 'BOOLEAN' THEN NULL ELSE 'invalid_detection' END AS detection,
  CASE WHEN ow <= 0 OR m = 'VARCHAR' OR ms < 0 THEN 'invalid_output' WHEN s < 0 THEN 'invalid_timing' END AS enhancer, CASE WHEN w = 'UBIGINT' AND h = 'UBIGINT' AND p = 'VARCHAR' AND b = 'ARRAY' THEN NULL ELSE 'invalid_result' END AS recognition FROM t"""),
    "inset_regions": oracle("""WITH s AS (SELECT *, before_w + support AS bw FROM {evidence}), i AS (SELECT *, floor(bw*0.04e0 + 0.5e0)::INT AS ix, floor(before_h*0.04e0 + 0.5e0)::INT AS iy, floor(bw + 0.5e0)::INT AS rw, floor(before_h + 0.5e0)::INT AS rh FROM s)
SELECT page_id, ord, CASE WHEN convex THEN 0 ELSE ix END AS x, CASE WHEN convex THEN 0 ELSE iy END AS y, CASE WHEN convex THEN rw ELSE rw - 2*ix END AS w, CASE WHEN convex THEN rh ELSE rh - 2*iy END AS h FROM i"""),
    "boundary_points": oracle(f"""WITH m AS (SELECT *, floor(abs(jx)/6e0)::INT + 1 AS k FROM {{quads}}), t AS (SELECT page_id, ord, k + 2 AS n, x1/1000e0*500 AS last, x0/width*500 + y0/height*350*2e0 AS a, list_transform(range(1, k + 1), lambda i: [(x0 + jx*i)/width*500, (y0 + jy*i)/height*350*2e0]) AS mid, x1/width*500 AS bx, y1/height*350*2e0 AS b2 FROM m)
SELECT page_id, ord, n, {R("list_reduce(list_concat([a], flatten(mid), [bx, b2]), lambda u, v: u + v)")} AS total, {R("last")} AS last FROM t"""),
    "content_crops": oracle(f"""SELECT page_id, ord, {R("CASE WHEN convex THEN before_w*0.1e0/(support + 0.25e0) END")} AS "left", {R("CASE WHEN convex THEN before_h*0.1e0/(support + 0.25e0) END")} AS top, {R("CASE WHEN convex THEN confidence ELSE 0e0 END")} AS confidence,
  {R("CASE WHEN convex THEN evidence ELSE 0e0 END")} AS components, {R("CASE WHEN convex THEN border ELSE 0e0 END")} AS margin FROM {{evidence}}"""),
    "failure_records": oracle("""SELECT page_id, ord, false AS success, CASE WHEN has_corners THEN 'inference_failed' ELSE 'model_missing' END AS failure_reason, coalesce(side, 'single') AS page_side, coalesce(paper_score, 0e0) AS coverage,
  CASE WHEN agree THEN before_w ELSE 0e0 END AS source_width FROM {evidence} WHERE NOT (has_corners AND in_bounds)"""),
    "scene_points": oracle(f"""WITH s AS (SELECT *, width + page_id % 500 AS w, 700 + ord*150 AS h FROM {{quads}}), k AS (SELECT *, CASE WHEN greatest(w, h) > 1200 THEN 1200e0/greatest(w, h) ELSE 1e0 END AS k FROM s)
SELECT page_id, ord, {R("k")} AS scale, {R("x1*k")} AS scene_x, {R("y1*k")} AS scene_y, {R("least(greatest((x2*1.2e0 - 150e0)/k, 0e0), w)")} AS source_x, {R("least(greatest((y2 - 900e0)/k, 0e0), h)")} AS source_y FROM k"""),
    "session_fates": oracle("""WITH s AS (SELECT session_id, session_id % 6 AS e, session_id % 4 = 1 AS bare, ['restore', 'discard', 'cancel', 'exported', 'delete', 'capture'][session_id % 6 + 1] AS event FROM {scans} GROUP BY session_id)
SELECT session_id, event, CASE WHEN e = 0 AND session_id % 5 = 0 THEN 'error' WHEN e = 1 THEN 'kept' ELSE 'active' END AS fate FROM s WHERE e IN (0, 5) OR e = 1 AND NOT (bare AND session_id % 3 > 0)"""),
}
