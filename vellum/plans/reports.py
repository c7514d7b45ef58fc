"""Queries over reports of stages and the records of a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import reports as O
from vellum.sources.tables import oracle, view


def merged_stage_reports(spark, d):
    """The report of each page from its corrections and enhancements, and its line in the log."""
    stage = F.when(F.col("event_type") == "click", "perspective").when(F.col("event_type") == "purchase", "curved").when(F.col("event_type") == "view", "enhanced")
    metrics = [F.struct((F.col("pos") * 10 + k).alias("width"), (F.col("pos") * 14 + k).alias("height"), (F.floor("value") + k).alias("sharpness")) for k in (0, 1)]
    events = view(spark, d, "signal").select("series_id", F.col("pos").alias("at"), stage.alias("stage"), metrics[0].alias("source"), metrics[1].alias("output"))
    return O.merged_reports(events, "series_id").select("series_id", *[F.col(f"{s}.{m}").alias(f"{s}_{m}") for s in O.STAGES for m in ("width", "sharpness")], O.report_line("series_id", ("sharpness",)).alias("line"))


def log_record_shapes(spark, d):
    """Records of five shapes in one log, each read into the same fields."""
    k, share = F.floor("value").cast("string"), F.format_string("%.4f", F.floor("value") / 100.0)
    side = F.when(F.col("pos") % 2 == 0, "left").otherwise("single")
    shapes = {
        "click": F.concat(F.lit("[t][AI_SEGMENTATION] mode=spread pageSide="), side, F.lit(" success=true totalMs="), k, F.lit(" maskCoverage="), share, F.lit(" opencvCropSource=none failureReason=none")),
        "error": F.concat(F.lit("[t][AI_REFINEMENT] mode=single pageSide="), side, F.lit(" attempted=true accepted=false refinedAreaRatio="), share, F.lit(" refinedStatus=rejected failureReason=area_a="), k),
        "purchase": F.concat(F.lit("[t][MLKIT_SPREAD] page="), F.col("pos").cast("string"), F.lit(" width=900 splitConfidence="), share, F.lit(" classification=spread rejectReason=none splitterInvoked=true")),
        "signup": F.concat(F.lit("[t][SCAN_QUALITY] page="), F.col("pos").cast("string"), F.lit(" rawResolution=n/axn/a rawSharpness=n/a")),
        "view": F.concat(F.lit("[t][SCAN_QUALITY_WARNING] page="), F.col("pos").cast("string"), F.lit(" foregroundSharpnessDropped source=1.00 enhanced="), share),
    }
    line = F.coalesce(*[F.when(F.col("event_type") == kind, text) for kind, text in shapes.items()])
    read = O.records(view(spark, d, "signal").select("series_id", "pos", line.alias("line")), "line")
    return read.select("series_id", "pos", "category", *[name for name, _, _ in O.FIELDS], F.array_join("flags", ",").alias("flags"))


QUERIES = {f.__name__: f for f in (merged_stage_reports, log_record_shapes)}


def _last(kind: str, add: int, what: str) -> str:
    number = {"width": f"pos*10 + {add}", "height": f"pos*14 + {add}", "sharpness": f"floor(value)::BIGINT + {add}"}[what]
    return f"arg_max({number}, pos) FILTER (event_type = '{kind}')"


def _stage(stage: str, what: str) -> str:
    number = {"width": "pos*10", "height": "pos*14", "sharpness": "floor(value)::BIGINT"}[what]
    first = f"arg_min({number}, pos) FILTER (event_type = 'view')"
    return {"raw": _last("click", 0, what), "perspective": f"coalesce({_last('click', 1, what)}, {first})", "curved": _last("purchase", 1, what), "enhanced": _last("view", 1, what)}[stage]


COLUMNS = ", ".join(f"{_stage(s, m)} AS {s}_{m}" for s in O.STAGES for m in ("width", "height", "sharpness"))
NA = {f"{s}_{m}": f"coalesce({s}_{m}::VARCHAR, 'n/a')" for s in O.STAGES for m in ("width", "height", "sharpness")}
LINE = " || ".join(["'page=' || series_id"] + [f"' {s}Resolution=' || {NA[f'{s}_width']} || 'x' || {NA[f'{s}_height']}" for s in O.STAGES] + [f"' {s}Sharpness=' || {NA[f'{s}_sharpness']}" for s in O.STAGES])
ORACLE = {
    "merged_stage_reports": oracle(f"""WITH r AS (SELECT series_id, {COLUMNS} FROM {{signal}} WHERE event_type IN ('click', 'purchase', 'view') GROUP BY series_id)
SELECT series_id, {", ".join(f"{s}_{m}" for s in O.STAGES for m in ("width", "sharpness"))}, {LINE} AS line FROM r"""),
    "log_record_shapes": oracle("""SELECT series_id, pos, CASE event_type WHEN 'click' THEN 'AI_SEGMENTATION' WHEN 'error' THEN 'AI_REFINEMENT' WHEN 'purchase' THEN 'MLKIT_SPREAD' WHEN 'signup' THEN 'SCAN_QUALITY' WHEN 'view' THEN 'SCAN_QUALITY_WARNING' END AS category,
  CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN pos END AS page, CASE event_type WHEN 'click' THEN 'spread' WHEN 'error' THEN 'single' END AS mode,
  CASE WHEN event_type IN ('click', 'error') THEN CASE WHEN pos % 2 = 0 THEN 'left' ELSE 'single' END END AS side, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false WHEN 'purchase' THEN true END AS passed,
  CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'spread' END AS status, CASE event_type WHEN 'error' THEN 'area_a=' || floor(value)::BIGINT END AS reason,
  CASE WHEN event_type <> 'signup' THEN floor(value) / 100e0 END AS share, CASE event_type WHEN 'click' THEN floor(value)::BIGINT END AS total_ms, CASE event_type WHEN 'view' THEN 'foregroundSharpnessDropped' ELSE '' END AS flags FROM {signal}"""),
}
