"""Queries over page candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import candidates as C
from vellum.functions.numbers import clamp
from vellum.functions.numbers import rounded as r6
from vellum.functions.numbers import rounded_sql as R
from vellum.operators import candidates as O
from vellum.sources.tables import oracle, view


def scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "placed_candidates").withColumn("score", C.score())


def candidate_scores(spark, d):
    return scored(spark, d).select("page_id", "ord", r6("score").alias("score"), r6(C.confidence()).alias("confidence"))


def candidate_best(spark, d):
    return O.best(scored(spark, d), "page_id", F.col("score"), "kind").select("page_id", "ord", "kind", r6("value").alias("score"))


def candidate_best_native(spark, d):
    gated = view(spark, d, "placed_candidates").withColumn("score", C.score_native()).withColumn("conf", C.evidence_score())
    return O.best_conservative(gated.filter((F.col("score") >= 0.32) & (F.col("conf") >= 0.38)), "page_id").select("page_id", "ord", r6("score").alias("score"), "alternative")


def candidate_gate(spark, d):
    """Candidates that pass the limits of still and of preview images."""
    c = view(spark, d, "candidates").withColumn("score", C.score_native()).withColumn("conf", C.evidence_score())
    still = (F.col("score") >= 0.32) & (F.col("conf") >= 0.38)
    return c.groupBy("kind").agg(F.count_if(still).alias("still"), F.count_if(F.col("conf") >= 0.08).alias("preview"), F.count(F.lit(1)).alias("n"))


def candidate_topk(spark, d):
    c = view(spark, d, "placed_candidates").withColumn("origin", F.when(F.col("ord") % 3 == 0, "paper").otherwise("edge"))
    return O.top_k(c, "page_id", "origin", "area_ratio", {"edge": 3, "paper": 1}).select("page_id", "ord", "origin", F.col("rank").cast("long").alias("rank"))


def candidate_union(spark, d):
    """Candidates of three finders in one list, each finder's after those of the finders before."""
    finders = F.array(*[F.lit(k) for k in ("document", "bookPage", "openBookSpread")])
    c = view(spark, d, "placed_candidates").select("page_id", "ord", (F.array_position(finders, F.col("kind")) - 1).cast("int").alias("finder")).filter("finder >= 0")
    place = F.row_number().over(W.partitionBy("page_id").orderBy("finder", "ord"))
    return c.select("page_id", "ord", "finder", place.cast("long").alias("place"))


def split_spreads(spark, d):
    """Each spread with a central spine as its left and right half; anything else as it is."""
    c = view(spark, d, "placed_candidates")
    book = (F.col("kind") == "openBookSpread") & (F.col("spine_strength") >= 0.35) & (F.col("two_page") >= 0.35) & (F.col("aspect_ratio") >= 1.15)
    halves = F.when(book, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("whole")))
    return c.select("page_id", "ord", F.explode(halves).alias("part"), "area_ratio").withColumn("area", r6(F.when(F.col("part") == "whole", F.col("area_ratio")).otherwise(F.col("area_ratio") / 2.0))).drop("area_ratio")


def component_best(spark, d):
    c = view(spark, d, "placed_candidates").filter((F.col("aspect_ratio") > 0) & (F.greatest(F.col("aspect_ratio"), F.lit(1.0) / F.col("aspect_ratio")) <= 8))
    value = C.component_score(F.col("area_ratio"), F.col("paper"), F.greatest(F.col("aspect_ratio"), F.lit(1.0) / F.col("aspect_ratio")))
    # the area decides between equal scores
    top = c.withColumn("value", value).groupBy("page_id").agg(F.max_by(F.struct("ord", "value"), F.struct("value", "area_ratio", -F.col("ord"))).alias("b"))
    return top.select("page_id", "b.ord", r6("b.value").alias("score"))


def component_largest(spark, d):
    return O.largest_plausible(view(spark, d, "placed_candidates"), "page_id", "area_ratio").select("page_id", "ord", r6("value").alias("area"))


def segmentation_confidence(spark, d):
    """Mean probability under the mask, and continuity of its edge, in one number."""
    return view(spark, d, "placed_candidates").select("page_id", "ord", r6(clamp(F.col("paper") * 0.65 + F.col("edge") * 0.35)).alias("confidence"))


ELIGIBLE = """NOT self_intersects AND width_ratio >= CASE WHEN kind = 'bookPage' THEN 0.42e0 ELSE 0.46e0 END AND height_ratio >= 0.48e0 AND containment >= 0.72e0
  AND envelope >= 0.8e0 AND area_ratio >= CASE WHEN kind = 'bookPage' THEN 0.24e0 ELSE 0.14e0 END
  AND continuation < CASE WHEN kind = 'bookPage' THEN 0.42e0 ELSE 0.58e0 END AND line_penalty < 0.82e0"""
EVIDENCE = "greatest(0e0, least(1e0, occupancy*0.23e0 + border*0.15e0 + contrast*0.17e0 + paper*0.16e0 + rect*0.1e0 + edge*0.19e0 - line_penalty*0.24e0 - small_penalty*0.18e0))"
DOCUMENT = """base_score*0.08e0 + occupancy*0.24e0 + border*0.16e0 + contrast*0.14e0 + paper*0.14e0 + rect*0.08e0 + edge*0.08e0 + envelope*0.08e0
  - line_penalty*0.28e0 - small_penalty*0.22e0 - continuation*0.1e0"""
BOOK = """base_score*0.05e0 + occupancy*0.22e0 + border*0.16e0 + contrast*0.11e0 + paper*0.13e0 + rect*0.06e0 + edge*0.1e0 + outer_anchor*0.11e0 + envelope*0.06e0
  + spine_strength*0.05e0 + spine_proximity*0.04e0 + text_density*0.04e0 + curvature*0.02e0 - line_penalty*0.28e0 - small_penalty*0.22e0 - continuation*0.1e0 - overlap*0.2e0
  - CASE WHEN side = 'single' THEN (1e0 - (spine_strength + spine_proximity + text_density)/3e0)*0.15e0 ELSE 0e0 END"""
SCORE = f"""CASE WHEN NOT ({ELIGIBLE}) THEN -1e0 WHEN kind = 'document' THEN {DOCUMENT}
  WHEN kind = 'openBookSpread' THEN base_score - CASE WHEN spine_strength >= 0.35e0 AND spine_proximity >= 0.7e0 AND aspect_ratio >= 1.15e0 AND area_ratio >= 0.45e0 AND two_page >= 0.35e0 THEN 0.24e0 ELSE 0e0 END
  ELSE {BOOK} END"""
NATIVE = f"""CASE kind WHEN 'document' THEN {DOCUMENT} WHEN 'openBookSpread' THEN base_score - 0.24e0 ELSE
  base_score*0.05e0 + occupancy*0.22e0 + border*0.16e0 + contrast*0.11e0 + paper*0.13e0 + rect*0.06e0 + edge*0.1e0 + outer_anchor*0.11e0 + envelope*0.06e0
  + spine_proximity*0.02e0 + curvature*0.02e0 - line_penalty*0.28e0 - small_penalty*0.22e0 - continuation*0.1e0 - overlap*0.2e0 END"""

QUERIES = {
    f.__name__: f
    for f in (candidate_scores, candidate_best, candidate_best_native, candidate_gate, candidate_topk, candidate_union, split_spreads, component_best, component_largest, segmentation_confidence)
}
ORACLE = {
    "candidate_scores": oracle(f"SELECT page_id, ord, {R(SCORE)} AS score, {R(f'CASE WHEN {ELIGIBLE} THEN {EVIDENCE} ELSE 0e0 END')} AS confidence FROM {{placed_candidates}}"),
    "candidate_best": oracle(f"""
WITH s AS (SELECT *, {SCORE} AS score FROM {{placed_candidates}})
SELECT page_id, ord, kind, floor(score * 1e6 + 0.5e0) / 1e6 AS score FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) = 1"""),
    "candidate_best_native": oracle(f"""
WITH s AS (SELECT *, {NATIVE} AS score, {EVIDENCE} AS conf FROM {{placed_candidates}}),
g AS (SELECT * FROM s WHERE score >= 0.32e0 AND conf >= 0.38e0),
t AS (SELECT page_id, ord, score, area_ratio, continuation FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) = 1),
a AS (SELECT g.page_id, g.ord, g.score FROM g JOIN t USING (page_id) WHERE g.area_ratio >= t.area_ratio*1.16e0 AND g.score >= t.score - 0.1e0 AND g.paper >= 0.5e0
  AND g.contrast >= 0.16e0 AND g.line_penalty < 0.62e0 AND g.continuation <= t.continuation + 0.1e0 QUALIFY row_number() OVER (PARTITION BY g.page_id ORDER BY g.area_ratio DESC, g.ord) = 1)
SELECT t.page_id, coalesce(a.ord, t.ord) AS ord, floor(coalesce(a.score, t.score) * 1e6 + 0.5e0) / 1e6 AS score, a.ord IS NOT NULL AS alternative FROM t LEFT JOIN a USING (page_id)"""),
    "candidate_gate": oracle(f"""
SELECT kind, count(*) FILTER (score >= 0.32e0 AND conf >= 0.38e0) AS still, count(*) FILTER (conf >= 0.08e0) AS preview, count(*) AS n
FROM (SELECT kind, {NATIVE} AS score, {EVIDENCE} AS conf FROM {{candidates}}) GROUP BY kind"""),
    "candidate_topk": oracle("""
WITH r AS (SELECT page_id, ord, CASE WHEN ord % 3 = 0 THEN 'paper' ELSE 'edge' END AS origin, area_ratio FROM {placed_candidates}),
k AS (SELECT page_id, ord, origin, row_number() OVER (PARTITION BY page_id, origin ORDER BY area_ratio DESC, ord) AS rank FROM r)
SELECT * FROM k WHERE rank <= CASE origin WHEN 'edge' THEN 3 ELSE 1 END"""),
    "candidate_union": oracle("""
WITH u AS (SELECT page_id, ord, list_position(['document', 'bookPage', 'openBookSpread'], kind) - 1 AS finder FROM {placed_candidates})
SELECT page_id, ord, finder, row_number() OVER (PARTITION BY page_id ORDER BY finder, ord) AS place FROM u"""),
    "split_spreads": oracle("""
WITH p AS (SELECT *, unnest(CASE WHEN kind = 'openBookSpread' AND spine_strength >= 0.35e0 AND two_page >= 0.35e0 AND aspect_ratio >= 1.15e0 THEN ['left', 'right'] ELSE ['whole'] END) AS part FROM {placed_candidates})
SELECT page_id, ord, part, floor(CASE WHEN part = 'whole' THEN area_ratio ELSE area_ratio / 2e0 END * 1e6 + 0.5e0) / 1e6 AS area FROM p"""),
    "component_best": oracle("""
WITH s AS (SELECT *, area_ratio*0.7e0 + least(1e0, greatest(0e0, paper))*0.2e0 + least(1e0, greatest(0e0, 1e0 - (greatest(aspect_ratio, 1e0/aspect_ratio) - 1e0)/7e0))*0.1e0 AS score
  FROM {placed_candidates} WHERE greatest(aspect_ratio, 1e0/aspect_ratio) <= 8)
SELECT page_id, ord, floor(score * 1e6 + 0.5e0) / 1e6 AS score FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, area_ratio DESC, ord) = 1"""),
    "component_largest": oracle("""
SELECT page_id, ord, floor(area_ratio * 1e6 + 0.5e0) / 1e6 AS area FROM {placed_candidates} WHERE area_ratio BETWEEN 0.02e0 AND 0.995e0
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area_ratio DESC, ord) = 1"""),
    "segmentation_confidence": oracle("SELECT page_id, ord, floor(least(1e0, greatest(0e0, paper*0.65e0 + edge*0.35e0)) * 1e6 + 0.5e0) / 1e6 AS confidence FROM {placed_candidates}"),
}
