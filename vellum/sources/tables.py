"""Tables and the views that project them into the shapes of scans.

Each view is one SQL text; {name} stands for a table or another view.  Where Spark and DuckDB differ, there are
two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")
#: A row's line number: no scan has to look beyond the row, and rows of a page may share it.
LINE = "CAST(l_linenumber AS BIGINT)"
#: A row's place within its page, which no other row of the page has: for choices, ranks and lists, at the price of a shuffle.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
PLACE = f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS BIGINT)"
#: The same place in Spark, where nulls would come first.
SPARK_PLACE = f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(f'{c} NULLS LAST' for c in ORDER)}) AS BIGINT)"


def share(column: str, steps: int, scale: float = 1.0, low: float = 0.0) -> str:
    """low to low + scale, in ``steps`` steps."""
    return f"{low}e0 + CAST({column} % {steps + 1} AS DOUBLE) / {float(steps)}e0 * {scale}e0"


CANDIDATES = f"""
SELECT l_orderkey AS page_id, {LINE} AS ord,
  CASE l_returnflag WHEN 'R' THEN 'document' WHEN 'N' THEN 'openBookSpread' ELSE 'bookPage' END AS kind,
  CASE l_linenumber % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'left' ELSE 'right' END AS side,
  l_partkey % 17 = 0 AS self_intersects,
  {share("l_partkey", 88)} AS base_score, {share("l_suppkey + l_partkey", 30, 0.9, 0.1)} AS area_ratio, {share("l_partkey", 13, 1.2, 0.6)} AS aspect_ratio,
  {share("l_suppkey", 9)} AS spine_strength, {share("l_partkey", 7)} AS spine_proximity, {share("l_partkey", 21)} AS text_density,
  {share("l_suppkey", 6, 0.5)} AS curvature, {share("l_partkey", 10)} AS two_page, {share("l_suppkey", 30, 0.3, 0.7)} AS containment,
  {share("l_partkey", 23, 0.24, 0.76)} AS envelope, {share("l_suppkey", 13, 0.6)} AS continuation, {share("l_partkey", 11)} AS outer_anchor,
  {share("l_suppkey", 17, 0.4)} AS overlap, l_quantity / 50e0 AS occupancy, {share("l_partkey", 31)} AS border, l_discount * 10e0 AS contrast,
  {share("l_partkey", 96)} AS paper, {share("l_suppkey", 14)} AS rect, {share("l_partkey", 26)} AS edge, {share("l_suppkey", 10, 0.85)} AS line_penalty,
  {share("l_partkey", 19, 0.5)} AS small_penalty, 0.4e0 + l_tax * 6e0 AS width_ratio, {share("l_partkey", 49, 0.6, 0.45)} AS height_ratio
FROM {{lineitem}}
"""
QUADS = f"""
SELECT l_orderkey AS page_id, {LINE} AS ord, l_quantity / 50e0 AS confidence, {share("l_suppkey", 10)} AS clipping, l_partkey % 3 = 0 AS stable,
  CAST(l_suppkey % 9 - 4 AS DOUBLE) * 6e0 AS jx, CAST(l_partkey % 9 - 4 AS DOUBLE) * 8e0 AS jy,
  CASE l_linenumber % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'left' ELSE 'right' END AS side, 1000 AS width, 1400 AS height,
  CAST(20 + l_partkey % 60 * (1 + l_suppkey % 5) AS DOUBLE) AS x0, CAST(20 + l_suppkey % 40 * (1 + l_partkey % 9) AS DOUBLE) AS y0,
  CAST(900 - l_partkey % 35 * (1 + l_suppkey % 11) AS DOUBLE) AS x1, CAST(25 + l_partkey % 30 AS DOUBLE) AS y1,
  CAST(950 - l_suppkey % 45 * (1 + l_partkey % 4) AS DOUBLE) AS x2, CAST(1300 - l_partkey % 55 * (1 + l_suppkey % 7) AS DOUBLE) AS y2,
  CAST(30 + l_suppkey % 25 AS DOUBLE) AS x3, CAST(1350 - l_partkey % 65 AS DOUBLE) AS y3
FROM {{lineitem}}
"""
EVIDENCE = f"""
SELECT l_orderkey AS page_id, {LINE} AS ord,
  CASE l_linenumber % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'right' WHEN 2 THEN 'bottom' ELSE 'left' END AS edge,
  CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'left' ELSE 'right' END AS side,
  {share("l_partkey", 24, 0.6)} AS transition, {share("l_suppkey", 16, 0.8)} AS support, {share("l_partkey", 12, 0.1)} AS border, {share("l_suppkey", 18, 0.7)} AS occlusion,
  {share("l_partkey", 28, 0.5, 0.5)} AS containment, {share("l_suppkey", 36, 1.2, 0.7)} AS expansion, {share("l_partkey", 33)} AS continuity, {share("l_suppkey", 22, 0.6, 0.4)} AS ownership,
  {share("l_partkey", 38, 0.9)} AS adjacent, {share("l_suppkey", 12)} AS envelope, l_partkey % 5 AS reliable_edges, l_suppkey % 4 <> 0 AS reliable, l_partkey % 23 = 0 AS partial_raw,
  l_partkey % 19 <> 0 AS has_corners, l_suppkey % 17 <> 0 AS in_bounds, l_partkey % 13 <> 0 AS convex,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {share("l_suppkey", 25)} END AS paper_score, l_discount * 2e0 AS requested,
  {share("l_partkey", 40, 0.016)} AS magnitude, {share("l_suppkey", 14, 0.6, 0.4)} AS confidence, {share("l_partkey", 15, 0.6, 0.4)} AS coverage, {share("l_suppkey", 21, 0.6, 0.4)} AS consistency,
  {share("l_suppkey", 20, 0.01)} AS contour, {share("l_partkey", 26, 0.01)} AS internal, l_partkey % 5 AS evidence, l_suppkey % 4 AS n_geometry, l_partkey % 3 AS n_internal, l_suppkey % 2 = 0 AS agree,
  l_partkey % 29 = 0 AS conflict, CAST(900 + l_partkey % 300 AS DOUBLE) AS before_w, CAST(1300 + l_suppkey % 90 AS DOUBLE) AS before_h,
  CAST(900 + l_partkey % 300 + l_suppkey % 31 - 15 AS DOUBLE) AS after_w, CAST(1300 + l_suppkey % 90 + l_partkey % 41 - 20 AS DOUBLE) AS after_h,
  {share("l_partkey", 21, 0.2, 0.8)} AS straight_before, {share("l_suppkey", 23, 0.2, 0.8)} AS straight_after, {share("l_partkey", 11, 0.04)} AS stretch
FROM {{lineitem}}
"""
SHEETS = """
SELECT vec_id AS page_id, CASE vec_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'left' ELSE 'right' END AS side, 1000 AS width, 1400 AS height,
  100e0 + CAST(vec_id % 5 AS DOUBLE) * 3e0 AS x0, 150e0 + CAST(vec_id % 4 AS DOUBLE) * 2e0 AS y0, 900e0 - CAST(vec_id % 7 AS DOUBLE) * 2e0 AS x1, 150e0 + CAST(vec_id % 6 AS DOUBLE) * 3e0 AS y1,
  900e0 + CAST(vec_id % 4 AS DOUBLE) * 5e0 AS x2, 1270e0 - CAST(vec_id % 5 AS DOUBLE) * 4e0 AS y2, 100e0 - CAST(vec_id % 3 AS DOUBLE) * 6e0 AS x3, 1270e0 + CAST(vec_id % 8 AS DOUBLE) * 2e0 AS y3
FROM {embeddings}
"""
# sixteen points along each edge of a sheet, moved outward or inward
OUTLINE = """
SELECT page_id, pos, o, CASE s WHEN 0 THEN 100e0 + t * 50e0 WHEN 1 THEN 900e0 + o WHEN 2 THEN 900e0 - t * 50e0 ELSE 100e0 - o END AS px,
  CASE s WHEN 0 THEN 150e0 - o WHEN 1 THEN 150e0 + t * 70e0 WHEN 2 THEN 1270e0 + o ELSE 1270e0 - t * 70e0 END AS py
FROM (SELECT vec_id AS page_id, x AS pos, CAST(floor(x / 16e0) AS INT) AS s, CAST(x % 16 AS DOUBLE) AS t, (mean - 128e0) * 0.4e0 AS o FROM (PROFILE) p) q
"""
# four curves of sixteen offsets: upper edge, lower edge, two lines of text
CURVES = """
SELECT vec_id AS page_id, CAST(floor(x / 16e0) AS INT) AS curve, x % 16 AS x, (mean - 128e0) * 0.2e0 + CAST(vec_id % 5 - 2 AS DOUBLE) * 1.5e0 AS off FROM (PROFILE) p
"""
VIEWS = {
    "evidence": EVIDENCE,
    "sheets": SHEETS,
    "candidates": CANDIDATES,
    "quads": QUADS,
    "placed_evidence": EVIDENCE.replace(LINE, PLACE),
    "placed_candidates": CANDIDATES.replace(LINE, PLACE),
    "placed_quads": QUADS.replace(LINE, PLACE),
    "scans": """
SELECT conv_id AS session_id, turn + 1 AS page_no, conv_id * 1000 + turn AS raw_key, (turn % 4) * 90 AS rotation, role AS side, text, length(text) AS byte_count
FROM {conversations}""",
    "signal": "SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos, value, event_type FROM {events}",
    "frames": """
SELECT user_id AS stream_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100 + (event_id % 5) * 40
  + CASE WHEN event_id % 23 = 0 THEN 900 ELSE 0 END AS t_ms, event_type <> 'error' AS detected, value / 100e0 AS confidence
FROM {events}""",
}
# masks of 64 by 32 pixels and pictures of 64 by 50: vectors one below the other, each a line; in SQL by pixel
SPARK_VIEWS = VIEWS | {name: text.replace(PLACE, SPARK_PLACE) for name, text in VIEWS.items() if name.startswith("placed_")} | {
    "shades": "SELECT vec_id div 50 AS mask, vec_id % 50 AS y, transform(embedding, v -> CAST(floor(128D + v * 200D) AS BIGINT)) AS shades FROM {embeddings}",
    "masks": "SELECT vec_id div 32 AS mask, vec_id % 32 AS y, transform(embedding, v -> v > 0.03D) AS pixels FROM {embeddings}",
    "profile": "SELECT vec_id, pos AS x, 128e0 + CAST(v AS DOUBLE) * 200e0 AS mean FROM {embeddings} LATERAL VIEW posexplode(embedding) p AS pos, v",
    "lines": r"SELECT doc_id, pos AS ord, raw FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) x AS pos, raw",
}
DUCKDB_VIEWS = VIEWS | {
    "shaded": "SELECT vec_id // 50 AS mask, vec_id % 50 AS y, unnest(range(len(embedding))) AS x, CAST(floor(128e0 + unnest(embedding)::DOUBLE * 200e0) AS BIGINT) AS v FROM {embeddings}",
    "pixels": "SELECT * FROM (SELECT vec_id // 32 AS mask, vec_id % 32 AS y, unnest(range(len(embedding))) AS x, unnest(embedding)::DOUBLE AS v FROM {embeddings}) p WHERE v > 0.03e0",
    "profile": "SELECT vec_id, unnest(range(len(embedding))) AS x, 128e0 + unnest(embedding)::DOUBLE * 200e0 AS mean FROM {embeddings}",
    "lines": "SELECT doc_id, unnest(range(len(ls))) AS ord, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents})",
}
for views in (SPARK_VIEWS, DUCKDB_VIEWS):
    views |= {"outline": OUTLINE.replace("PROFILE", views["profile"]), "curves": CURVES.replace("PROFILE", views["profile"])}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = SPARK_VIEWS[name]
    return spark.sql(text, **{t: table(spark, folder, t) for t in re.findall(r"\{(\w+)\}", text)})


def oracle(text: str) -> str:
    """DuckDB SQL with each {name} of a view as a common table expression."""
    known = re.compile(r"\{(" + "|".join([*DUCKDB_VIEWS, *TABLES]) + r")\}")
    names = [n for n in dict.fromkeys(known.findall(text)) if n in DUCKDB_VIEWS]
    body = known.sub(r"\1", text).strip()
    views = ", ".join(f"{n} AS ({known.sub(r'\1', DUCKDB_VIEWS[n]).strip()})" for n in names)
    if not views:
        return body
    for start in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(start):
            return f"{start} {views}, {body[len(start):].strip()}"
    return f"WITH {views} {body}"
