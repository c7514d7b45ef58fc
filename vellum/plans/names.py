"""Queries over names that are taken and names that are given out."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import names as O
from vellum.sources.tables import oracle, view


def free_names(spark, d):
    """Names of newly corrected pages, beside the files that each session has already: gaps are filled first."""
    s = view(spark, d, "scans").select("session_id", "page_no", "raw_key", "byte_count", F.concat(F.lit("corrected_"), F.col("session_id").cast("string")).alias("stem"))
    had = s.filter("byte_count % 3 <> 0").withColumn("number", (F.col("byte_count") % 23 + 1).cast("long"))
    files = had.select("stem", O.numbered_name(F.col("stem"), F.col("number"), "png").alias("file"))
    taken = files.select("stem", O.number_of(F.col("file"), F.col("stem"), "png").alias("number")).filter("number IS NOT NULL")
    given = O.free_numbers(s.select("stem", "page_no", "raw_key"), taken, "stem", ["page_no"], "number")
    return given.select("raw_key", "number", O.numbered_name(F.col("stem"), F.col("number"), "png").alias("name"))


def free_raw_numbers(spark, d):
    """Numbers of new raw files from three on."""
    s = view(spark, d, "scans")
    taken = s.filter("raw_key % 3 <> 1").select("session_id", F.col("page_no").cast("long").alias("number"))
    return O.free_numbers(s.filter("raw_key % 2 = 0").select("session_id", "raw_key"), taken, "session_id", ["raw_key"], "number", 3).select("session_id", "raw_key", "number")


QUERIES = {f.__name__: f for f in (free_names, free_raw_numbers)}
ORACLE = {
    "free_names": oracle("""WITH t AS (SELECT DISTINCT session_id, byte_count % 23 + 1 AS n FROM {scans} WHERE byte_count % 3 <> 0), f AS (SELECT session_id, n, row_number() OVER (PARTITION BY session_id ORDER BY n) AS k
  FROM (SELECT DISTINCT session_id FROM {scans}) s, range(1, 200) r(n) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = s.session_id AND t.n = r.n)),
w AS (SELECT session_id, raw_key, row_number() OVER (PARTITION BY session_id ORDER BY page_no) AS k FROM {scans})
SELECT raw_key, n AS number, 'corrected_' || session_id || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.png' AS name FROM w JOIN f USING (session_id, k)"""),
    "free_raw_numbers": oracle("""WITH t AS (SELECT session_id, page_no AS n FROM {scans} WHERE raw_key % 3 <> 1), f AS (SELECT session_id, n, row_number() OVER (PARTITION BY session_id ORDER BY n) AS k
  FROM (SELECT DISTINCT session_id FROM {scans}) s, range(3, 200) r(n) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = s.session_id AND t.n = r.n)),
w AS (SELECT session_id, raw_key, row_number() OVER (PARTITION BY session_id ORDER BY raw_key) AS k FROM {scans} WHERE raw_key % 2 = 0)
SELECT session_id, raw_key, n AS number FROM w JOIN f USING (session_id, k)"""),
}
