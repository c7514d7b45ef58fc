"""Titles and names: queries over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.numbers import rounded
from vellum.operators.titles import best_titles, first_titles, recognised_lines
from vellum.sources.tables import oracle, table, view


def title_per_document(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "lines")
    return best_titles(lines, "doc_id")


def title_first_of_two(spark: SparkSession, d: str) -> DataFrame:
    scans = view(spark, d, "scans")
    lines = scans.filter("page_no <= 2").select("session_id", "page_no", F.posexplode(F.split("text", "\n")).alias("ord", "raw"))
    return first_titles(lines, "session_id", "page_no")


def boxed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as a text recogniser gives them: blocks of lines with boxes, some without, on pages 1000 high."""
    lines = view(spark, d, "lines")
    seven, eleven = (F.col("doc_id") * 3 + F.col("ord")) % 7, (F.col("doc_id") + F.col("ord") * 5) % 11
    top = F.col("ord") * 40 + (F.col("doc_id") * 13 + F.col("ord") * 29) % 300
    box = F.when(seven > 0, F.struct(F.lit(10).alias("left"), top.alias("top"), F.lit(900).alias("right"), (top + 20 + eleven * 25).alias("bottom")))
    line = F.struct(F.col("ord"), F.col("raw").alias("text"), box.alias("box"), F.when(eleven > 2, eleven / 11.0).alias("confidence"), F.when(seven == 1, "und").otherwise("ko").alias("language"))
    pages = lines.groupBy(F.col("doc_id").alias("page")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    height = F.when(F.col("page") % 9 == 0, 0).otherwise(1000)
    return pages.select("page", height.alias("source_height"), F.array(F.struct(F.lit("all").alias("text"), F.col("lines"))).alias("blocks"))


def recognised_text(spark: SparkSession, d: str) -> DataFrame:
    found = recognised_lines(boxed_lines(spark, d))
    return found.select("page", "ord", F.length("raw").alias("n"), "box_top", "box_height", rounded("confidence").alias("confidence"), "language")


def title_by_boxes(spark: SparkSession, d: str) -> DataFrame:
    return best_titles(recognised_lines(boxed_lines(spark, d)), "page")


def safe_file_names(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    name = F.concat(F.lit(" "), F.col("source"), F.lit(": "), F.substring_index("text", "\n", 1), F.when(F.col("doc_id") % 2 == 0, ".PDF ").otherwise("... "))
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("  ... ")).otherwise(name)
    return docs.select("doc_id", T.safe_file_name(name).alias("file_name"))


def default_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.default_name(F.col("ts")).alias("name"))


def stem_names(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    stem = T.safe_stem(F.substring("p_name", 1, 30))
    return parts.select("p_partkey", F.concat(stem, F.lit("_"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("_left.png")).alias("left_name"))


def language_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tag = F.when(F.col("doc_id") % 7 == 0, F.lit("und")).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("lang"))
    return docs.select("doc_id", T.language(tag).alias("tag"))


def safe_relative_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    start = F.element_at(F.array(*[F.lit(x) for x in ("", "/", "../", "a/./", "b/", "c//", "C:/", "d/../")]), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat(start, F.lit("raw_"), F.lpad(F.col("doc_id").cast("string"), 3, "0"), F.lit(".jpg"))
    return docs.select("doc_id", path.alias("path"), T.is_safe_path(path).alias("safe"))


# fixed values, written out for the comparison and not taken from the functions above
W = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def units(text: str) -> str:
    return f"(length({text}) + len(regexp_extract_all({text}, '{ASTRAL}')))"


def cut(text: str, n: int) -> str:
    """The longest start of at most n UTF-16 units."""
    return f"left({text}, (SELECT max(k) FROM range({n + 1}) r(k) WHERE {units(f'left({text}, k)')} <= {n}))"


def clean(text: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[. ]+$', ''), '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g')"""


def titles(keys: str, top: str = "least(ord / 20e0, 1e0)", height: str = "0e0", confidence: str = "0.5e0") -> str:
    return rf"""
n AS (SELECT *, regexp_replace(regexp_replace(raw, '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g') AS line FROM l0),
k AS (SELECT *, {units("line")} AS n, {top} AS top FROM n),
m AS (SELECT * FROM k WHERE n >= 2 AND regexp_matches(line, '[가-힣A-Za-z]') AND NOT regexp_matches(line, '^[0-9]+$')
  AND NOT regexp_matches(line, '^(?i:page{W}*)?[0-9]+(?:{W}*/{W}*[0-9]+)?$') AND NOT regexp_matches(line, '^[0-9]{{4}}[./년-]{W}*[0-9]{{1,2}}(?:[./월-]{W}*[0-9]{{1,2}}일?)?$')),
f AS (SELECT *, min(ord) OVER (PARTITION BY {keys}) AS first FROM m),
s AS (SELECT *, (1e0 - top) * 4e0 + {height} * 45e0 + CASE WHEN n BETWEEN 4 AND 36 THEN 1.4e0 WHEN n <= 50 THEN 0.7e0 ELSE 0.1e0 END + {confidence} * 0.4e0
  - CASE WHEN n > 40 OR regexp_matches(line, '[.!?。]$') THEN 0.8e0 ELSE 0e0 END AS score FROM f WHERE top <= 0.62e0 OR ord = first),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, ord) AS rank FROM s),
c AS (SELECT *, {cut("line", 51)} AS head FROM r WHERE rank = 1),
p AS (SELECT *, left(head, length(head) - strpos(reverse(head), ' ')) AS before FROM c),
u AS (SELECT *, CASE WHEN n <= 50 THEN line ELSE regexp_replace(CASE WHEN strpos(head, ' ') > 0 AND {units("before")} >= 25 THEN before ELSE {cut("line", 50)} END, '{W}+$', '') END AS short FROM p),
t AS (SELECT *, {clean("short")} AS title FROM u)
"""


BOXES = """l0 AS (SELECT page, ord, raw, e, CASE WHEN s > 0 THEN ord*40 + (page*13 + ord*29) % 300 END AS box, CASE WHEN e > 2 THEN e/11e0 END AS conf, CASE WHEN s <> 1 THEN 'ko' END AS language
  FROM (SELECT doc_id AS page, ord, raw, (doc_id*3 + ord) % 7 AS s, (doc_id + ord*5) % 11 AS e FROM {lines}) z)"""
QUERIES = {
    f.__name__: f for f in (title_per_document, title_first_of_two, recognised_text, title_by_boxes, safe_file_names, default_file_names, stem_names, language_tags, safe_relative_paths)
}
ORACLE = {
    "title_per_document": oracle("WITH l0 AS (SELECT * FROM {lines})," + titles("doc_id") + "SELECT doc_id, title, floor(score * 1e6 + 0.5e0) / 1e6 AS score FROM t"),
    "title_first_of_two": oracle(
        "WITH l0 AS (SELECT session_id, page_no, unnest(range(len(ls))) AS ord, unnest(ls) AS raw FROM (SELECT session_id, page_no, string_split(text, chr(10)) AS ls FROM {scans} WHERE page_no <= 2)),"
        + titles("session_id, page_no")
        + "SELECT session_id, arg_min(title, page_no) AS title, min(page_no) AS page_no FROM t WHERE title <> '' GROUP BY session_id"
    ),
    "recognised_text": oracle("WITH " + BOXES + """SELECT page, ord, length(raw) AS n, box::DOUBLE AS box_top, (20 + e*25)::DOUBLE + box - box AS box_height, floor(conf * 1e6 + 0.5e0) / 1e6 AS confidence, language FROM l0"""),
    "title_by_boxes": oracle("WITH " + BOXES + "," + titles("page", "CASE WHEN box IS NULL OR page % 9 = 0 THEN least(ord / 20e0, 1e0) ELSE least(box / 1000e0, 1e0) END", "CASE WHEN box IS NULL OR page % 9 = 0 THEN 0e0 ELSE least((20 + e*25) / 1000e0, 0.2e0) END", "coalesce(conf, 0.5e0)")
        + "SELECT page, title, floor(score * 1e6 + 0.5e0) / 1e6 AS score FROM t"),
    "safe_file_names": rf"""
WITH i AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ... ' ELSE ' ' || source || ': ' || split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN '.PDF ' ELSE '... ' END END AS v FROM documents),
a AS (SELECT doc_id, regexp_replace(v, '^{W}+|{W}+$', '', 'g') AS v FROM i),
b AS (SELECT doc_id, CASE WHEN lower(v) LIKE '%.pdf' THEN regexp_replace(left(v, length(v) - 4), '^{W}+|{W}+$', '', 'g') ELSE v END AS v FROM a),
c AS (SELECT doc_id, {clean("v")} AS v FROM b)
SELECT doc_id, CASE WHEN v = '' THEN NULL ELSE CASE WHEN {units("v")} > 120 THEN regexp_replace({cut("v", 120)}, '{W}+$', '') ELSE v END || '.pdf' END AS file_name FROM c""",
    "default_file_names": "SELECT event_id, 'Scan_' || strftime(ts, '%Y%m%d_%H%M') AS name FROM events",
    "stem_names": "SELECT p_partkey, regexp_replace(left(p_name, 30), '[^A-Za-z0-9_-]', '_', 'g') || '_' || lpad(p_partkey::VARCHAR, 7, '0') || '_left.png' AS left_name FROM part",
    "language_tags": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR trim(lang) IN ('', 'und') THEN NULL ELSE lang END AS tag FROM documents",
    "safe_relative_paths": """
SELECT doc_id, ['', '/', '../', 'a/./', 'b/', 'c//', 'C:/', 'd/../'][doc_id % 8 + 1] || 'raw_' || lpad(doc_id::VARCHAR, 3, '0') || '.jpg' AS path,
  doc_id % 8 IN (0, 4) AS safe FROM documents""",
}
