"""Queries over sessions and their ordered pages.  A conversation stands for a session, a turn for a page."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators import pages as O
from vellum.sources.tables import oracle, view


def scans(spark, d):
    return view(spark, d, "scans").select("session_id", "page_no", "raw_key", "rotation", "side", "byte_count")


def export_by_set(spark, d):
    """Selected pages in the order of the session."""
    chosen = scans(spark, d).filter("raw_key % 3 <> 0").select("raw_key")
    kept = scans(spark, d).join(chosen, "raw_key", "left_semi")
    place = F.row_number().over(W.partitionBy("session_id").orderBy("page_no"))
    return kept.select("session_id", "raw_key", place.cast("long").alias("place"))


def export_by_order(spark, d):
    """Pages in the order of a list of keys: unknown keys go, repeated ones stay."""
    s = scans(spark, d)
    wish = s.groupBy("session_id").agg(F.reverse(F.array_sort(F.collect_list("raw_key"))).alias("keys"))
    wish = wish.select("session_id", F.posexplode(F.concat("keys", F.array(F.lit(-1)), F.slice("keys", 1, 1))).alias("pos", "raw_key"))
    return O.in_given_order(s, wish, "session_id", "raw_key", "pos").select("session_id", "raw_key", "page_no", "place")


def unreferenced_files(spark, d):
    """Files of removed pages that no remaining page refers to, whatever the case of their names."""
    s = scans(spark, d).withColumns({"raw": F.concat(F.lit("RAW_"), "raw_key"), "original": F.concat(F.lit("src_"), F.col("session_id")), "edited": F.when(F.col("page_no") % 3 == 0, F.concat(F.lit("Edit_"), "raw_key"))})
    gone, left = s.filter("page_no % 2 = 0"), s.filter("page_no % 2 = 1")
    return O.unreferenced(gone, left, "raw", "original", "edited")


def renumber_after_delete(spark, d):
    return O.renumbered(scans(spark, d).filter("raw_key % 4 <> 1"), "session_id", F.col("page_no")).select("session_id", "raw_key", "place")


def reorder_pages(spark, d):
    """The second page of each session moved to the fourth place, or to the end of a shorter one."""
    s = scans(spark, d).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("session_id")))
    moved = O.moved(s.filter("n >= 2"), "session_id", "page_no", F.lit(2), F.least(F.lit(4), F.col("n")))
    return moved.select("session_id", "raw_key", "place")


def replace_range(spark, d):
    """Pages two and three of each session replaced by three new ones."""
    s = scans(spark, d)
    heads = s.filter("page_no = 2").select("session_id", "raw_key", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sub"))
    new = heads.select("session_id", (-F.col("raw_key") * 10 - F.col("sub")).alias("raw_key"), F.lit(2).cast("long").alias("anchor"), (F.col("sub") + 1).alias("sub"))
    old = s.filter("page_no NOT IN (2, 3)").select("session_id", "raw_key", F.col("page_no").alias("anchor"), F.lit(0).alias("sub"))
    return O.renumbered(old.unionByName(new), "session_id", F.struct("anchor", "sub")).select("session_id", "raw_key", "place")


def preserve_order(spark, d):
    """Pages of one role replaced, together, by two new ones where the first of them was; sessions without such pages stay."""
    s = scans(spark, d)
    old = s.filter("side = 'assistant'")
    new = s.select("session_id").distinct().select("session_id", F.explode(F.array(F.lit(-1), F.lit(-2))).alias("k")).select("session_id", (F.col("k").cast("long") - F.col("session_id") * 10).alias("raw_key"))
    new = new.withColumn("sub", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("raw_key"))))
    return O.block_replaced(s, old, new, "session_id", "raw_key", "page_no").select("session_id", "raw_key", "place")


def preserve_selection(spark, d):
    """The selection after a change: old keys go, and if any was selected the new ones come."""
    s = scans(spark, d).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("raw_key") % 3 != 0, F.col("raw_key")))).alias("selected"), F.array_sort(F.collect_list(F.when(F.col("page_no") <= 2, F.col("raw_key")))).alias("old")
    )
    new = F.array((-F.col("session_id")).cast("long"))
    after = F.when(F.arrays_overlap("selected", "old"), F.array_union(F.array_except("selected", "old"), new)).otherwise(F.array_except("selected", "old"))
    return s.select("session_id", F.explode(after).alias("raw_key"))


def toggle_selection(spark, d):
    """Select all, or none if all were; and one page toggled."""
    s = scans(spark, d).withColumn("selected", F.col("raw_key") % 5 != 0)
    all_ = F.min("selected").over(W.partitionBy("session_id"))
    return s.select("session_id", "raw_key", (~all_).alias("all_toggled"), F.when(F.col("page_no") == 2, ~F.col("selected")).otherwise(F.col("selected")).alias("one_toggled"))


def spread_explode(spark, d):
    """Every third page as the left and right half that it holds, all pages numbered anew."""
    s = scans(spark, d)
    halves = F.when(F.col("page_no") % 3 == 0, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit(None).cast("string")))
    parts = s.select("session_id", "raw_key", "page_no", F.posexplode(halves).alias("sub", "half"))
    return O.renumbered(parts, "session_id", F.struct("page_no", "sub")).select("session_id", "raw_key", "half", "place")


def spread_restore(spark, d):
    """Halves back to the page that they came from: the first number, and the rotation of the first half."""
    s = scans(spark, d).withColumn("parent", F.floor((F.col("page_no") - 1) / 2))
    return s.groupBy("session_id", "parent").agg(F.min("page_no").alias("page_no"), F.min_by("rotation", "page_no").alias("rotation"), F.count(F.lit(1)).alias("halves"))


def spread_siblings(spark, d):
    s = scans(spark, d).withColumn("parent", F.floor((F.col("page_no") - 1) / 2))
    w = W.partitionBy("session_id", "parent").orderBy("page_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return s.select("session_id", "raw_key", F.first("raw_key").over(w).alias("first_half"), F.last("raw_key").over(w).alias("last_half"))


def display_paths(spark, d):
    s = scans(spark, d)
    raw, corrected = F.concat(F.lit("raw_"), "raw_key"), F.when(F.col("raw_key") % 3 != 0, F.concat(F.lit("cor_"), "raw_key"))
    enhanced, edited = F.when(F.col("raw_key") % 4 != 0, F.concat(F.lit("enh_"), "raw_key")), F.when(F.col("raw_key") % 5 == 0, F.concat(F.lit("edit_"), "raw_key"))
    path = O.display_path(F.col("side") == "user", F.col("page_no") % 2 == 0, F.col("page_no") % 5 != 3, raw, corrected, enhanced, edited)
    return s.select("raw_key", path.alias("path"))


def unique_names(spark, d):
    """The first free of base, base_2, base_3 and so on."""
    s = scans(spark, d)
    return s.select("raw_key", O.unique_name(F.concat(F.lit("corrected_"), "session_id"), W.partitionBy("session_id").orderBy("page_no"), "png").alias("name"))


def next_raw_index(spark, d):
    """The first number from three on that no file of the session has."""
    s = scans(spark, d).filter("raw_key % 3 <> 1")
    return O.first_free(s, "session_id", "page_no", 3)


def session_validity(spark, d):
    """One invalid page rejects its whole session."""
    s = scans(spark, d)
    ok = (F.col("byte_count") >= 30) & F.col("rotation").isin(0, 90, 180, 270) & (F.col("page_no") >= 1)
    return s.groupBy("session_id").agg(F.every(ok).alias("valid"), F.count(F.lit(1)).alias("pages"), F.min(F.when(~ok, F.col("page_no"))).alias("first_invalid"))


def session_json(spark, d):
    """Sessions written as nested JSON and read back: only whole ones come back."""
    s = scans(spark, d)
    docs = O.to_json(s.select("session_id", "page_no", "raw_key", "rotation"), "session_id", "page_no")
    text = F.when(F.col("session_id") % 9 == 0, F.regexp_replace("json", '"rotation":0', '"rotation":45')).otherwise(F.col("json"))
    return O.from_json(docs.withColumn("json", text), "session_id").select("session_id", "page_no", "raw_key", "rotation")


def recoverable_sessions(spark, d):
    """Sessions by their metadata, else by their raw files, the newest first."""
    s = scans(spark, d)
    meta = s.filter("session_id % 3 <> 0").groupBy("session_id").agg(F.max("raw_key").alias("created"), F.count(F.lit(1)).alias("pages"))
    files = s.withColumn("name", F.concat(F.when(F.col("page_no") % 4 == 0, "tmp_").otherwise("raw_"), F.lpad(F.col("page_no").cast("string"), 3, "0"), F.lit(".jpg")))
    raw = O.recovered(files, "session_id", "name", F.col("raw_key"))
    both = O.meta_or_raw(meta, raw, "session_id")
    return O.numbered(both, "created", "session_id", "place")


def recovery_status(spark, d):
    """States after a restart: what was running has failed, and so has what is done but has no file."""
    s = scans(spark, d)
    files = s.filter("raw_key % 3 <> 0").select(F.col("raw_key").alias("has_file"))
    state = F.element_at(F.array(*[F.lit(x) for x in ("none", "processing", "completed", "failed")]), (F.col("page_no") % 4 + 1).cast("int"))
    joined = s.withColumn("state", state).join(files, F.col("raw_key") == F.col("has_file"), "left")
    return joined.select("raw_key", O.recovered_state(F.col("state"), F.col("has_file").isNotNull()).alias("state"))


def retake_pages(spark, d):
    """A retaken picture replaces the old one only where it succeeded; fields that a change leaves null keep their value."""
    s = scans(spark, d)
    new = s.filter("raw_key % 2 = 0").select("raw_key", (F.col("raw_key") + 1_000_000).alias("new_key"), F.when(F.col("rotation") > 90, F.lit(0)).alias("new_rotation"), (F.col("raw_key") % 3 != 0).alias("ok"))
    j = s.join(new, "raw_key", "left")
    done = F.coalesce("ok", F.lit(False))
    return j.select("raw_key", F.when(done, F.coalesce("new_key", "raw_key")).otherwise(F.col("raw_key")).alias("shown"), F.when(done, F.coalesce(F.col("new_rotation"), F.col("rotation"))).otherwise(F.col("rotation")).cast("int").alias("rotation"))


def session_fold(spark, d):
    """The state of each user after all events: the last value of each field that an event set."""
    e = view(spark, d, "signal")
    last = {f"last_{k}": F.max_by("value", F.when(F.col("event_type") == k, F.col("pos"))) for k in ("click", "view", "purchase")}
    return e.groupBy("series_id").agg(F.count(F.lit(1)).alias("events"), *[v.alias(k) for k, v in last.items()])


def illegal_transitions(spark, d):
    """Steps that the order idle, preparing, active, processing does not allow."""
    e = view(spark, d, "signal").withColumn("state", F.length("event_type").cast("long") % 4)
    before = F.lag("state").over(W.partitionBy("series_id").orderBy("pos"))
    legal = (F.col("state") == (F.col("before") + 1) % 4) | (F.col("state") == 0)
    return e.withColumn("before", before).filter(F.col("before").isNotNull() & ~legal).groupBy("before", "state").agg(F.count(F.lit(1)).alias("n"))


def deletion_sets(spark, d):
    """Files to delete with a page: those it names and those named after it, each once."""
    s = scans(spark, d)
    named = s.select("raw_key", F.explode(F.array(F.concat(F.lit("raw_"), "raw_key"), F.concat(F.lit("corrected_"), "raw_key"))).alias("file"))
    found = scans(spark, d).select("session_id", F.concat(F.lit("corrected_"), "raw_key").alias("file")).filter(F.col("file").rlike("^corrected_[0-9]+$"))
    own = s.select("session_id", "raw_key").join(found, "session_id").filter(F.col("file") == F.concat(F.lit("corrected_"), F.col("raw_key"))).select("raw_key", "file")
    return named.unionByName(own).distinct()


def pdf_validity(spark, d):
    """Which of the files that stand for exported documents are PDF files: by their size and first bytes."""
    s = view(spark, d, "scans")
    start = F.element_at(F.array(*[F.lit(x) for x in ("%PDF-1.4 ", "%PDF-", "%PDF", " %PDF-1.7", "")]), (F.col("raw_key") % 5 + 1).cast("int"))
    content = F.concat(start, F.when(F.col("page_no") % 2 == 0, F.col("text")).otherwise(""))
    files = s.select(F.col("raw_key").cast("string").alias("path"), F.octet_length(content).alias("length"), F.encode(content, "UTF-8").alias("content"))
    return O.valid_pdf(files)


def raw_file_matches(spark, d):
    """Files that belong to a page by the start of their name."""
    s = scans(spark, d)
    pages = s.select("session_id", "page_no", F.concat(F.lit("raw_"), F.lpad(F.col("page_no").cast("string"), 3, "0")).alias("stem"))
    files = s.select("session_id", F.concat(F.lit("raw_"), F.lpad(F.col("page_no").cast("string"), 3, "0"), F.when(F.col("raw_key") % 2 == 0, "_b.jpg").otherwise(".jpg")).alias("file"))
    # every file name starts with a stem of seven characters: an equality, not a scan of all pairs
    return pages.join(files.withColumn("stem", F.substring("file", 1, 7)), ["session_id", "stem"]).select("session_id", "page_no", "file")


def stage_reports(spark, d):
    """A report of all stages of a series, one column a stage."""
    e = view(spark, d, "signal")
    kinds = ("click", "error", "purchase", "signup", "view")
    return e.groupBy("series_id").pivot("event_type", list(kinds)).agg(F.count(F.lit(1))).select("series_id", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds])


def log_records(spark, d):
    """Lines of a diagnostics log taken apart: category, route and one value."""
    e = view(spark, d, "signal")
    line = F.concat(F.lit("[2026-01-01T00:00:00][scan] route="), "event_type", F.lit(" pos="), "pos", F.lit(" value="), F.floor("value").cast("string"))
    pairs = F.str_to_map(F.regexp_extract("line", r"\] (.*)$", 1), F.lit(" "), F.lit("="))
    return e.select("series_id", line.alias("line")).select("series_id", F.regexp_extract("line", r"^\[[^\]]*\]\[([^\]]*)\]", 1).alias("category"), pairs["route"].alias("route"), pairs["pos"].cast("int").alias("pos"), pairs["value"].cast("int").alias("value"))


SCANS = "s AS (SELECT session_id, page_no, raw_key, rotation, side, byte_count FROM {scans})"
QUERIES = {
    f.__name__: f
    for f in (
        export_by_set, export_by_order, unreferenced_files, renumber_after_delete, reorder_pages, replace_range, preserve_order, preserve_selection, toggle_selection, spread_explode, spread_restore,
        spread_siblings, display_paths, unique_names, next_raw_index, session_validity, session_json, recoverable_sessions, recovery_status, retake_pages, session_fold, illegal_transitions, deletion_sets,
        pdf_validity, raw_file_matches, stage_reports, log_records,
    )
}
ORACLE = {
    "export_by_set": oracle("SELECT session_id, raw_key, row_number() OVER (PARTITION BY session_id ORDER BY page_no) AS place FROM {scans} WHERE raw_key % 3 <> 0"),
    "export_by_order": oracle(f"""WITH {SCANS}, k AS (SELECT session_id, list(raw_key ORDER BY raw_key DESC) AS ks FROM s GROUP BY session_id),
w AS (SELECT session_id, unnest(list_concat(ks, [-1], [ks[1]])) AS raw_key, unnest(range(len(ks) + 2)) AS pos FROM k)
SELECT session_id, raw_key, page_no, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS place FROM w JOIN s USING (session_id, raw_key)"""),
    "unreferenced_files": oracle("""WITH f AS (SELECT page_no, unnest(['RAW_' || raw_key, 'src_' || session_id, CASE WHEN page_no % 3 = 0 THEN 'Edit_' || raw_key END]) AS file FROM {scans})
SELECT DISTINCT file FROM f WHERE page_no % 2 = 0 AND file IS NOT NULL AND lower(file) NOT IN (SELECT lower(file) FROM f WHERE page_no % 2 = 1 AND file IS NOT NULL)"""),
    "renumber_after_delete": oracle("SELECT session_id, raw_key, row_number() OVER (PARTITION BY session_id ORDER BY page_no) AS place FROM {scans} WHERE raw_key % 4 <> 1"),
    "reorder_pages": oracle(f"""WITH {SCANS}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM s),
r AS (SELECT *, CASE WHEN page_no = 2 THEN least(4, n) ELSE CASE WHEN page_no > 2 THEN page_no - 1 ELSE page_no END END AS spot FROM n WHERE n >= 2)
SELECT session_id, raw_key, CASE WHEN page_no = 2 THEN spot WHEN spot >= least(4, n) THEN spot + 1 ELSE spot END AS place FROM r"""),
    "replace_range": oracle(f"""WITH {SCANS}, u AS (SELECT session_id, raw_key, page_no AS anchor, 0 AS sub FROM s WHERE page_no NOT IN (2, 3)
  UNION ALL SELECT session_id, -raw_key*10 - k, 2, k + 1 FROM s, range(3) r(k) WHERE page_no = 2)
SELECT session_id, raw_key, row_number() OVER (PARTITION BY session_id ORDER BY anchor, sub) AS place FROM u"""),
    "preserve_order": oracle(f"""WITH {SCANS}, a AS (SELECT session_id, min(page_no) AS anchor FROM s WHERE side = 'assistant' GROUP BY session_id),
u AS (SELECT session_id, raw_key, page_no AS anchor, 0 AS sub FROM s WHERE side <> 'assistant' UNION ALL SELECT session_id, -k - session_id*10, anchor, k FROM a, (VALUES (1), (2)) v(k))
SELECT session_id, raw_key, row_number() OVER (PARTITION BY session_id ORDER BY anchor, sub) AS place FROM u"""),
    "preserve_selection": oracle(f"""WITH {SCANS}, h AS (SELECT session_id, bool_or(raw_key % 3 <> 0 AND page_no <= 2) AS hit FROM s GROUP BY session_id)
SELECT session_id, raw_key FROM s WHERE raw_key % 3 <> 0 AND page_no > 2 UNION ALL SELECT session_id, -session_id FROM h WHERE hit"""),
    "toggle_selection": oracle("SELECT session_id, raw_key, NOT bool_and(raw_key % 5 <> 0) OVER (PARTITION BY session_id) AS all_toggled, (raw_key % 5 <> 0) <> (page_no = 2) AS one_toggled FROM {scans}"),
    "spread_explode": oracle("""WITH p AS (SELECT session_id, raw_key, page_no, unnest(CASE WHEN page_no % 3 = 0 THEN ['left', 'right'] ELSE [NULL] END) AS half FROM {scans})
SELECT session_id, raw_key, half, row_number() OVER (PARTITION BY session_id ORDER BY page_no, half) AS place FROM p"""),
    "spread_restore": oracle("SELECT session_id, (page_no - 1) // 2 AS parent, min(page_no) AS page_no, arg_min(rotation, page_no) AS rotation, count(*) AS halves FROM {scans} GROUP BY 1, 2"),
    "spread_siblings": oracle("SELECT session_id, raw_key, min(raw_key) OVER w AS first_half, max(raw_key) OVER w AS last_half FROM {scans} WINDOW w AS (PARTITION BY session_id, (page_no - 1) // 2)"),
    "display_paths": oracle("""SELECT raw_key, CASE WHEN side = 'user' THEN CASE WHEN raw_key % 5 = 0 THEN 'edit_' ELSE 'raw_' END WHEN page_no % 2 <> 0 AND page_no % 5 <> 3 AND raw_key % 4 <> 0 THEN 'enh_'
  WHEN raw_key % 3 <> 0 THEN 'cor_' ELSE 'raw_' END || raw_key AS path FROM {scans}"""),
    "unique_names": oracle("SELECT raw_key, 'corrected_' || session_id || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END || '.png' AS name FROM {scans} WINDOW w AS (PARTITION BY session_id ORDER BY page_no)"),
    "next_raw_index": oracle("""WITH s AS (SELECT session_id, page_no FROM {scans} WHERE raw_key % 3 <> 1), c AS (SELECT session_id, 3 AS page_no FROM s UNION SELECT session_id, page_no + 1 FROM s WHERE page_no >= 3)
SELECT session_id, min(page_no) AS free FROM c WHERE (session_id, page_no) NOT IN (SELECT (session_id, page_no) FROM s) GROUP BY session_id"""),
    "session_validity": oracle("""SELECT session_id, bool_and(byte_count >= 30 AND rotation IN (0, 90, 180, 270) AND page_no >= 1) AS valid, count(*) AS pages, min(page_no) FILTER (byte_count < 30) AS first_invalid FROM {scans} GROUP BY session_id"""),
    "session_json": oracle("""WITH b AS (SELECT session_id FROM {scans} GROUP BY session_id HAVING NOT (session_id % 9 = 0 AND bool_or(rotation = 0)))
SELECT session_id, page_no, raw_key, rotation FROM {scans} SEMI JOIN b USING (session_id)"""),
    "recoverable_sessions": oracle("""WITH r AS (SELECT session_id, CASE WHEN session_id % 3 <> 0 THEN max(raw_key) ELSE coalesce(min(raw_key) FILTER (page_no % 4 <> 0), 0) END AS created,
  CASE WHEN session_id % 3 <> 0 THEN count(*) ELSE count(*) FILTER (page_no % 4 <> 0) END AS pages FROM {scans} GROUP BY session_id)
SELECT *, row_number() OVER (ORDER BY created DESC, session_id) AS place FROM r"""),
    "recovery_status": oracle("""SELECT raw_key, CASE page_no % 4 WHEN 0 THEN 'none' WHEN 2 THEN CASE WHEN raw_key % 3 <> 0 THEN 'completed' ELSE 'failed' END ELSE 'failed' END AS state FROM {scans}"""),
    "retake_pages": oracle("""SELECT raw_key, CASE WHEN raw_key % 2 = 0 AND raw_key % 3 <> 0 THEN raw_key + 1000000 ELSE raw_key END AS shown,
  CASE WHEN raw_key % 2 = 0 AND raw_key % 3 <> 0 AND rotation > 90 THEN 0 ELSE rotation END::INTEGER AS rotation FROM {scans}"""),
    "session_fold": oracle("""SELECT series_id, count(*) AS events, arg_max(value, pos) FILTER (event_type = 'click') AS last_click, arg_max(value, pos) FILTER (event_type = 'view') AS last_view,
  arg_max(value, pos) FILTER (event_type = 'purchase') AS last_purchase FROM {signal} GROUP BY series_id"""),
    "illegal_transitions": oracle("""WITH t AS (SELECT series_id, length(event_type) % 4 AS state, lag(length(event_type) % 4) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM {signal})
SELECT before, state, count(*) AS n FROM t WHERE before IS NOT NULL AND state <> (before + 1) % 4 AND state <> 0 GROUP BY before, state"""),
    "deletion_sets": oracle("SELECT raw_key, unnest(['raw_' || raw_key, 'corrected_' || raw_key]) AS file FROM {scans}"),
    "pdf_validity": oracle("""SELECT raw_key::VARCHAR AS path, CASE raw_key % 5 WHEN 0 THEN true WHEN 1 THEN page_no % 2 = 0 AND strlen(text) >= 3 WHEN 2 THEN page_no % 2 = 0 AND text LIKE '-%' AND strlen(text) >= 4
  WHEN 4 THEN page_no % 2 = 0 AND text LIKE '\x25PDF-%' AND strlen(text) >= 8 ELSE false END AS valid FROM {scans}""".replace("\\x25", "%")),
    "raw_file_matches": oracle("SELECT session_id, page_no, 'raw_' || lpad(page_no::VARCHAR, 3, '0') || CASE WHEN raw_key % 2 = 0 THEN '_b.jpg' ELSE '.jpg' END AS file FROM {scans}"),
    "stage_reports": oracle("SELECT series_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM {signal} GROUP BY series_id"),
    "log_records": oracle("SELECT series_id, 'scan' AS category, event_type AS route, pos::INTEGER AS pos, floor(value)::INTEGER AS value FROM {signal}"),
}
