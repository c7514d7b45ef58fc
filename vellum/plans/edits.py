"""Queries over logs of edits: a user's events stand for edits of a session, four users share one."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import edits as O
from vellum.sources.tables import oracle, table, view

OPS = ("add", "remove", "replace", "replace_range", "replace_named", "reorder", "rotate", "label", "add", "rotate", "odd")


def edit_log(spark, d):
    v = F.floor(F.col("value") * 100).cast("long")
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (v % len(OPS) + 1).cast("int"))
    session = F.floor(F.col("user_id") / 4).cast("long")
    brought = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 3 + 1).cast("int")), lambda k: -(F.col("event_id") * 10 + k))
    return table(spark, d, "events").select(
        session.alias("session_id"), F.col("event_id").alias("seq"), op.alias("op"), (v % 7 - F.when(v % 41 == 0, 1).otherwise(0)).cast("int").alias("index"), (v % 4).cast("int").alias("other"),
        F.array(session * 1000 + v % 5, session * 1000 + v % 3, -(F.col("event_id") - v % 9) * 10 - 1).alias("named"), F.when(op.isin("remove", "reorder", "rotate", "label", "odd"), F.array().cast("array<bigint>")).otherwise(brought).alias("brought"),
        F.when(v % 13 != 0, F.concat(F.lit("title "), v)).alias("text"),
    )


def pages_of(spark, d):
    return view(spark, d, "scans").select("session_id", "page_no", "raw_key", "rotation")


def edit_decisions(spark, d):
    """Which edits of each log are carried out and which are refused."""
    return O.decisions(O.folded(pages_of(spark, d), edit_log(spark, d), "session_id", "page_no", "raw_key"), "session_id")


def edited_sessions(spark, d):
    """The pages of each session after all edits of its log."""
    pages, edits = pages_of(spark, d), edit_log(spark, d)
    return O.pages_left(O.folded(pages, edits, "session_id", "page_no", "raw_key"), pages, edits, "session_id", "page_no", "raw_key", "rotation")


QUERIES = {f.__name__: f for f in (edit_decisions, edited_sessions)}
LOG = """v AS (SELECT user_id // 4 AS session_id, event_id AS seq, floor(value * 100)::BIGINT AS v FROM {events}),
e AS (SELECT session_id, seq, [%s][v %% 11 + 1] AS op, v %% 7 - CASE WHEN v %% 41 = 0 THEN 1 ELSE 0 END AS i, v %% 4 AS j, [session_id*1000 + v %% 5, session_id*1000 + v %% 3, -(seq - v %% 9)*10 - 1] AS named,
  list_transform(range(1, seq %% 3 + 2), lambda k: {'raw': -(seq*10 + k), 'turn': 0::BIGINT, 'label': NULL::VARCHAR}) AS new, CASE WHEN v %% 13 <> 0 THEN 'title ' || v END AS text, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM v),
b AS (SELECT session_id, list({'raw': raw_key, 'turn': rotation::BIGINT, 'label': NULL::VARCHAR} ORDER BY page_no) AS l FROM {scans} GROUP BY session_id),
r AS (SELECT coalesce(b.session_id, k.session_id) AS session_id, 0::BIGINT AS n, 0::BIGINT AS seq, false AS ok, coalesce(l, []) AS l FROM b FULL JOIN (SELECT DISTINCT session_id FROM e) k ON k.session_id = b.session_id
  UNION ALL SELECT session_id, n, seq, ok, CASE WHEN NOT ok THEN l WHEN op = 'add' THEN l || new WHEN op = 'remove' THEN l[1:i] || l[i + 2:] WHEN op = 'replace' THEN l[1:i] || new || l[i + 2:]
      WHEN op = 'replace_range' THEN l[1:i] || new || l[i + j + 1:] WHEN op = 'reorder' THEN g[1:j] || [l[i + 1]] || g[j + 1:] WHEN op = 'replace_named' THEN h[1:p - 1] || new || h[p:]
      WHEN op = 'rotate' THEN l[1:i] || [{'raw': l[i + 1].raw, 'turn': (l[i + 1].turn + 90) %% 360, 'label': l[i + 1].label}] || l[i + 2:]
      ELSE l[1:i] || [{'raw': l[i + 1].raw, 'turn': l[i + 1].turn, 'label': coalesce(text, l[i + 1].label)}] || l[i + 2:] END FROM (
    SELECT r.session_id, e.n, e.seq, r.l, op, i, j, new, text, l[1:i] || l[i + 2:] AS g, list_filter(l, lambda x: NOT list_contains(named, x.raw)) AS h, list_position(list_transform(l, lambda x: list_contains(named, x.raw)), true) AS p,
      CASE op WHEN 'add' THEN true WHEN 'odd' THEN false WHEN 'replace_named' THEN len(list_filter(l, lambda x: list_contains(named, x.raw))) > 0 WHEN 'replace_range' THEN i >= 0 AND i + j <= len(l)
        WHEN 'reorder' THEN i >= 0 AND i < len(l) AND j < len(l) ELSE i >= 0 AND i < len(l) END AS ok FROM r JOIN e ON e.session_id = r.session_id AND e.n = r.n + 1))""" % ", ".join(f"'{o}'" for o in OPS)
ORACLE = {
    "edit_decisions": oracle(f"WITH RECURSIVE {LOG} SELECT session_id, seq, ok AS accepted FROM r WHERE n > 0"),
    "edited_sessions": oracle(f"""WITH RECURSIVE {LOG}, z AS (SELECT session_id, arg_max(l, n) AS l FROM r GROUP BY session_id), u AS (SELECT session_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS page_no FROM z)
SELECT session_id, page_no::INTEGER AS page_no, x.raw AS raw_key, x.turn::INTEGER AS rotation, x.label AS label FROM u"""),
}
