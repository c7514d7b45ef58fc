"""Queries whose rows depend on all rows before them: requests, the queue of captures, throttling with analysis time."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import scans as O
from vellum.sources.tables import oracle, view
from vellum.streaming.throttle import throttle_batch


def captures(spark, d):
    """Captures of a camera with the time that each takes; every fifth is a spread of two pages, which take one turn together."""
    f = view(spark, d, "frames").select("stream_id", "t_ms", "event_id")
    pages = F.when(F.col("event_id") % 5 == 0, 2).otherwise(1).cast("long")
    return f.withColumns({"pages": pages, "work_ms": pages * (40 + F.col("event_id") * 37 % 120)})


def scan_requests(spark, d):
    """Requests to scan, one at a time: what each call and callback leads to, and the pages of each result."""
    e = view(spark, d, "signal")
    event = F.element_at(F.array(*[F.lit(x) for x in ("start", "ready", "result", "done", "start", "ready", "result", "done", "failed", "start", "cancel")]), (F.floor(F.col("value") * 7).cast("long") % 11 + 1).cast("int"))
    calls = e.select("series_id", "pos", event.alias("event"), (F.floor(F.col("value") * 3).cast("long") % 30).alias("pages"))
    return O.scan_requests(calls, "series_id", ["pos"], "event", "pages")


def processing_queue(spark, d):
    """Captures are processed one after the other: when each starts and ends, how long it waits, and the pages then in hand."""
    done = O.queued(captures(spark, d), "stream_id", ["t_ms", "event_id"], "work_ms")
    held = O.in_hand(done, "stream_id", ["t_ms", "event_id"], "pages")
    return held.select("stream_id", "event_id", "t_ms", "start", "end", (F.col("start") - F.col("t_ms")).alias("waited"), "pending")


def busy_throttle(spark, d):
    """Frames that are analysed: 250 ms at least after the start of the last one, and not before its analysis is over."""
    return throttle_batch(captures(spark, d).withColumn("work_ms", F.col("work_ms") * 4))


QUERIES = {f.__name__: f for f in (scan_requests, processing_queue, busy_throttle)}
CAPTURES = """c AS (SELECT stream_id, t_ms, event_id, (CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS pages, (CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END) * (40 + event_id * 37 % 120) AS work,
  row_number() OVER (PARTITION BY stream_id ORDER BY t_ms, event_id) AS n FROM {frames})"""
ORACLE = {
    "scan_requests": oracle("""WITH RECURSIVE e AS (SELECT series_id, pos, floor(value * 3)::BIGINT % 30 AS pages, ['start', 'ready', 'result', 'done', 'start', 'ready', 'result', 'done', 'failed', 'start', 'cancel'][floor(value * 7)::BIGINT % 11 + 1] AS event FROM {signal}),
r AS (SELECT series_id, 0::BIGINT AS pos, NULL::VARCHAR AS event, 'idle' AS state, false AS accepted, 0::BIGINT AS pages, 0::BIGINT AS begun, 'idle' AS was FROM e GROUP BY series_id
  UNION ALL SELECT series_id, pos, event, coalesce(next, state), next IS NOT NULL, pages, begun + CASE WHEN next = 'preparing' THEN 1 ELSE 0 END, state FROM (
    SELECT e.*, r.state, r.begun, CASE WHEN r.state = 'idle' AND e.event = 'start' THEN 'preparing' WHEN r.state = 'preparing' AND e.event = 'ready' THEN 'active' WHEN r.state = 'active' AND e.event = 'result' THEN 'processing_result'
      WHEN r.state = 'processing_result' AND e.event = 'done' OR r.state <> 'idle' AND e.event = 'failed' THEN 'idle' END AS next FROM r JOIN e ON e.series_id = r.series_id AND e.pos = r.pos + 1))
SELECT series_id, pos, event, pages, accepted, state, CASE WHEN state <> 'idle' OR was <> 'idle' THEN begun END AS request, CASE WHEN accepted AND event = 'result' THEN least(pages, 20) ELSE 0 END AS taken FROM r WHERE pos > 0"""),
    "processing_queue": oracle(f"""WITH RECURSIVE {CAPTURES}, q AS (SELECT *, t_ms AS start, t_ms + work AS "end" FROM c WHERE n = 1
  UNION ALL SELECT c.*, greatest(c.t_ms, q."end"), greatest(c.t_ms, q."end") + c.work FROM q JOIN c ON c.stream_id = q.stream_id AND c.n = q.n + 1)
SELECT a.stream_id, a.event_id, a.t_ms, a.start, a."end", a.start - a.t_ms AS waited, sum(b.pages)::BIGINT AS pending FROM q a JOIN q b ON b.stream_id = a.stream_id AND b.n <= a.n AND b."end" > a.t_ms GROUP BY ALL"""),
    "busy_throttle": oracle(f"""WITH RECURSIVE {CAPTURES}, f AS (SELECT stream_id, n, t_ms, event_id, t_ms + greatest(250, work * 4) AS free, true AS kept FROM c WHERE n = 1
  UNION ALL SELECT c.stream_id, c.n, c.t_ms, c.event_id, CASE WHEN c.t_ms >= free THEN c.t_ms + greatest(250, work * 4) ELSE free END, c.t_ms >= free FROM f JOIN c ON c.stream_id = f.stream_id AND c.n = f.n + 1)
SELECT stream_id, t_ms, event_id FROM f WHERE kept"""),
}
