"""Prefix scans: results per row that depend on all rows before it, of its key, in order.

A scan over an associative operation need not run from the first row to the last.  Keys with many rows are cut into stretches,
each stretch is scanned on its own, what the stretches come to is scanned (some hundred rows a key), and each stretch is joined with
what lies before it.  So a key that holds a third of all rows is the work of many tasks.

Sums and maxima are such operations.  So are steps of a machine of few states: a row is a map of the states onto themselves, and maps
compose.  A queue is a sum and a maximum: a job ends at the sum of all services so far plus the largest lead that an arrival
had over the services before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Keys with more rows are cut, into so many stretches of about equal size.
LARGE, STRETCHES = 1_000_000, 128
#: Cut keys are few (at most a millionth of the rows); up to this number their cuts are broadcast.
BROADCAST_KEYS = 10_000


def stretched(rows: DataFrame, key: str, at: str, large: int | None = None) -> tuple[DataFrame, bool]:
    """(rows with _scan_stretch, whether any key is cut): stretches follow each other in ``at``, equal values share one.

    The cuts are approximate quantiles: they say where to cut, and no result depends on how exact they are.
    """
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_scan_n")).filter(F.col("_scan_n") > (LARGE if large is None else large)).select(F.col(key).alias("_scan_key"))
    number = many.count()
    if not number:
        return rows.withColumn("_scan_stretch", F.lit(0)), False
    if number <= BROADCAST_KEYS:
        many = F.broadcast(many)
    shares = F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)])
    cuts = rows.join(many, rows[key].eqNullSafe(many["_scan_key"])).groupBy("_scan_key").agg(F.array_distinct(F.percentile_approx(at, shares, 20 * STRETCHES)).alias("_scan_cuts"))
    if number <= BROADCAST_KEYS:
        cuts = F.broadcast(cuts)
    told = rows.join(cuts, rows[key].eqNullSafe(cuts["_scan_key"]), "left")
    stretch = F.coalesce(F.size(F.filter("_scan_cuts", lambda c: c < F.col(at))), F.lit(0))
    return told.withColumn("_scan_stretch", F.when(F.col("_scan_cuts").isNull(), 0).otherwise(stretch)).drop("_scan_key", "_scan_cuts"), True


def running(rows: DataFrame, key: str, order: list[str], value: Column, name: str, how: str = "sum", large: int | None = None) -> DataFrame:
    """rows with the sum or maximum of value over the rows of their key up to their own, in order.  Nulls count for nothing; a null key is a key."""
    add = {"sum": F.sum, "max": F.max}[how]
    cut, any_cut = stretched(rows.withColumn("_scan_value", value), key, order[0], large)
    local = cut.withColumn(name, add("_scan_value").over(W.partitionBy(key, "_scan_stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    if not any_cut:
        return local.drop("_scan_value", "_scan_stretch")
    totals = cut.groupBy(key, "_scan_stretch").agg(add("_scan_value").alias("_scan_total"))
    ahead = W.partitionBy(key).orderBy("_scan_stretch").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_scan_key"), F.col("_scan_stretch").alias("_scan_at"), add("_scan_total").over(ahead).alias("_scan_before"))
    joined = local.join(before, local[key].eqNullSafe(before["_scan_key"]) & (F.col("_scan_stretch") == F.col("_scan_at")))
    both = F.greatest(name, "_scan_before") if how == "max" else F.when(F.col("_scan_before").isNull(), F.col(name)).otherwise(F.coalesce(name, F.lit(0)) + F.col("_scan_before"))
    return joined.withColumn(name, both).drop("_scan_value", "_scan_stretch", "_scan_key", "_scan_at", "_scan_before", "_scan_total")


def queued(jobs: DataFrame, key: str, order: list[str], service: str, large: int | None = None) -> DataFrame:
    """jobs with start and end in a queue per key that takes one at a time, in the order of ``order``, the first of which is the time of arrival."""
    arrival = F.col(order[0])
    summed = running(jobs, key, order, F.col(service), "_served", "sum", large)
    led = running(summed, key, order, arrival - (F.col("_served") - F.col(service)), "_lead", "max", large)
    return led.withColumn("end", F.col("_served") + F.col("_lead")).withColumn("start", F.col("end") - F.col(service)).drop("_served", "_lead")


def in_hand(jobs: DataFrame, key: str, order: list[str], weight: str, large: int | None = None) -> DataFrame:
    """jobs with pending: the weights of the jobs, its own included, that have come and not ended when it comes.  One that ends at that moment has ended."""
    # a job that ends the moment it comes is never in hand
    weighs = F.when(F.col("end") > F.col(order[0]), F.col(weight)).otherwise(0)
    comes = jobs.withColumns({"_t": F.col(order[0]), "_comes": F.lit(1), "_weight": weighs})
    ends = jobs.withColumns({"_t": F.col("end"), "_comes": F.lit(0), "_weight": -weighs})
    both = running(comes.unionByName(ends), key, ["_t", "_comes", *order], F.col("_weight"), "pending", "sum", large)
    return both.filter("_comes = 1").drop("_t", "_comes", "_weight")


def packed(maps: np.ndarray) -> np.ndarray:
    """Maps of up to 15 states as one number each, four bits a state."""
    return (maps.astype(np.int64) << (4 * np.arange(maps.shape[1]))).sum(axis=1)


def composed(maps: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Of each row, the composition of the maps from the last head up to it: in rounds, each twice as far back as the one before."""
    place = np.arange(len(maps))
    reach = place - np.maximum.accumulate(np.where(heads, place, 0))
    far = 1
    while (reach >= far).any():
        at = np.flatnonzero(reach >= far)
        maps = maps.copy()
        maps[at] = np.take_along_axis(maps[at], maps[at - far], axis=1)
        far *= 2
    return maps


def stepped(rows: DataFrame, key: str, order: list[str], event: str, steps: list[list[int]], large: int | None = None) -> DataFrame:
    """rows with before and after: the states of a machine that starts each key in state 0; ``steps[state][event]`` is the next one.

    Events are whole numbers; others, and null, change nothing.  Fifteen states at most.
    """
    table = np.array(steps, np.int64)
    states, kinds = table.shape
    cut, _ = stretched(rows, key, order[0], large)
    wanted = [f"`{c}`" for c in rows.columns]
    schema = cut.select(*wanted, "_scan_stretch").schema
    identity = np.arange(states)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, identity
        for batch in batches:
            if not batch.num_rows:
                continue
            what = pc.fill_null(batch.column(event).cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            own = np.where(((what >= 0) & (what < kinds))[:, None], table.T[np.clip(what, 0, kinds - 1)], identity)
            names = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            stretch = batch.column("_scan_stretch").to_numpy(zero_copy_only=False)
            first = (batch.column(key)[0].as_py(), int(stretch[0]))
            heads = np.append(True, (names[1:] != names[:-1]) | (stretch[1:] != stretch[:-1]))
            if first == last:
                own[0] = own[0][carry]
            after = composed(own, heads)
            before = np.where(heads[:, None], identity, np.vstack([identity, after[:-1]]))
            if first == last:
                before[0] = carry
            last, carry = (batch.column(key)[-1].as_py(), int(stretch[-1])), after[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed(before)), pa.array(packed(after))], [*batch.schema.names, "_scan_before", "_scan_after"])

    out = StructType([*schema.fields]).add("_scan_before", LongType()).add("_scan_after", LongType())
    dealt = cut.select(*wanted, "_scan_stretch").repartition(key, "_scan_stretch").sortWithinPartitions(key, "_scan_stretch", *order)
    mapped = dealt.mapInArrow(scan, out)
    totals = mapped.groupBy(key, "_scan_stretch").agg(F.max_by("_scan_after", F.struct(*order)).alias("code"))
    per_key = totals.groupBy(F.col(key).alias("_scan_key")).agg(F.array_sort(F.collect_list(F.struct("_scan_stretch", "code"))).alias("parts"))
    # the state before each stretch of a key: some hundred at most
    begun = per_key.select("_scan_key", F.expr("""inline(aggregate(parts, named_struct('state', 0, 'done', CAST(array() AS ARRAY<STRUCT<_scan_at: INT, _scan_state: INT>>)), (a, p) -> named_struct(
        'state', CAST(shiftright(p.code, 4 * a.state) & 15 AS INT), 'done', array_append(a.done, named_struct('_scan_at', p._scan_stretch, '_scan_state', a.state))), a -> a.done))"""))
    joined = mapped.join(begun, mapped[key].eqNullSafe(begun["_scan_key"]) & (F.col("_scan_stretch") == F.col("_scan_at")))
    state = {name: F.expr(f"CAST(shiftright({code}, 4 * _scan_state) & 15 AS INT)") for name, code in (("before", "_scan_before"), ("after", "_scan_after"))}
    return joined.withColumns(state).select(*wanted, "before", "after")


#: Scan requests: states and events in order, and where each event leads; an event that leads nowhere is refused.
REQUEST_STATES = ("idle", "preparing", "active", "processing_result")
REQUEST_EVENTS = ("start", "ready", "result", "done", "failed")
REQUEST_STEPS = {("idle", "start"): "preparing", ("preparing", "ready"): "active", ("active", "result"): "processing_result", ("processing_result", "done"): "idle", **{(s, "failed"): "idle" for s in REQUEST_STATES[1:]}}
PAGE_LIMIT = 20


def scan_requests(events: DataFrame, key: str, order: list[str], event: str, pages: str, large: int | None = None) -> DataFrame:
    """events with state (after each), accepted, request (the number of the request that it belongs to; null while there is none) and
    taken: the pages of an accepted result, PAGE_LIMIT at most.  A refused event changes nothing; one that is unknown or null is refused."""
    names = F.array(*[F.lit(s) for s in REQUEST_STATES])
    which = F.array_position(F.array(*[F.lit(e) for e in REQUEST_EVENTS]), F.col(event)) - 1
    steps = [[REQUEST_STATES.index(REQUEST_STEPS.get((s, e), s)) for e in REQUEST_EVENTS] for s in REQUEST_STATES]
    told = stepped(events.withColumn("_event", which.cast("int")), key, order, "_event", steps, large)
    told = told.withColumn("accepted", F.col("before") != F.col("after"))
    begun = running(told, key, order, (F.col("accepted") & (F.col(event) == "start")).cast("long"), "_begun", "sum", large)
    busy = (F.col("before") > 0) | (F.col("after") > 0)
    taken = F.when(F.col("accepted") & (F.col(event) == "result"), F.least(F.greatest(pages, F.lit(0)), F.lit(PAGE_LIMIT)))
    return begun.withColumns({"state": names[F.col("after")], "request": F.when(busy, F.col("_begun")), "taken": F.coalesce(taken, F.lit(0)).cast("long")}).drop("_event", "_begun", "before", "after")
