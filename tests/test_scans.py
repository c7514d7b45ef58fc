"""Prefix scans against plain loops, with keys cut into stretches and not."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import scans as O

LARGE = [10**9, 40]


def rows_of(n=700):
    """A hot key, small ones, a null key; many equal times, and nulls."""
    rng = random.Random(5)
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(0, 400) * 10, i, rng.choice([None, *range(0, 90, 7)]), rng.choice(["start", "start", "ready", "result", "done", "failed", "odd", None]), rng.randrange(-2, 40)) for i in range(n)]


SCHEMA = "k long, t long, i long, work long, event string, pages long"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("large", LARGE)
@pytest.mark.parametrize("how", ["sum", "max"])
def test_running(spark, large, how):
    rows = rows_of()
    got = O.running(spark.createDataFrame(rows, SCHEMA), "k", ["t", "i"], F.col("work") - 30, "run", how, large)
    want = []
    for part in by_key(rows).values():
        seen = []
        for r in part:
            seen += [r[3] - 30] if r[3] is not None else []
            want.append((r[2], (sum(seen) if how == "sum" else max(seen)) if seen else None))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "run"]
    assert sorted((r["i"], r["run"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("large", LARGE)
def test_queue(spark, large):
    rows = [(*r[:3], r[3] or 0, *r[4:]) for r in rows_of()]
    done = O.in_hand(O.queued(spark.createDataFrame(rows, SCHEMA), "k", ["t", "i"], "work", large), "k", ["t", "i"], "pages", large)
    want = []
    for part in by_key(rows).values():
        free, ended = None, []
        for r in part:
            start = r[1] if free is None else max(free, r[1])
            free = start + r[3]
            ended.append((free, r[5]))
            want.append((r[2], start, free, sum(w for e, w in ended if e > r[1])))
    assert sorted((r["i"], r["start"], r["end"], r["pending"]) for r in done.collect()) == sorted(want)


@pytest.mark.parametrize("large", LARGE)
def test_requests(spark, large):
    """A refused event changes nothing: neighbours alone do not tell."""
    rows = rows_of()
    got = O.scan_requests(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", ["t", "i"], "event", "pages", large)
    follow = {("idle", "start"): "preparing", ("preparing", "ready"): "active", ("active", "result"): "processing_result", ("processing_result", "done"): "idle"}
    want = []
    for part in by_key(rows).values():
        state, number = "idle", 0
        for r in part:
            new = "idle" if r[4] == "failed" and state != "idle" else follow.get((state, r[4]))
            number += new == "preparing"
            mine = number if state != "idle" or new else None
            want.append((r[2], new is not None, new or state, mine, min(20, max(0, r[5])) if new and r[4] == "result" else 0))
            state = new or state
    assert sorted(map(str, ((r["i"], r["accepted"], r["state"], r["request"], r["taken"]) for r in got.collect()))) == sorted(map(str, want))


def test_hot_key_is_cut(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("t"), F.col("id").alias("i"))
    cut, any_cut = O.stretched(rows, "k", "t", 1000)
    sizes = [r["count"] for r in cut.groupBy("_scan_stretch").count().collect()]
    assert any_cut and len(sizes) > 100 and max(sizes) < 200


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert O.scan_requests(none, "k", ["t", "i"], "event", "pages").count() == 0
    assert O.queued(none, "k", ["t", "i"], "work").count() == 0
