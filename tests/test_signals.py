"""Statistics of series against plain versions, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import candidates as C
from vellum.operators import signals as S
from vellum.plans import QUERIES

SAMPLES = "series_id long, pos long, value double"


def plain_ranks(values):
    o = sorted(values)
    n, mid = len(o), float(np.percentile(o, 50))
    cut = int(n * 0.18)
    outer = [v - mid for v in o if v >= mid]
    return [mid, float(np.percentile(o, 88)), o[int((n - 1) * 0.9 + 0.5)], o[min(int(n * 0.75), n - 1)], float(np.mean(o[cut : n - cut])), float(np.percentile(outer, 88))]


def test_ranked_statistics(spark):
    r = random.Random(3)
    series = {n: [r.choice([r.uniform(-50, 50), 7.0, 7.0]) for _ in range(n)] for n in (1, 2, 3, 5, 8, 40, 301)}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)] + [(3, 99, None), (77, 0, None)]
    got = {x["series_id"]: x for x in S.ranked_statistics(spark.createDataFrame(rows, SAMPLES), "series_id", "value").collect()}
    assert set(got) == set(series)
    for k, vs in series.items():
        assert [got[k][c] for c in ("median", "p88", "rank90", "rank75", "trimmed", "outer")] == pytest.approx(plain_ranks(vs), abs=1e-6)


def test_narrow_places(spark):
    series = {1: [9.0] * 5 + [1.0, 1.0] + [9.0] * 5, 2: [9.0] * 12, 3: [1.0] + [9.0] * 11, 4: [9.0] * 4 + [1.0] + [9.0] * 2, 5: [0.0] * 9}
    rows = [(k, i + 1, v) for k, vs in series.items() for i, v in enumerate(vs)]
    assert {x["series_id"]: x["place"] for x in S.narrow_places(spark.createDataFrame(rows, SAMPLES), "series_id", "value").collect()} == {1: 5, 2: None, 3: None, 5: None}


def test_apart(spark):
    """One long series among short ones, across batches; nulls are not kept and change nothing."""
    r = random.Random(4)
    series = {1: [r.uniform(0, 60) for _ in range(25_000)], 2: [5.0, None, 6.0, 40.0, None], 3: [None]}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    got = {}
    for x in S.apart(spark.createDataFrame(rows, SAMPLES).repartition(5), "series_id", "pos", "value", 15.0).collect():
        got.setdefault(x["series_id"], []).append((x["pos"], x["value"]))
    for k, vs in series.items():
        last, want = None, []
        for i, v in enumerate(vs):
            if v is not None and (last is None or abs(last - v) > 15.0):
                last = v
                want.append((i, v))
        assert sorted(got.get(k, [])) == want


def test_nothing(spark):
    none = spark.createDataFrame([], SAMPLES)
    for df in (S.ranked_statistics(none, "series_id", "value"), S.narrow_places(none, "series_id", "value"), S.apart(none, "series_id", "pos", "value", 1.0)):
        assert df.count() == 0


def test_conservative_choice(spark):
    """The best of a page gives way to a much larger one that is hardly worse; of equal ones the first; pages do not mix."""
    columns = ["page_id", "ord", "score", "area_ratio", "paper", "contrast", "line_penalty", "continuation"]
    good = (0.6, 0.2, 0.1, 0.1)
    rows = [(1, 1, 0.9, 0.4, *good), (1, 2, 0.85, 0.5, *good), (1, 3, 0.85, 0.5, *good), (1, 4, 0.7, 0.9, *good), (2, 1, 0.8, 0.5, *good), (2, 2, 0.8, 0.5, *good), (3, 5, 0.5, 0.3, *good), (3, 6, 0.45, 0.9, 0.1, 0.2, 0.1, 0.1)]
    got = {r["page_id"]: (r["ord"], r["alternative"]) for r in C.best_conservative(spark.createDataFrame(rows, columns), "page_id").collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (5, False)}


@pytest.mark.parametrize("name", ["boundary_sanity", "refinement_verdicts", "edge_visibility", "candidate_scores", "split_spreads"])
def test_row_local_queries_do_not_shuffle(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_spine_at_the_sides(spark):
    """A gutter right at the first place that counts has shoulders on either side."""
    rows = [(1, x, 20.0 if x == 38 else 200.0, 1.0) for x in range(100)]
    found = S.spine_of_profiles(spark.createDataFrame(rows, "k long, x long, mean double, variance double"), "k").first()
    assert found["x"] in (37, 38, 39) and not found["fallback"]
    assert S.spine_of_profiles(spark.createDataFrame(rows, "k long, x long, mean double, variance double").filter(F.lit(False)), "k").count() == 0
