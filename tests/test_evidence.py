"""Evidence along edges against a plain version, and plans that stay in their rows."""

import math
import random
from statistics import median

import pytest

from vellum.operators import evidence as O
from vellum.plans import QUERIES

COLOURS = ("il", "ia", "ib", "ol", "oa", "ob", "gradient")
KEYS = {"page_id": 1, "edge": 2, "limit": 100.0, "step": 3.0}


def plain(line):
    """score, support, continuity and occlusion of samples, None where there is none."""
    seen = [s for s in line if s]
    if not seen:
        return None

    def apart(a, b):
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))

    scores = [min(1.0, max(0.0, apart(s[:3], s[3:6]) / 58 * 0.5 + abs(s[0] - s[3]) / 52 * 0.25 + s[6] / 96 * 0.25)) for s in seen]
    off = [abs(s - median(scores)) for s in scores]
    inside = [median(c) for c in list(zip(*seen, strict=True))[:3]]
    colour = [apart(s[:3], inside) for s in seen]
    middle = median(colour)
    spread, wide = max(0.025, median(off)), max(2.0, median(abs(c - middle) for c in colour))
    kept = [s for s, d, c in zip(scores, off, colour, strict=True) if d <= spread * 2.8 and c <= middle + wide * 2.8]
    cut, jumps = int(len(kept) * 0.18), sum(abs(a - b) > 0.34 for a, b in zip(kept, kept[1:], strict=False))
    left = sorted(kept)[cut : len(kept) - cut]
    broken = 1.0 if len(kept) < 2 else jumps / (len(kept) - 1)
    return sum(left) / len(left) if left else 0.0, sum(s >= 0.22 for s in scores) / len(scores), 1 - broken, min(1.0, (1 - len(kept) / len(scores)) * 0.7 + broken * 0.3)


def test_lines_of_any_samples(spark):
    """Samples missing here and there, at an end, all but one or two, and all."""
    rng = random.Random(7)
    lines = []
    for share in (0.0, 0.1, 0.5, 0.85, 1.0):
        for wild in (3, 40, 128):
            for _ in range(12):
                base = [rng.uniform(0, 255) for _ in range(6)]
                lines.append([None if rng.random() < share else tuple(min(255.0, max(0.0, b + rng.uniform(-wild, wild))) for b in base) + (rng.uniform(0, 120),) for _ in range(O.SAMPLES)])
    lines += [[None] * 6 + line[6:] for line in lines[:4]] + [[(190.0, 128.0, 120.0, 70.0, 128.0, 120.0, 5.0)] * O.SAMPLES]
    rows = [(*KEYS.values(), float(k), *[[s and s[c] for s in line] for c in range(len(COLOURS))]) for k, line in enumerate(lines)]
    samples = spark.createDataFrame(rows, "page_id long, edge int, limit double, step double, offset double, " + ", ".join(f"{c} array<double>" for c in COLOURS))
    got = {int(r["offset"]): (r["score"], r["support"], r["continuity"], r["occlusion"]) for r in O.edge_evidence(samples).collect()}
    want = {k: w for k, line in enumerate(lines) if (w := plain(line))}
    assert set(got) == set(want) and len(want) < len(lines)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_evidence_stays_in_its_row(spark):
    """Sheets are dealt out, and the choice among an edge's lines needs a shuffle; samples are not sorted or shuffled."""
    plans = {q: QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for q in ("edge_evidence", "edge_moves")}
    assert plans["edge_evidence"].count("Exchange") == 1 and not any(word in plans["edge_evidence"] for word in ("Window", "Sort ["))
    assert "Window" not in plans["edge_moves"] and plans["edge_moves"].count("Exchange") == 2


def test_sheets_of_one_file_are_dealt_out(spark):
    sheets = spark.range(400).selectExpr("id AS page_id", "'left' AS side", "1000 AS width", "1400 AS height", "100D AS x0", "150D AS y0", "900D AS x1", "150D AS y1", "900D AS x2", "1270D AS y2", "100D AS x3", "1270D AS y3")
    tasks = O.edge_places(sheets.coalesce(1)).selectExpr("spark_partition_id() AS p").distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism
