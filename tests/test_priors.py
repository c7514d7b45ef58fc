"""Spread pages from their strongest lines: a drawn spread, and pictures that have none."""

import duckdb

from vellum.operators import priors as O
from vellum.plans import ORACLE, QUERIES

LINES = "mask long, y long, shades array<bigint>, edges array<boolean>"
W, H = 100, 80


def spread(outer_left=4, spine=50, outer_right=95, top=5, bottom=74):
    """Two pages, the left one up to the spine; everything beyond the pages is dark."""
    rows = []
    for y in range(H):
        line = [220 if outer_left <= x <= outer_right and top <= y <= bottom else 30 for x in range(W)]
        edge = [x in (outer_left, outer_right) or (y in (top, bottom) and outer_left <= x <= outer_right) for x in range(W)]
        rows.append((y, line, edge))
    return rows


def found(spark, rows, **features):
    lines = spark.createDataFrame(rows, LINES).repartition(3)
    anchors = O.level_anchors(lines, O.upright_anchors(lines, W, H), W, H)
    values = {"contrast": 0.6, "paper": 0.8, "envelope": 0.95, "continuation": 0.1} | features
    return {(r["mask"], r["side"]): r for r in O.prior_candidates(anchors.selectExpr("*", *[f"{v}D AS {n}" for n, v in values.items()]), W, H).collect()}


def test_spread(spark):
    got = found(spark, [(1, *r) for r in spread()])
    assert set(got) == {(1, "left"), (1, "right")}
    left, right = got[1, "left"], got[1, "right"]
    assert left["outer"] in (3, 4, 5) and right["outer"] in (94, 95, 96)
    assert all(abs(r["top"] - 5) <= 1 and abs(r["bottom"] - 74) <= 1 and 0 < r["confidence"] <= 1 and r["score"] > 0.4 for r in got.values())


def test_what_is_left_out(spark):
    rows = [(1, *r) for r in spread()]
    assert not found(spark, rows, envelope=0.79) and not found(spark, rows, continuation=0.42)
    blank = [(2, y, [128] * W, [False] * W) for y in range(H)]
    assert not found(spark, blank)
    got = found(spark, rows + blank)
    assert {m for m, _ in got} == {1}


def test_odd_pictures(spark):
    """Null lines and shades tell nothing; a picture under 40 pixels has no page; no picture, no row."""
    holes = [(1, y, None if y % 7 == 3 else [None if x % 11 == 5 else v for x, v in enumerate(line)], edge) for y, line, edge in spread()]
    assert set(found(spark, holes)) <= {(1, "left"), (1, "right")}
    assert found(spark, []) == {}
    small = spark.createDataFrame([(1, y, [y * 7 % 256] * 30, [True] * 30) for y in range(30)], LINES)
    anchors = O.level_anchors(small, O.upright_anchors(small, 30, 30), 30, 30)
    assert O.prior_candidates(anchors.selectExpr("*", "0.6D AS contrast", "0.8D AS paper", "0.95D AS envelope", "0.1D AS continuation"), 30, 30).count() == 0


def test_pictures_without_their_lower_lines(spark):
    """A picture that ends above the places of a bottom edge has a top at most, and so no anchors: as many rows as the SQL, whose joins need both."""
    rows = [(1, *r) for r in spread()] + [(2, *r) for r in spread() if r[0] < 10] + [(3, *r) for r in spread() if r[0] >= 40]
    lines = spark.createDataFrame(rows, LINES)
    got = O.level_anchors(lines, O.upright_anchors(lines, W, H), W, H).collect()
    assert {(r["mask"], r["side"]) for r in got} == {(1, "left"), (1, "right")}


def test_query_where_lines_are_missing(spark, tmp_path):
    """The last picture ends early, and vectors that are null are no lines, to the query and its SQL alike."""
    rows = [(i, None if i % 11 == 4 else [((i * 37 + x * x * 13) % 101 - 50) / 80.0 for x in range(64)]) for i in range(110)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE["spread_anchors"]).fetchall())
    assert want and sorted(tuple(r) for r in QUERIES["spread_anchors"](spark, str(tmp_path)).collect()) == want
