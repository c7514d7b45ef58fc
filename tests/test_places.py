"""Rows of a page that share their line number still have places of their own: 1 to the number of the page's rows."""

from collections import Counter
from datetime import datetime

import duckdb
import pytest

from vellum.plans import ORACLE, QUERIES

COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
#: Queries that tell a row by its place, and those that only count with it.
PLACED = [
    "candidate_scores", "split_spreads", "segmentation_confidence", "edge_visibility", "paper_candidates", "refinement_verdicts", "edge_expansion", "page_ownership", "partial_masks",
    "curvature_classes", "curve_adoption", "curved_confidence", "spread_classes", "production_crop", "guide_levels", "quality_warnings", "conservative_corners", "polygon_area",
    "bounds_extent", "corner_order", "manual_corners", "boundary_sanity", "boundary_guidance", "bounded_refinement", "crop_cascade", "guide_overlap", "search_rois", "output_sizes",
    "boundary_modes", "rotated_boundaries", "spread_rois", "guide_regions", "crop_unrotate_compose", "split_geometry", "pdf_page_sizes", "small_rules", "crop_differences",
    "initial_corners", "native_features", "native_penalties", "native_spines", "paper_regions", "native_base_scores",
]
FILTERED = {"quality_warnings", "spread_rois", "crop_differences"}


def line(page, number, part, supplier, day=1, quantity=45.0):
    return (page, part, supplier, number, quantity, 900.0 + day, 0.05, 0.04, "NRA"[part % 3 if part else 0], datetime(2020, 1, day))


# three rows of one number, rows without number, part or supplier, a page of one row, pages of 28 and 9 rows that share their number
LINES = [line(1, 2, 40, 3), line(1, 2, 11, 9), line(1, 2, 11, 4), line(1, 1, 77, 5), line(1, None, 12, 6), line(1, 5, None, 2), line(1, 5, 30, None), line(1, 5, 30, 7), line(2, 4, 8, 8)]
LINES += [line(3, 1, 100 + k, k % 7, k) for k in range(1, 29)]
LINES += [line(4, 1, part, 5) for part in (10, 12, 13, 17, 18, 19, 20, 21, 23)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("places"))
    spark.createDataFrame(LINES, COLUMNS).repartition(3).write.parquet(f"{at}/lineitem.parquet")
    return at


def numbered(lines):
    """(page, place): row, by plain sorting with nulls last."""
    found = {}
    for page in {x[0] for x in lines}:
        rows = sorted((x for x in lines if x[0] == page), key=lambda x: [(v is None, v) for v in (x[3], x[1], x[2], x[5], x[9])])
        found |= {(page, i): x for i, x in enumerate(rows, 1)}
    return found


@pytest.mark.parametrize("name", PLACED)
def test_rows_have_places(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    places = {(r["page_id"], r["ord"]) for r in rows}
    most = Counter((r["page_id"], r["ord"]) for r in rows)
    if name == "split_spreads":
        assert all(sorted(r["part"] for r in rows if (r["page_id"], r["ord"]) == k) in (["whole"], ["left", "right"]) for k in places)
    else:
        assert set(most.values()) <= {1}
    assert places <= set(numbered(LINES)) if name in FILTERED else places == set(numbered(LINES))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    assert "row_number() OVER (PARTITION BY l_orderkey" in ORACLE[name]
    assert places == set(con.sql(f"SELECT page_id, ord FROM ({ORACLE[name]})").fetchall())


def test_conflicts_are_of_places(spark, folder):
    """Even places are of the outline, odd ones of the lines of text."""
    want = {}
    for page in (1, 2, 3, 4):
        ways = {True: [], False: []}
        for (p, place), row in numbered(LINES).items():
            if p == page and row[1] is not None and row[1] % 5 % 3 != 1:
                ways[place % 2 == 0].append(row[1] % 5 % 3 - 1)
        share = {g: max(w.count(1), w.count(-1)) / len(w) if w else 0.0 for g, w in ways.items()}
        within = any({1, -1} <= set(w) and share[g] < 0.67 for g, w in ways.items())
        want[page] = within or min(map(len, ways.values())) >= 2 and sum(ways[True]) * sum(ways[False]) < 0 and min(share.values()) >= 0.67
    got = {r["page_id"]: r["conflict"] for r in QUERIES["direction_conflicts"](spark, folder).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_crops_are_counted_by_place(spark, tmp_path):
    """Every thirteenth row of a page has no content of its own."""
    spark.createDataFrame([line(7, 1, 1, 5, day) for day in range(1, 29)], COLUMNS).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["source"]: r["n"] for r in QUERIES["crop_sources"](spark, str(tmp_path)).collect()} == {"contentSafe": 26, "guideFallback": 2}
