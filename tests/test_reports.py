"""Merged reports and records of a log, with what events and lines may lack."""

from vellum.operators import reports as O

EVENTS = "page int, at int, stage string, source struct<width:int,height:int>, output struct<width:int,height:int>"


def test_merged_reports(spark):
    rows = [
        (1, 1, "enhanced", (1, 1), (2, 2)), (1, 2, "enhanced", (3, 3), (4, 4)),
        (2, 1, "enhanced", (1, 1), (2, 2)), (2, 2, "perspective", (5, 5), (6, 6)), (2, 3, "enhanced", (7, 7), (8, 8)),
        (3, 4, "perspective", (1, 1), (2, 2)), (3, 2, "perspective", (3, 3), (4, 4)), (3, 5, "curved", (9, 9), None), (3, 1, "curved", None, (7, 7)),
        (4, None, "perspective", (1, 1), (2, 2)), (4, 1, "other", (1, 1), (2, 2)), (4, 2, None, (1, 1), (2, 2)),
    ]
    merged = O.merged_reports(spark.createDataFrame(rows, EVENTS), "page")
    got = {r["page"]: tuple(r[s] and r[s]["width"] for s in O.STAGES) for r in merged.collect()}
    assert got == {1: (None, 1, None, 4), 2: (5, 6, None, 8), 3: (1, 2, 7, None)}
    lines = {r["page"]: r["l"] for r in merged.select("page", O.report_line("page", ("width",)).alias("l")).collect()}
    assert lines[1].startswith("page=1 rawResolution=n/axn/a perspectiveResolution=1x1 ") and lines[1].endswith("curvedWidth=n/a enhancedWidth=4")
    assert O.merged_reports(spark.createDataFrame([], EVENTS), "page").count() == 0


def test_records(spark):
    lines = ["[t][A] page=3  page=4 late mode=", "[t][B] page=x success=maybe reason=a=b=c", "[t][C]", "no record", "", None, "[t][D] enhanced=0.5 maskCoverage=none"]
    got = [r for r in O.records(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), "line").orderBy("i").collect()]
    assert [r["category"] for r in got] == ["A", "B", "C", None, None, None, "D"]
    assert (got[0]["page"], got[0]["mode"], got[0]["flags"]) == (4, None, ["late"])
    assert (got[1]["page"], got[1]["passed"], got[1]["reason"]) == (None, None, "a=b=c")
    assert got[2]["flags"] == [] and got[3]["flags"] is None and got[5]["flags"] is None and got[6]["share"] == 0.5
