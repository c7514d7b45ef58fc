"""Session folders as a source, and sinks that write all or nothing."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from vellum.operators import names as N
from vellum.sources import files, sessions

SCHEMA = "document string, place int, content binary, width int, height int"


def folder(root, name, page_files, meta=None):
    (root / name).mkdir()
    for f in page_files:
        (root / name / f).parent.mkdir(exist_ok=True)
        (root / name / f).write_bytes(b"\xff\xd8jpeg\xff\xd9")
    if meta is not None:
        (root / name / "session.json").write_bytes(meta if isinstance(meta, bytes) else json.dumps(meta).encode())


def page(n, **more):
    return {"pageNo": n, "rawImageFile": f"raw_{n:03}.jpg", "createdTime": "2026-01-02T03:04:05.678", "rotation": 90} | more


def session(name, *pages, **more):
    return {"id": name, "createdTime": "2026-01-01T00:00:00.000Z", "pages": list(pages)} | more


@pytest.fixture
def root(tmp_path):
    raws = ["raw_001.jpg", "raw_002.jpg", "raw_x.jpg", "raw_0003.jpg"]
    r = tmp_path / "scan_sessions"
    r.mkdir()
    folder(r, "whole", [*raws, "corrected_001.png", "original/a.jpg"], session("whole", page(1, correctedImageFile="corrected_001.png", correctionStatus="completed"), page(2, correctionStatus="processing", enhancementMode="odd", enhancementStatus="completed", enhancedImageFile="gone.png", originalSourceFile="original/a.jpg"), captureMode="spread", suggestedTitle="A title"))
    folder(r, "defaults", raws, session("defaults", page(1, correctionType="curved", correctionStatus="completed", correctionOutcome="odd", captureMode="odd", sourceType="mlKit", mlKitLayout="odd")))
    folder(r, "raw", raws)
    folder(r, "empty", [])
    folder(r, "no_json", raws, b"{ not json")
    folder(r, "no_text", raws, b"\xff\xfe\x00")
    folder(r, "other_id", raws, session("another", page(1)))
    folder(r, "unsafe", raws, session("unsafe", page(1), page(2, rawImageFile="../whole/raw_001.jpg")))
    folder(r, "missing", raws, session("missing", page(7)))
    folder(r, "turned", raws, session("turned", page(1, rotation=45)))
    folder(r, "bad_edge", raws, session("bad_edge", page(1, pageBoundary={"top": [{"x": 0, "y": 0}]})))
    folder(r, "blank_title", raws, session("blank_title", page(1), suggestedTitle="  "))
    (r / "a file.txt").write_text("not a session")
    return r


def test_sessions_are_read_from_metadata_or_raw_files(spark, root):
    spark.dataSource.register(sessions.SessionFolder)
    got = sessions.pages(spark.read.format("session_folder").load(str(root))).collect()
    by = {}
    for r in got:
        by.setdefault(r["session_id"], []).append(r)
    assert set(by) == {n for n in os.listdir(root) if (root / n).is_dir()}
    assert {n for n, rows in by.items() if rows[0]["origin"] == "metadata"} == {"whole", "defaults"}
    for n in set(by) - {"whole", "defaults", "empty"}:
        assert sorted((r["page_no"], r["raw_file"], r["rotation"]) for r in by[n]) == [(1, "raw_001.jpg", 0), (2, "raw_002.jpg", 0), (3, "raw_0003.jpg", 0)], n
    assert [r["page_no"] for r in by["empty"]] == [None]
    one, two = sorted(by["whole"], key=lambda r: r["page_no"])
    assert (one["capture_mode"], one["title"], one["correction_status"], one["correction_outcome"], one["corrected_file"], one["perspective_applied"], one["curvature"]) == ("spread", "A title", "completed", "completed", "corrected_001.png", True, "none")
    assert (two["correction_status"], two["correction_outcome"], two["enhancement_mode"], two["enhancement_status"], two["enhanced_file"], two["enhancement_applied"]) == ("failed", "none", "scanColor", "failed", None, False)
    (d,) = by["defaults"]
    assert (d["capture_mode"], d["source_type"], d["layout"], d["correction_status"], d["correction_outcome"], d["curvature"], d["curved_applied"]) == ("single", "mlKit", None, "failed", "none", "strongCurve", True)


def test_only_wanted_folders_are_read(spark, root):
    reader = sessions.FolderReader(str(root))
    left = list(reader.pushFilters([In(("session_id",), ("raw", "whole", "../whole")), EqualTo(("session_id",), "raw"), GreaterThan(("metadata",), "a")]))
    assert left == [GreaterThan(("metadata",), "a")] and [p.names for p in reader.partitions()] == [["raw"]]
    spark.dataSource.register(sessions.SessionFolder)
    assert [r["session_id"] for r in spark.read.format("session_folder").load(str(root)).filter("session_id = 'raw'").collect()] == ["raw"]


def test_sessions_as_a_stream(spark, root, tmp_path):
    """New and changed sessions come once each, over a restart."""
    spark.dataSource.register(sessions.SessionFolder)

    def run():
        stream = spark.readStream.format("session_folder").option("settleMs", "0").load(str(root))
        sessions.pages(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).groupBy("session_id").count().collect()

    first = {r["session_id"]: r["count"] for r in run()}
    assert len(first) == 12 and first["raw"] == 3
    time.sleep(0.1)
    folder(root, "late", ["raw_005.jpg"])
    (root / "raw" / "raw_001.jpg").write_bytes(b"taken again")
    time.sleep(0.1)
    assert {r["session_id"]: r["count"] for r in run()} == first | {"late": 1, "raw": 6}
    assert {r["session_id"]: r["count"] for r in run()} == first | {"late": 1, "raw": 6}


def test_pdf_files_of_any_length(spark, tmp_path):
    rng = random.Random(0)
    rows = [(d, k, bytes(rng.randrange(256) for _ in range(40 + k)), 100 + k, 200) for d, n in (("long", 300), ("short", 1)) for k in range(n)]
    rng.shuffle(rows)
    files.write_pdfs(spark.createDataFrame(rows, SCHEMA).repartition(7), str(tmp_path / "pdfs"))
    assert sorted(os.listdir(tmp_path / "pdfs")) == ["long.pdf", "short.pdf"]
    data = (tmp_path / "pdfs" / "long.pdf").read_bytes()
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    assert data[start : start + 4] == b"xref" and len(places) == 902 and b"/Count 300" in data
    assert all(data[p:].startswith(b"%d 0 obj" % (k + 1)) for k, p in enumerate(places))
    pictures = [r[2] for r in sorted(r for r in rows if r[0] == "long")]
    at = [data.index(p) for p in pictures]
    assert at == sorted(at)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = [(f"d{i}", 0, b"x" if i != 17 else None, 10, 10) for i in range(40)]
    with pytest.raises(Exception, match="no picture"):
        files.write_pdfs(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "p"))
    assert not (tmp_path / "p").exists() or os.listdir(tmp_path / "p") == []


def test_files_all_or_none(spark, tmp_path):
    target = tmp_path / "t"
    table = spark.createDataFrame([(f"s{i % 3}/f{i}.png", bytes([i])) for i in range(20)], "path string, content binary").repartition(4)
    files.write_files(table, str(target))
    found = {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()}
    assert found == {f"s{i % 3}/f{i}.png": bytes([i]) for i in range(20)}
    for bad, word in (([("s0/new.png", b"1"), ("s0/f0.png", b"2")], "already"), ([("a", b"1"), ("a", b"2")], "same file name"), ([("b", b"1"), ("../c", b"2")], "safe")):
        with pytest.raises(Exception, match=word):
            files.write_files(spark.createDataFrame(bad, "path string, content binary").repartition(2), str(target))
        assert {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()} == found
        assert not [p for p in os.listdir(target) if p.startswith(".pending")]


@pytest.mark.parametrize("large", [10**9, 10])
@pytest.mark.parametrize("start", [1, 4])
def test_free_numbers_one_by_one(spark, large, start):
    rng = random.Random(2)
    taken = [(rng.choice("aab"), rng.randrange(-2, 60)) for _ in range(70)]
    new = [(rng.choice("aaabc"), i) for i in range(120)]
    got = N.free_numbers(spark.createDataFrame(new, "s string, i long"), spark.createDataFrame(taken, "s string, n long"), "s", ["i"], "n", start, large)
    used, want = set(taken), []
    for s, i in sorted(new, key=lambda r: r[1]):
        n = start
        while (s, n) in used:
            n += 1
        used.add((s, n))
        want.append((s, i, n))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_numbers_of_names(spark):
    names = ["a.png", "a_2.png", "a_10.png", "a_1.png", "a_02.png", "ab.png", "a_2.jpg", "a_.png", "b.png"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["k"] for r in rows.select("name", N.number_of(F.col("name"), F.lit("a"), "png").alias("k")).collect()}
    assert got == {n: {"a.png": 1, "a_2.png": 2, "a_10.png": 10}.get(n) for n in names}
