"""Known answers of policies, of text rules, of pictures and of streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import stats as S
from vellum.functions import text as T
from vellum.operators import images as I
from vellum.operators import pages as O
from vellum.operators import spreads, titles
from vellum.streaming import stabilizer as Z
from vellum.streaming import throttle as TH


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_file_names(spark):
    rows = [("회의:자료",), (" report.PDF ",), ("  ... ",), (None,), ("a\tb  c",)]
    assert values(spark, rows, "s string", T.safe_file_name(F.col("s"))) == [("회의_자료.pdf",), ("report.pdf",), (None,), (None,), ("a_b c.pdf",)]


def test_meaningful_lines(spark):
    lines = ["1234", "Page 3 / 10", "2024년 3월 5일", "x", "회의 자료", "12 apples", "", "2024-03"]
    got = values(spark, [(x,) for x in lines], "s string", T.is_meaningful(F.col("s")))
    assert [g[0] for g in got] == [False, False, False, False, True, True, False, False]


def test_titles_break_ties_by_order_and_skip_noise(spark):
    rows = [(1, 0, "1234"), (1, 1, "Annual Report"), (1, 2, "Annual Repost"), (2, 0, "99"), (3, 0, "A very long line that goes on and on until it is cut at the last word of all")]
    got = {r["doc"]: r["title"] for r in titles.best_titles(spark.createDataFrame(rows, "doc int, ord int, raw string"), "doc").collect()}
    assert got == {1: "Annual Report", 3: "A very long line that goes on and on until it is"}


def test_title_score_prefers_height(spark):
    rows = [(0, 30.0, 30.0), (1, 100.0, 72.0), (2, 420.0, 25.0)]
    top = T.title_top(F.col("o"), F.col("t"), F.lit(1000.0))
    got = values(spark, rows, "o int, t double, h double", "o", T.title_score(F.lit("세 줄 제목"), top, F.least(F.col("h") / 1000.0, F.lit(0.2))))
    assert max(got, key=lambda r: r[1])[0] == 1


def test_utf16_units(spark):
    assert values(spark, [("a😀",)], "s string", T.units(F.col("s"))) == [(3,)]


@pytest.mark.parametrize("rule, want", [(lambda o: S.percentile(o, 0.5), 2.5), (lambda o: S.nearest_rank(o, 0.9), 4.0), (lambda o: S.truncated_rank(o, 0.75), 4.0), (lambda o: S.trimmed_mean(o, 0.25), 2.5)])
def test_ranks(spark, rule, want):
    assert values(spark, [([1.0, 2.0, 3.0, 4.0],)], "o array<double>", rule(F.col("o"))) == [(want,)]


def test_moved_pages(spark):
    pages = spark.createDataFrame([(1, k) for k in range(1, 6)], "s int, n long")
    got = {r["n"]: r["place"] for r in O.moved(pages, "s", "n", F.lit(2), F.lit(4)).collect()}
    assert got == {1: 1, 2: 4, 3: 2, 4: 3, 5: 5}


def test_one_bad_page_rejects_its_session(spark):
    docs = [(1, '{"id":1,"pages":[{"page_no":1,"raw_key":5,"rotation":0},{"page_no":2,"raw_key":6,"rotation":45}]}'), (2, '{"id":2,"pages":[{"page_no":1,"raw_key":7,"rotation":90}]}'), (3, "no json"), (4, None)]
    assert [tuple(r) for r in O.from_json(spark.createDataFrame(docs, "s int, json string"), "s").collect()] == [(2, 1, 7, 90)]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 etc")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    rows = O.valid_pdf(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r["path"][-5:], r["valid"]) for r in rows) == [("a.pdf", True), ("b.pdf", False)]
    assert O.scan_folder(spark, str(tmp_path)).count() == 2


def test_imported_pages(spark, tmp_path):
    good = b"\xff\xd8 picture \xff\xd9"
    rows = [(1, "b", len(good), good, len(good)), (1, "a", len(good), good, len(good)), (2, "a", len(good), good, len(good)), (2, "b", 5, good[:5], 5), (3, "a", len(good), good, 7)]
    files = spark.createDataFrame(rows, "session int, path string, length long, content binary, expected long")
    assert sorted(tuple(r) for r in O.imported_pages(files, 4).collect()) == [(1, "a", "page_004.jpg"), (1, "b", "page_005.jpg")]


def test_numbers_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 7)
    rows = [(i, i * 37 % 50) for i in range(300)]
    got = [(r["id"], r["place"]) for r in O.numbered(spark.createDataFrame(rows, "id long, at long"), "at", "id", "place").collect()]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(got, key=lambda r: r[1]) == [(i, k + 1) for k, (i, _) in enumerate(want)]


def raster(width, height, gutter=None, right=True):
    x = np.full((height, width), 245, np.uint8)
    x[15 : height - 15 : 8, width // 16 : width * 7 // 16] = 60
    if right:
        x[15 : height - 15 : 8, width * 9 // 16 : width * 15 // 16] = 60
    if gutter:
        x[:, gutter - 3 : gutter + 4] = 150
    return x


def test_spine_and_spreads(spark):
    assert spreads.spine_of(np.full((120, 240), 240.0)) == (120, 0.15, True)
    pictures = [raster(240, 120, 132), raster(300, 180, 150, right=False), raster(120, 240), np.zeros((5, 5), np.uint8)]
    rows = spark.createDataFrame([(i, p.tobytes(), p.shape[1]) for i, p in enumerate(pictures)], "id long, pixels binary, width int")
    found = {r["id"]: r for r in spreads.analyzed(rows, lambda r: np.frombuffer(r[1], np.uint8).reshape(-1, r[2]), "id").collect()}
    assert found[0]["layout"] == "spread" and 128 <= found[0]["x"] <= 136 and found[0]["confidence"] >= 0.72
    assert [found[i]["reason"] for i in range(4)] == ["none", "one_sided_content", "not_landscape", "image_too_small"]
    assert [found[i]["x"] for i in (1, 2, 3)] == [150, 60, 2]
    left, right = I.split_spread(raster(240, 120), 126)
    assert left.shape[1] + right.shape[1] == 248


def test_warp_and_quality():
    x = raster(200, 100)
    same = I.warp_perspective(x, np.array([[0, 0], [199, 0], [199, 99], [0, 99]], float), 200, 100)
    assert np.abs(same.astype(int) - x).max() <= 1
    q = I.quality(np.full((40, 40), 255, np.uint8))
    assert q["sharpness"] == 0 and q["ink"] == 0 and q["speckle"] == 0
    assert (I.whiten(x) >= 250).mean() > (x >= 250).mean()


BOX = np.array([[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]])


def test_stabilizer_needs_three_frames_and_forgets():
    s = Z.Stabilizer()
    for t in (0, 100):
        s.update(True, 0.8, BOX, t)
        assert s.stable is None
    s.update(True, 0.8, BOX, 200)
    assert s.stable is not None
    s.update(True, 0.1, BOX, 850)
    assert s.stable is not None
    s.update(True, 0.1, BOX, 1100)
    assert s.stable is None


@pytest.mark.parametrize("rules, strict", [(Z.OUTLINE_RULES, False), (Z.OUTLINE_RULES, True), (Z.CORNER_RULES, False)])
def test_stream_is_the_replay(spark, tmp_path, rules, strict):
    """Frames and shutters in six files, the stream stopped and started again in between: what it gave is the replay of all, and its states can be read."""
    rng = np.random.default_rng(1)
    rows = [(i % 3, i * 90 + (1500 if i > 70 else 0), i, bool(i % 9), float(rng.uniform(0.1, 1)), *(BOX + rng.normal(0, 0.02)).ravel().tolist()) for i in range(120)]
    rows += [(i % 3, i * 90 + (2200 if i > 68 else 40), 1000 + i, None, None, *[None] * 8) for i in range(0, 120, 4)]
    rows.sort(key=lambda r: r[1])
    names = ["stream_id", *Z.FRAME]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, ["long"] * 3 + ["boolean"] + ["double"] * 9, strict=True))

    def arrive(k):
        spark.createDataFrame(rows[k * 25 : k * 25 + 25], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = Z.stabilize_stream(stream, rules, strict).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.trigger(availableNow=True).start().awaitTermination(120)

    for k in (0, 1, 2):
        arrive(k)
    run()
    for k in (3, 4, 5):
        arrive(k)
    run()
    want = sorted(map(str, Z.stabilize_batch(spark.read.schema(schema).parquet(str(tmp_path / "in")), rules, strict).collect()))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == want and len(want) == 150
    last = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c"))
    newest = {s: max(r[1] for r in rows if r[0] == s) for s in range(3)}
    assert {r["key"]["stream_id"]: r["value"]["t_ms"] for r in last.collect()} == newest


def test_shutters_find_what_was_seen_lately(spark):
    frames = [(1, t, t, True, 0.9, *BOX.ravel().tolist()) for t in (0, 100, 200)]
    shutters = [(1, t, t, None, None, *[None] * 8) for t in (50, 250, 950, 951)]
    schema = "stream_id long, t_ms long, event_id long, detected boolean, confidence double, " + ", ".join(f"{a}{k} double" for k in range(4) for a in "xy")
    for strict in (False, True):
        got = {r["event_id"]: (r["stable"], r["left"] is not None) for r in Z.stabilize_batch(spark.createDataFrame(frames + shutters, schema), strict=strict).collect()}
        assert [got[t] for t in (50, 250, 950, 951)] == [(False, False), (True, True), (True, True), (False, False)]


def test_throttle_waits_for_the_analysis(spark, tmp_path):
    rows = [(s, i * 40, i, (i * 53) % 400) for s in (1, 2) for i in range(100)]
    frames = spark.createDataFrame(rows, "stream_id long, t_ms long, event_id long, work_ms long")
    want, free = [], 0
    for _, t, i, work in rows[:100]:
        if t >= free:
            want.append((t, i))
            free = t + max(250, work)
    for s in (1, 2):
        assert sorted((r["t_ms"], r["event_id"]) for r in TH.throttle_batch(frames).collect() if r["stream_id"] == s) == want
    frames.repartitionByRange(3, "t_ms").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    q = TH.throttle_stream(stream).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["t_ms"], r["event_id"]) for r in spark.table("throttled").collect() if r["stream_id"] == 2) == want


def test_titles_of_boxed_lines(spark):
    """Known answers: the tall line in the middle, nothing but a number, a low first line that still competes, and a height that counts for a fifth of the page at most."""
    rows = [
        ("korean", 0, "2024년 1학기", 30.0, 30.0), ("korean", 1, "세 줄 제목", 100.0, 72.0), ("korean", 2, "본문 내용입니다", 420.0, 25.0), ("number", 0, "1234", 10.0, 90.0),
        ("low", 0, "Bottom Heading", 900.0, 190.0), ("low", 1, "upper words", 600.0, 10.0), ("low", 2, "too low now", 700.0, 190.0), ("tall", 0, "First of them", 0.0, 200.0), ("tall", 1, "Second one here", 10.0, 900.0),
    ]
    lines = spark.createDataFrame([(*r, 1000) for r in rows], "page string, ord int, raw string, box_top double, box_height double, page_height int")
    got = {r["page"]: r["title"] for r in titles.best_titles(lines, "page").collect()}
    assert got == {"korean": "세 줄 제목", "low": "Bottom Heading", "tall": "First of them"}


def test_lengths_are_utf16_units(spark):
    """An emoji counts for two: in what is long, and in where a title is cut; half a one is left out."""
    smile = "\U0001F600"
    cases = [
        ("a" * 48 + smile, "a" * 48 + smile), ("a" * 49 + smile, "a" * 49), ("a" * 30 + " " + "b" * 30, "a" * 30), ("a" * 20 + " " + "b" * 40, "a" * 20 + " " + "b" * 29),
        (smile * 12 + " " + "b" * 40, smile * 12 + " " + "b" * 25), (smile * 13 + " " + "b" * 40, smile * 13), ("x" * 24 + smile + " " + "y" * 25, "x" * 24 + smile),
    ]
    got = values(spark, [(c,) for c, _ in cases], "s string", T.truncated(F.col("s")))
    assert got == [(w,) for _, w in cases]
    assert values(spark, [("n" * 119 + smile,), (smile * 60,), (smile * 61,)], "s string", T.safe_file_name(F.col("s"))) == [("n" * 119 + ".pdf",), (smile * 60 + ".pdf",), (smile * 60 + ".pdf",)]


def test_narrow_places_and_outer_offsets(spark):
    """A valley between two pages, an outline beyond a tight boundary, and one extreme that points inward."""
    rows = [([10.0, 95.0, 98.0, 100.0, 96.0, 24.0, 94.0, 99.0, 97.0, 12.0],), ([90.0, 95.0, 98.0, 100.0, 96.0, 80.0, 94.0, 99.0],), ([10.0, 95.0, 24.0],)]
    assert values(spark, rows, "v array<double>", S.narrow_place(F.col("v"))) == [(5,), (None,), (None,)]
    rows = [([-4.0, 2.0, 7.0, 8.0, 9.0, 10.0, 11.0],), ([8.0, 10.0, 12.0, 14.0, 11.0, -35.0, 9.0],), ([-1.0],)]
    got = [r[0] for r in values(spark, rows, "v array<double>", S.outer_offset(F.col("v")))]
    assert got[0] > 8 and got[1] > 11 and got[2] == 0.0


def test_corners_of_a_turned_preview(spark):
    q = G.Quad([F.lit(x) for x in (0.1, 0.9, 0.9, 0.1)], [F.lit(y) for y in (0.2, 0.2, 0.8, 0.8)]).rotated(F.col("d"))
    ((tlx, tly, brx, bry),) = values(spark, [(90,)], "d int", q.xs[0], q.ys[0], q.xs[2], q.ys[2])
    assert abs(tlx - 0.2) < 1e-4 and abs(tly - 0.1) < 1e-4 and abs(brx - 0.8) < 1e-4 and abs(bry - 0.9) < 1e-4
