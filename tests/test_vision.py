"""Pictures with known pages."""

import time

import numpy as np
import pytest

from vellum.operators import vision as V
from vellum.streaming import stabilizer as Z


def desk():
    x = np.full((160, 200, 3), (60, 50, 40), np.uint8)
    x[20:140, 30:170] = 240
    x[40:120:8, 50:150] = 40
    return x


def test_document_is_found():
    found = V.detect_document(desk())
    assert np.abs(found["corners"] - [[30, 20], [169, 20], [169, 139], [30, 139]]).max() <= 3
    assert len(found["outline"]) == 4 and abs(found["share"] - 140 * 120 / 160 / 200) < 0.03
    assert V.detect_document(np.zeros((60, 60, 3), np.uint8)) is None


def test_components_and_morphology():
    m = np.zeros((6, 12), bool)
    m[1:3, 1:4] = m[2:5, 3] = m[0:5, 8:10] = True
    m[4, 3:9] = True
    labels, n = V.components(m)
    assert n == 1 and (labels > 0).sum() == m.sum()
    m[4, 5] = False
    assert V.components(m)[1] == 2
    assert V.components(np.zeros((3, 3), bool))[1] == 0
    dot = np.zeros((9, 9), bool)
    dot[4, 4] = True
    assert V.spread(dot, 5, 3).sum() == 15 and not V.opened(dot, 3, 3).any() and V.closed(dot, 5, 5).sum() == 1


def test_geometry_of_outlines():
    rng = np.random.default_rng(0)
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]])
    cloud = np.concatenate((square, rng.integers(1, 9, (40, 2))))
    assert {tuple(p) for p in V.convex_hull(cloud)} == {tuple(p) for p in square}
    noisy = np.array([[0, 0], [5, 0.1], [10, 0], [10, 5], [10, 10], [0, 10]])
    assert len(V.simplified(noisy, 0.5)) == 4
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    box = np.array([[0, 0], [8, 0], [8, 3], [0, 3]]) @ turn
    r = V.smallest_rectangle(box)
    assert abs(np.prod([np.hypot(*(r[1] - r[0])), np.hypot(*(r[2] - r[1]))]) - 24) < 1e-6


def test_edges_and_lines():
    grey = np.full((80, 80), 30, np.uint8)
    grey[20:60, 20:60] = 220
    edges = V.canny(grey)
    assert 100 < edges.sum() < 400
    lines = V.hough_lines(edges, 30)
    assert len([a for a, _, _ in lines if a < 3 or a > 177]) == 2 and len([a for a, _, _ in lines if 87 < a < 93]) == 2


def test_flattening_undoes_a_bend():
    grey = np.tile(np.linspace(0, 255, 120)[:, None], (1, 200)).astype(np.uint8)
    curve = np.sin(np.linspace(0, np.pi, 200)) * 2
    bent = V.flatten_curve(grey, -curve * 0.5, 120)
    assert np.abs(V.flatten_curve(bent, curve * 0.5, 120).astype(int) - grey).mean() < 1
    with pytest.raises(ValueError):
        V.flatten_curve(grey, np.full(200, 500.0), 120)
    tapered = V.edge_taper(np.ones(100), 10, 50)
    assert tapered[9] == 0 and tapered[60] == 0 and tapered[10] == 0 and tapered[35] == 1


def test_tones():
    x = desk()
    grey = x.mean(axis=2).astype(np.uint8)
    bw = V.black_white(grey[24:136, 34:166])
    assert set(np.unique(bw)) == {0, 255} and (bw == 0).mean() > 0.02
    assert V.straightness(grey) > 0.3 and V.straightness(np.full((40, 40), 200, np.uint8)) == 0
    tinted = x.copy()
    tinted[20:140, 30:170, 2] -= 20
    assert np.ptp(V.neutral_paper(tinted)[30, 100].astype(int)) < 10
    assert V.otsu(np.array([[10, 12, 200, 210]])) in range(12, 200)
    assert np.allclose(V.lab(np.full((1, 1, 3), 255))[0, 0], [255, 128, 128], atol=1)


def test_older_stabilizer():
    box = np.array([[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]])
    s = Z.CornerStabilizer()
    for t in (0, 100, 200):
        s.update(True, 0.8, box, t)
    assert s.stable is not None
    s.update(True, 0.4, box, 900)
    assert s.stable is not None
    s.update(True, 0.4, box, 1000)
    assert s.stable is None


def test_png_and_pdf_files(spark):
    import struct
    import zlib

    from vellum.operators import exports, images
    from vellum.operators.pages import valid_pdf

    for x in (np.arange(60, dtype=np.uint8).reshape(6, 10), np.arange(90, dtype=np.uint8).reshape(5, 6, 3)):
        file, at, data = images.png(x), 8, b""
        while at < len(file):
            (n,), kind = struct.unpack(">I", file[at : at + 4]), file[at + 4 : at + 8]
            assert struct.unpack(">I", file[at + 8 + n : at + 12 + n])[0] == zlib.crc32(file[at + 4 : at + 8 + n])
            data += file[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(x.shape[0], -1)
        assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(x.shape) == x).all()
    pages = [(7, 2, b"second", 100, 200), (7, 1, b"first", 200, 100), (8, 1, b"only", 10, 10)]
    made = exports.pdf_documents(spark.createDataFrame(pages, "document long, place int, content binary, width int, height int"))
    got = {r["document"]: bytes(r["content"]) for r in made.collect()}
    assert got[7].index(b"first") < got[7].index(b"second") and b"/Count 2" in got[7] and b"MediaBox [0 0 841.89 420.95]" in got[7]
    place = int(got[8].split(b"startxref\n")[1].split(b"\n")[0])
    assert got[8][place : place + 4] == b"xref" and got[8].endswith(b"%%EOF\n")
    assert all(r["valid"] for r in valid_pdf(made.selectExpr("cast(document as string) as path", "length(content) as length", "content")).collect())


def test_many_specks_take_one_pass():
    """A mask of some ten thousand specks beside a page: the time must not be specks times pixels."""
    rng = np.random.default_rng(3)
    mask = rng.random((500, 500)) < 0.15
    mask[100:400, 100:400] = True
    began = time.perf_counter()
    labels, n = V.components(mask)
    page = V.main_component(mask)
    assert n > 10_000 and time.perf_counter() - began < 2
    assert page[100:400, 100:400].all() and (labels > 0).sum() == mask.sum() and (labels[page] == labels[250, 250]).all()


def test_lines_are_taken_by_votes():
    """The same lines as by looking for the most votes again after each line."""
    rng = np.random.default_rng(4)
    for shape in ((40, 60), (61, 33)):
        edges = rng.random(shape) < 0.05
        edges[10, 5:30] = edges[5:35, 20] = True
        ys, xs = np.nonzero(edges)
        size = int(np.ceil(np.hypot(*shape)))
        counts = np.stack([np.bincount(np.round(xs * np.cos(t) + ys * np.sin(t)).astype(int) + size, minlength=2 * size + 1) for t in np.radians(np.arange(180))])
        want = []
        while len(want) < 25 and counts.max() >= 6:
            a, r = np.unravel_index(int(np.argmax(counts)), counts.shape)
            want.append((float(a), float(r - size), int(counts[a, r])))
            for da in range(-3, 4):
                b, at = (a + da) % 180, r if 0 <= a + da < 180 else 2 * size - r
                counts[b, max(0, at - 4) : at + 5] = 0
        assert V.hough_lines(edges, 6, 25) == want and len(want) > 5


def test_whole_greys_are_looked_up():
    grey = np.random.default_rng(5).integers(0, 256, (30, 40)).astype(np.uint8)
    for got, want in zip(V.plain_paper(grey), V.plain_paper(grey.astype(float)), strict=True):
        assert (got == want).all()
