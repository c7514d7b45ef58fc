"""Codes of vectors against plain Lloyd rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from vellum.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label string, code string, _label string, slot string, n string"


def plain_codes(rows, length):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = length // 4
    books = [[r[1][p * w : (p + 1) * w] for r in kept[:256]] for p in range(4)]
    parts = [[r[1][p * w : (p + 1) * w] for r in kept] for p in range(4)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(4):
        for p in range(4):
            mine = {}
            for part in parts[p]:
                mine.setdefault(nearest(part, books[p])[0], []).append(part)
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if e in mine else entry for e, entry in enumerate(books[p])]
    out = []
    for k, (i, _, label) in enumerate(kept):
        found = [nearest(parts[p][k], books[p]) for p in range(4)]
        out.append([i, label, "".join(f"{e:02x}" for e, _ in found), min(sum(d for _, d in found), (1 << 63) - 1)])
    total = {}
    for _, label, _, error in out:
        total[label] = min(total.get(label, 0) + error, (1 << 63) - 1)
    return sorted(str((i, label, code, error, total[label])) for i, label, code, error in out), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, *["x"] * 4) for i, v, label in rows], SCHEMA).repartition(parts)


def check(spark, rows, length):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got, books = codes.compress(table(spark, rows))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    want, digest = plain_codes(rows, length)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert hashlib.sha256(codes.written(books).encode()).hexdigest() == digest


def odd_vectors(rng, n, dims):
    centres = rng.normal(size=(40, dims))
    rows = [(i, (centres[i % 40] + rng.normal(size=dims) * 0.05 * (i % 3)).tolist(), ["a", None, "b", ""][i % 4]) for i in range(n)]
    rows += [(n + k, rows[0][1], "a") for k in range(150)]  # one very common vector
    rows += [(3, rows[5][1], None), (3, rows[5][1], None), (None, rows[7][1], "null key")]  # repeated and null keys
    bad = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [0.0] * (dims - 1), [0.0] * (dims + 4)]
    return rows + [(10_000 + k, v, "bad") for k, v in enumerate(bad)]


def test_codes(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 100)
    monkeypatch.setattr(codes, "LEAF", 5)
    check(spark, odd_vectors(np.random.default_rng(0), 500, 8), 8)


@pytest.mark.parametrize("scale", [1e4, 1e9, 3e37])
def test_large_components_stay_exact(spark, scale):
    """Beyond what doubles bear, in Python's integers; errors beyond a long are the greatest long."""
    rng = np.random.default_rng(1)
    check(spark, [(i, (rng.integers(-9, 9, 4) * scale).tolist(), "ab"[i % 2]) for i in range(60)] + [(99, [0.5, -0.25, 1e-30, -1e-30], "a")], 4)


def test_few_and_none(spark):
    check(spark, [(5, [0.1, 0.2, 0.3, -0.4], "x"), (2, [1.0, 1.0, 1.0, 1.0], None)], 4)
    got, books = codes.compress(table(spark, [(1, None, "a")]))
    assert got.count() == 0 and books == [[], [], [], []]


def test_trees_strike_out_entries_and_keep_ties():
    """Grids full of ties: the lowest of the nearest entries, for every point; clustered points are taken as whole subtrees."""
    rng = np.random.default_rng(2)
    for top, dtype in ((3, np.float64), (30, np.float64), (3, object)):
        points = rng.integers(0, top, (700, 3)).astype(dtype)
        entries = rng.integers(0, top, (50, 3)).astype(dtype)
        order, nodes = codes.grow(points)
        assert sorted(order.tolist()) == list(range(700))
        tree = codes.Tree(points, order, np.array(nodes))
        far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert codes.assigned(tree, entries).tolist() == np.argmin(far, axis=1).tolist()
    centres = rng.integers(-1000, 1000, (20, 4)) * 100.0
    points = centres[rng.integers(0, 20, 5000)] + rng.integers(-5, 5, (5000, 4))
    order, nodes = codes.grow(points)
    tree = codes.Tree(points, order, np.array(nodes))
    whole, leaves = codes.filtered(tree, centres)
    taken = sum(int(tree.nodes[n, 1] - tree.nodes[n, 0]) for n, _ in whole)
    assert taken > 4000 and taken + sum(e - s for s, e, _ in leaves) == 5000
