"""Edit logs against plain lists."""

import random

from vellum.operators import edits as O

OPS = ("add", "remove", "replace", "replace_range", "replace_named", "reorder", "rotate", "label", "odd", None)


def carried_out(pages, op, index, other, named, brought, text):
    """The pages after an edit, or None."""
    n, new = len(pages), [(b, 0, None) for b in brought]
    if op == "add":
        return pages + new
    if op == "replace_named":
        hit = [k for k, p in enumerate(pages) if p[0] in named]
        rest = [p for p in pages if p[0] not in named]
        return rest[: hit[0]] + new + rest[hit[0] :] if hit else None
    if op not in OPS[1:8] or index < 0 or index >= n + (op == "replace_range"):
        return None
    if op == "replace_range":
        return None if other < 0 or index + other > n else pages[:index] + new + pages[index + other :]
    head, (page, turn, label), tail = pages[:index], pages[index], pages[index + 1 :]
    if op == "reorder":
        rest = head + tail
        return rest[:other] + [pages[index]] + rest[other:] if 0 <= other < n else None
    return head + {"remove": [], "replace": new, "rotate": [(page, (turn + 90) % 360, label)], "label": [(page, turn, label if text is None else text)]}[op] + tail


def check(spark, sessions, logs):
    pages = [(s, k + 1, raw, turn) for s, rows in sessions.items() for k, (raw, turn, _) in enumerate(rows)]
    p = spark.createDataFrame(pages, "s string, no int, raw string, turn int").repartition(3)
    e = spark.createDataFrame([(s, i, *edit) for s, log in logs.items() for i, edit in enumerate(log)], "s string, seq long, op string, index int, other int, named array<string>, brought array<string>, text string").repartition(3)
    fold = O.folded(p, e, "s", "no", "raw")
    want, decided = [], []
    for s in {*sessions, *logs}:
        at = sessions.get(s, [])
        for i, edit in enumerate(logs.get(s, [])):
            new = carried_out(at, *edit)
            decided.append((s, i, new is not None))
            at = at if new is None else new
        want += [(s, k + 1, *page) for k, page in enumerate(at)]
    assert sorted(tuple(r) for r in O.decisions(fold, "s").collect()) == sorted(decided)
    assert sorted(map(str, map(tuple, O.pages_left(fold, p, e, "s", "no", "raw", "turn").collect()))) == sorted(map(str, want))
    return want


def test_logs_of_hundreds_of_edits(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 4)  # many blocks
    rng = random.Random(7)
    sessions = {f"s{k}": [(f"p{k}.{i}", rng.choice([0, 90, 270]), None) for i in range(rng.choice([0, 1, 3, 40]))] for k in range(12)}
    logs = {}
    for k in range(14):  # two logs of sessions without pages
        names, log = [raw for raw, *_ in sessions.get(f"s{k}", [])], []
        for i in range(300 if k % 2 else 40):
            op = rng.choice(OPS)
            brought = [f"n{k}.{i}.{j}" for j in range(rng.randrange(4))] if op in ("add", "replace_range", "replace_named") else [f"n{k}.{i}"] if op == "replace" else []
            names += brought
            log.append((op, rng.randrange(-1, 30), rng.randrange(-1, 6), rng.sample(names, min(len(names), 3)) + ["unknown"], brought, rng.choice([None, f"t{i}"])))
        logs[f"s{k}"] = log
    assert len(check(spark, sessions, logs)) > 100


def test_no_edits_and_no_pages(spark):
    assert check(spark, {"a": [("x", 0, None), ("y", 90, None)]}, {}) == [("a", 1, "x", 0, None), ("a", 2, "y", 90, None)]
    assert check(spark, {}, {"a": [("remove", 0, 0, [], [], None)]}) == []


def test_a_long_log_moves_pieces_not_pages():
    """A hundred thousand pages, twenty thousand edits."""
    rng = random.Random(1)
    pieces = O.Pieces(100_000)
    for i in range(20_000):
        assert O.apply(pieces, i, rng.choice(["reorder", "rotate", "replace_range"]), rng.randrange(90_000), rng.randrange(3), 2, set(), None)
    assert max(map(len, pieces.blocks)) <= 2 * O.BLOCK + 3 and sum(p.hi - p.lo for p in pieces) == len(pieces)
