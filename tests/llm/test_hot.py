"""One key on most rows, filters in ranges, and what gazetteers say."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import decontaminate, dedup, langid, mix, pii


def test_mix_of_one_key_on_all_rows(spark, tmp_path, monkeypatch):
    """Rows of a shared key take turns of their own: no group holds them all, sources come near their targets, reruns agree."""
    monkeypatch.setattr(mix, "GROUP_ROWS", 50)
    rows = [(None if i % 3 else 7, "word " * (1 + i % 9), "abc"[i % 3]) for i in range(3000)] + [(5, None, "d")] * 400 + [(9, " ", "d")] * 400
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    queues, copies = mix.queue(docs, "doc_id", "text", "source", 1.5, 2, (3, 1, 2))
    assert max(Counter(r["turn"] for r in queues.select("turn").collect()).values()) == 1
    assert max(r["count"] for r in copies.groupBy("range").count().collect()) < 600
    got = mix.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert len(got) == len(rows) and target["d"] == 0
    assert {s: round(taken[s] - target[s]) for s in "abc" if abs(taken[s] - target[s]) >= 20} == {}
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(docs).collect()))


def test_targets_are_shared_round_by_round(spark):
    """Against sharing the budget by weight, again and again, among the sources that are not at their limit; targets add up to the budget."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 20, 60):
        sizes = {f"s{i:02}" if i else None: int(x) for i, x in enumerate(rng.choice([0, 1, 50, 1000, 1100, 1200, 90_000], n))}
        got = {r["source"]: r["target"] for r in mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 1.5, 2, (3, 1, 2)).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        want, free, left = {}, set(order), 1.5 * sum(sizes.values())
        while free:
            level = left / sum(weight[s] for s in free)
            full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
            want |= {s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in free}
            left -= sum(2 * sizes[s] for s in full)
            free = free - full if full else set()
        assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_seeds_that_all_documents_have(spark, tmp_path, monkeypatch):
    """A passage in every document and in many items, with all joins by shuffle: the same overlaps as with broadcasts, no task with all rows of a seed."""
    common = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"a{i} b{i} {common} c{i}" if i % 4 else f"only {i}") for i in range(2000)] + [(None, None), (7, "")]
    items = [(i, f"{common} tail{i}") for i in range(5)] + [(9, " ".join(f"z{i}" for i in range(20))), (10, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs, bench = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.overlaps(docs, bench).collect()))
    assert len(want) == 5 * 1500
    for name in ("BROADCAST_SEEDS", "BROADCAST_ITEMS", "BROADCAST_ROWS"):
        monkeypatch.setattr(decontaminate, name, 0)
    asked = []
    dealt = decontaminate.join_dealt

    def watched(table, groups, key, size, total, sizes):
        copies = dealt(table, groups, key, size, total, most=100, sizes=sizes)
        asked.append((key, groups.agg({size: "max"}).first()[0], total))
        return copies

    monkeypatch.setattr(decontaminate, "join_dealt", watched)
    assert sorted(map(str, decontaminate.overlaps(docs, bench).collect())) == want
    assert [k for k, _, _ in asked] == ["seed", "item"] and all(most == 1500 for _, most, _ in asked)
    assert decontaminate.clean(docs, bench).count() == 502


@pytest.mark.parametrize("most", [1 << 28, dedup.SEGMENT])
def test_filter_in_ranges(spark, monkeypatch, most):
    """Packed counting: every repeated digest is flagged, few others are; with one filter and with one a range."""
    monkeypatch.setattr(dedup, "MAX_CELLS", most)
    rng = np.random.default_rng(0)
    names = [f"n{i}" for i in range(9000)] + [f"n{i}" for i in rng.integers(0, 300, 500)] + ["hot"] * 2000
    times = Counter(names)
    table = spark.createDataFrame([(n, hashlib.sha256(n.encode()).digest()) for n in names], "n string, digest binary").repartition(6)
    got = dedup.flagged(table, "digest").collect()
    assert Counter(r["n"] for r in got) == times and all(r["maybe"] for r in got if times[r["n"]] > 1)
    assert sum(r["maybe"] for r in got if times[r["n"]] == 1) < 300


def test_gazetteers():
    def known(kind, span):
        return pii.votes(kind, span, "")[1]

    assert [known("card", c) for c in ("4111 1111 1111 1111", "5500-0000-0000-0004", "9999 9999 9999 9995", "3782 822463 10005", "4111 1111 1111 11")] == [1, 1, -1, 1, -1]
    assert [known("phone", p) for p in ("+49 30 1234567", "+999 1234567", "(212) 736-5000", "012-345-6789", "212-555-0199")] == [1, -1, 1, -1, -1]
    assert [known("ip", a) for a in ("8.8.8.8", "192.168.1.7", "172.20.0.1", "172.32.0.1", "2001:db8:0:0:0:0:0:1", "2a00:1450:4001:0:0:0:0:200e", "240.1.1.1")] == [1, -1, -1, 1, -1, 1, -1]
    assert [known("email", e) for e in ("a at b dot com", "a at b dot zzz")] == [1, -1]


def test_every_label_is_learned(spark):
    """More labels than a list of the commonest would have, of few documents each, and a text longer than a piece; the factors score as their product does."""
    rng = np.random.default_rng(0)
    lexicon = ["".join(rng.choice(list("abdeiklmnorstu"), 6)) for _ in range(260)]
    rows = [(i, f"{lexicon[i % 260]} " * 30, f"l{i % 260}") for i in range(1300)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 260 and model.table.shape[1] == langid.DIMENSIONS
    letters = langid.letters()
    few = langid.Model(model.labels[:3], model.table, model.weights[:, :3], model.bias[:3])
    for text in (rows[1][1], rows[2][1] * 7000):
        ids = langid.gram_ids(text, letters)
        plain = (model.table[ids].astype(float) @ model.weights).mean(axis=0) + model.bias
        assert np.allclose(langid.logits(model, text, letters), plain, atol=1e-3) and np.allclose(langid.logits(few, text, letters), plain[:3], atol=1e-3)
