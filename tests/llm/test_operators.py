"""Each operator against a plain version, on odd rows and on none."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import components, decontaminate, dedup, langid, mix, neardup, pii, quality, shards, substrings, tokens
from vellum.llm.common import with_rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY_ARGS = {"key": "doc_id", "text": "text"}


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


def key(d):
    return (d is None, d or 0)


def is_held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0


# 1: language


def test_language_learns_and_rejects(spark, odd, tmp_path):
    words = {"aa": "bada gado labo mora".split(), "bb": "skrit klunk vrest pflog".split()}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2] * 2], 30)), "ab"[i % 2] * 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.predict(docs.drop("lang"), model).collect()
    wrong = [r["doc_id"] for r in got if r["lang_pred"] != "ab"[r["doc_id"] % 2] * 2]
    assert not wrong and all(0 <= r["score"] <= 1 and not r["rejected"] for r in got)
    blank = langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 3")], "doc_id long, text string"), model).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in blank} == {("und", 0.0, True)}


def test_language_of_held_out_documents(spark):
    """Four languages of made-up words that share letters: documents kept from training, of which none was seen, are told nine times in ten."""
    rng = np.random.default_rng(3)
    lexicon = {lang: ["".join(rng.choice(list("abdeiklmnorstu"), rng.integers(3, 8))) for _ in range(80)] for lang in ("aa", "bb", "cc", "dd")}
    rows = [(i, " ".join(rng.choice(lexicon[lang], rng.integers(8, 40))), lang) for i in range(1200) for lang in [("aa", "bb", "cc", "dd")[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in langid.predict(docs, langid.fit(docs)).collect() if is_held_out(r["doc_id"])]
    assert len(got) > 150 and sum(r["lang_pred"] == r["lang"] for r in got) > 0.9 * len(got)
    same = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert len(langid.fit(same).labels) in (0, 4) and len(langid.fit(docs.withColumn("doc_id", F.lit(3).cast("long"))).labels) == 4


def test_language_odd_and_empty(odd, empty):
    got = langid.predict(odd, langid.fit(odd))
    assert got.count() == odd.count() and {"lang_pred", "score", "rejected"} <= set(got.columns)
    for r in got.collect():
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(map(str.isalpha, r["text"])))
    none = langid.predict(empty, langid.fit(empty))
    assert none.count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


def test_held_out(odd):
    for r in odd.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect():
        assert r["h"] == is_held_out(r["doc_id"])


# 2: mixing


def test_mix(odd, empty):
    got = mix.mix(odd).collect()
    assert bag((r["doc_id"], r["size"]) for r in got) == bag((d, len(WORD.findall(t or ""))) for d, t in rows_of(odd))
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["copies"] in (0, 1, 2)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = sum(r["size"] for r in got)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    full: set = set()
    while True:  # share what is left by weight until none is above its limit
        left = 1.5 * total - sum(2 * size[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] >= 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        want = 2 * size[s] if s in full else level * weight[s]
        taken, largest = sum(r["taken"] for r in by[s]), max(r["size"] for r in by[s])
        assert {r["source_size"] for r in by[s]} == {size[s]}
        assert abs(by[s][0]["target"] - want) < 1e-6 and abs(taken - want) <= largest
    assert bag((r["doc_id"], r["taken"]) for r in mix.mix(odd).collect()) == bag((r["doc_id"], r["taken"]) for r in got)
    copies = bag((r["doc_id"], r["size"]) for r in got for _ in range(r["copies"]))
    assert bag((d, len(WORD.findall(t or ""))) for d, t in rows_of(mix.mixed(odd))) == copies
    assert mix.mixed(odd).columns == odd.columns
    assert mix.mix(empty).count() == 0 and mix.mixed(empty).count() == 0


# 3: exact dedup


def test_dedup(odd, empty):
    norm = [(d, SPACE.sub(" ", t or "")) for d, t in rows_of(odd)]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    want = bag((d, min(groups[t], key=key), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm)
    got = dedup.dedup(odd).collect()
    assert bag((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert dedup.dedup(empty).count() == 0


def test_dedup_by_ranges(spark, odd, monkeypatch):
    """Many small filters instead of one find the same groups."""
    want = sorted(map(str, dedup.dedup(odd).collect()))
    monkeypatch.setattr(dedup, "MAX_CELLS", 64)
    monkeypatch.setattr(dedup, "SEGMENT", 64)
    assert dedup.cells_for(1000) == 64
    assert sorted(map(str, dedup.dedup(odd).collect())) == want


def test_bloom_filter_finds_all_repeats(spark):
    rows = [(hashlib.sha256(str(i % 700).encode()).digest(),) for i in range(1000)]
    df = spark.createDataFrame(rows, "digest binary").repartition(5)
    seen = Counter(r[0] for r in rows)
    got = dedup.flag_repeated(df, "digest", 1000).collect()
    assert all(r["maybe"] for r in got if seen[bytes(r["digest"])] > 1)
    assert sum(r["maybe"] for r in got if seen[bytes(r["digest"])] == 1) < 40


# 4: sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3000)
    for n in (1, 2, 24, 25, 1000):
        assert shards.jump_hash(keys, n).tolist() == [jump(int(k) % 2**64, n) for k in keys]
    a, b = shards.jump_hash(keys, 24), shards.jump_hash(keys, 25)
    assert set(b[a != b].tolist()) == {24}


def test_shards(odd, empty, tmp_path):
    got = shards.assign(odd).collect()
    assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == bag((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows_of(odd))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert shards.assign(empty).count() == 0
    shards.write(odd.select("doc_id", "text"), str(tmp_path / "out"), files=2)
    assert bag(rows_of(odd.sparkSession.read.parquet(str(tmp_path / "out")))) == bag(rows_of(odd))
    with pytest.raises(ValueError):
        shards.with_shards(odd, 0)


# 5: personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in p.finditer(text) if good[k](m.group())] for k, p in PLAIN.items()}


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(7)
    for alphabet in ("a@.-b1 ", "0123.4- 567", "+1 ().-9x", "1.2@a.3 -+"):
        for _ in range(1500):
            text = "".join(rng.choice(list(alphabet), rng.integers(1, 40)))
            assert pii.base_spans(text) == plain_spans(text), text
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "+1" + " " * 100_000)  # in linear time


def test_personal_data(spark, odd, empty):
    text = "é mail bob.x@mail.example.org now, ip 10.0.0.255 or 10.0.0.256; card 4111 1111 1111 1111, call +1 (310) 555-4510 or phone (212) 555-0187, ann [at] site [dot] com"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (None, "")], "doc_id long, text string")
    got = pii.find(docs).collect()
    for r in got:
        want = plain_spans(text if r["doc_id"] == 1 else "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        base = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in want[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r["spans"].split(",")) and r["n_spans"] == len([x for x in r["spans"].split(",") if x])
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0


def test_personal_data_adds_spans(spark):
    """Written-out addresses and numbers after their cues are added, at their places; numbers of chapters and orders are not."""
    rows = []
    for i in range(400):
        rows.append((i, f"please contact mail ann{i}@mail.example.org or call phone +1 310 555 {1000 + i} about card 4111 1111 1111 1111 at host 10.0.0.{i % 250}"))
    rows += [(1000, "é contact mail ann [at] site [dot] com today"), (1001, "call phone (212) 555-0187 now"), (1002, "see chapter 12, order 4711 and page 9"), (1003, None)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000]["spans"] == "email:15:38" and got[1001]["spans"] == "phone:11:25"
    assert got[1002]["spans"] == "" and got[1003]["spans"] == "" and got[1000]["n_email"] == 0
    assert all(got[i]["n_spans"] == 4 for i in range(400))


def test_expectation_maximisation_trusts_those_who_agree():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    good = np.where(rng.random((4000, 3)) < 0.9, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes = np.concatenate((good, rng.choice([-1, 1], (4000, 1))), axis=1)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, table, prior = pii.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.4) < 0.05 and ((posterior[place.ravel()] > 0.5) == truth).mean() > 0.95
    assert table[1, 0, 2] > 0.8 and abs(table[1, 3, 2] - 0.5) < 0.1


# 6: near duplicates


def shingle_sets(rows):
    out = []
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        out.append((d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def plain_components(rows, percent):
    sets = shingle_sets(rows)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        groups[find(i)].append(d)
    return [(d, len(s), min(groups[find(i)], key=key)) for i, (d, s) in enumerate(sets)]


def test_near_duplicates(odd, empty):
    for percent in (85, 80):
        got = neardup.near_duplicates(odd, percent).collect()
        assert bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == bag(plain_components(rows_of(odd), percent))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.keep_first(odd, 80)
    assert kept.columns == odd.columns
    groups = {c for d, n, c in plain_components(rows_of(odd), 80) if n}
    blank = sum(1 for d, n, c in plain_components(rows_of(odd), 80) if not n)
    assert kept.count() == len(groups) + blank
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_first(empty).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_that_drift(spark, tmp_path, monkeypatch, block):
    """A chain of copies of copies: neighbours are alike, the ends are not, and no pair with the first of all may be enough; in one block or in many."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CELLS", block * 10)
    rng = np.random.default_rng(3)
    words = [f"w{rng.integers(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(words)))
        words[int(rng.integers(150))] = f"v{i}"
        if i % 40 == 39:
            for k in range(0, 150, 6):
                words[k] = f"u{i}x{k}"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == bag(plain_components(rows, 85))


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# 7: benchmark decontamination


def token_list(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_masks_reach_every_overlap():
    from itertools import combinations

    for length, errors in ((12, 2), (11, 1), (10, 1), (9, 1), (8, 1)):
        for wrong in combinations(range(length), errors):
            for first in range(decontaminate.STRIDE):
                assert any(
                    not any(t + k in wrong for k, c in enumerate(m) if c == "1")
                    for m in decontaminate.MASKS for t in range(length - len(m) + 1) if (t + first) % decontaminate.STRIDE == 0
                )


def test_decontamination(spark, odd, empty, tmp_path):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"b{rng.integers(60)}" for _ in range(n))) for i, n in enumerate((7, 8, 10, 12, 20, 40, 40))] + [(5, None), (None, ""), (8, "odd one here of nine words in all, yes!")]
    rows = []
    for i in range(60):
        w = [f"b{rng.integers(60)}" for _ in range(40)]
        its = token_list(items[i % 7][1])
        start = int(rng.integers(0, 20))
        piece = its[: 13 if i % 3 else len(its)]
        for _ in range(i % 4):
            piece[int(rng.integers(len(piece)))] = "wrong"
        w[start : start + len(piece)] = piece
        rows.append((i, " ".join(w).title() + "!"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs, bench = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in rows:
        w = token_list(t)
        for item, text in items:
            its = token_list(text)
            width = min(12, len(its))
            best = max((sum(w[p + k] == its[q + k] for k in range(width)) for q in range(len(its) - width + 1) for p in range(len(w) - width + 1)), default=0)
            if len(its) >= 8 and best >= width - width // 6:
                want[d, item] = best
    got = {(r["doc_id"], r["item_id"]): r["agree"] for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == want and len(want) > 15
    cleaned = decontaminate.clean(docs, bench)
    assert {r["doc_id"] for r in cleaned.collect()} == {d for d, _ in rows} - {d for d, _ in want} and cleaned.columns == docs.columns
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(odd, bench.limit(0)).count() == 0


# 8: token ids

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_token_ids(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = ["a  b", "  x", "x \n y", "\n\n z", "don't  's", "x  y", "a\x1cb \x1c c", "tab\t x", "end ", " ", "é ñ", "<|endoftext|> hi", "a, b. c"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 5000)), "doc_id long, text string"))
    tokens.write(docs, str(tmp_path / "t"), path)
    plain = Tokenizer.from_file(path)
    ids = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows_of(docs)]
    got = tokens.read_documents(tokens.read(spark, str(tmp_path / "t"))).collect()
    assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == bag((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order, key=lambda d: (d is not None, d or 0))
    found = tokens.lookup(spark, str(tmp_path / "t"), [5001, 3, 987654])
    want = dict(ids)
    assert {k: v.tolist() for k, v in found.items()} == {5001: want[5001], 3: want[3]}
    assert tokens.lookup(spark, str(tmp_path / "t"), []) == {}
    tokens.write(docs, str(tmp_path / "u"), path, cut=False)
    again = tokens.read_documents(tokens.read(spark, str(tmp_path / "u"))).collect()
    assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in again) == bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)
    tokens.write(empty, str(tmp_path / "e"), path)
    assert tokens.read_documents(tokens.read(spark, str(tmp_path / "e"))).count() == 0


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
        levels, bits, number = tokens.build_index(keys)
        assert sorted(number.tolist()) == list(range(len(keys)))
        prints, places = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int32)
        prints[number], places[number] = tokens.fingerprint(keys), np.arange(len(keys))
        index = tokens.Index(levels.tobytes(), bits.tobytes(), prints.tobytes(), places.tobytes())
        assert index.find(keys).tolist() == list(range(len(keys)))
        assert (index.find(keys + 1 if n else np.array([3, 4])) == -1).all()


# 9: substrings


def plain_substrings(rows):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in range(80):
        for top in (1, 2, 5):
            t = rng.integers(1, top + 1, n)
            assert substrings.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("most", [2000, 1])
def test_substrings(spark, odd, empty, tmp_path, monkeypatch, most):
    """Repeated keys, nulls, a long text, and a passage that many documents share, with one task's bound and with the least: everything is split."""
    monkeypatch.setattr(substrings, "MOST", most)
    rng = np.random.default_rng(5)
    rows = rows_of(odd)
    shared = ["".join(rng.choice(list("abcdé "), 400)) for _ in range(4)]
    rows += [(1000 + i, "".join(rng.choice(list("abcd "), 80)) + shared[i % 4][i : 100 + 5 * i] + "".join(rng.choice(list("abcd "), 50)) * (i % 3) + "é" * (i * 4)) for i in range(50)] + [(2000, None), (2001, "ab" * 300)]
    passage = "".join(rng.choice(list("etaoin shrdlu"), 150))
    rows += [(3000 + i // 2, "".join(rng.choice(list("xyz "), 3 + i % 60)) + passage + "".join(rng.choice(list("xyz "), 3 + i % 50))) for i in range(300)]
    if most > 1:
        monkeypatch.setattr(substrings, "PIECE", 1 << 16)
        rows.append((4000, "".join(rng.choice(list("abcdefgh "), 300_000)) + passage + shared[0] * 2))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    in_order = [(r["doc_id"], r["text"]) for r in with_rows(docs, doc_id="doc_id", text="text").orderBy("row").collect()]
    got = substrings.dedup_substrings(docs).drop("spans").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(**dict(zip(got[0].__fields__, r, strict=True)))) for r in plain_substrings(in_order))
    if most > 1:
        assert substrings.dedup_substrings(odd).count() == odd.count() and substrings.dedup_substrings(empty).count() == 0


def test_substrings_of_texts_longer_than_a_piece(spark, tmp_path):
    """At the constants as shipped: a text of several pieces, with copies across the ends of pieces, within it, and in short texts."""
    rng = np.random.default_rng(8)
    long = "".join(rng.choice(list("abcdefghijklmnop "), 2_300_000))
    around = [long[(k << 20) - 400 : (k << 20) + 400] for k in (1, 2)]
    rows = [(1, "x" * 30 + around[0]), (2, None), (3, long + long[5000:5600]), (4, "short " * 3), (5, around[1] + "y"), (6, long[1_500_000:1_500_300])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    got = substrings.dedup_substrings(spark.read.parquet(str(tmp_path / "d"))).drop("spans").collect()
    assert len(long) > 2 * substrings.PIECE
    assert sorted(tuple(r) for r in got) == sorted(plain_substrings(rows))


def test_rows_are_the_same_in_every_scan(spark, tmp_path):
    """However many tasks a scan has: row numbers, and what operators make of them."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(150)]
    rows = [(i, texts[i % 150] + (" end" if i % 7 else ""), "ab"[i % 2]) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).write.option("parquet.block.size", "8192").parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts[::10])], "item_id long, text string")
    seen, before = [], spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    try:
        for tasks in ("2", "16"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", tasks)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k" if tasks == "16" else "4m")
            docs = spark.read.parquet(str(tmp_path / "d"))
            numbers = {(r["row"], r["doc_id"]) for r in with_rows(docs, doc_id="doc_id").collect()}
            results = [neardup.near_duplicates(docs), neardup.keep_first(docs), decontaminate.clean(docs, bench), mix.mixed(docs), substrings.dedup_substrings(docs), dedup.dedup(docs)]
            seen.append((numbers, [sorted(map(str, r.collect())) for r in results]))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert seen[0] == seen[1] and len(seen[0][0]) == 600


def test_tables_that_are_not_files_are_numbered_too(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "doc_id long, text string, _file string")
    assert sorted(r["doc_id"] for r in with_rows(docs, doc_id="doc_id").collect()) == [1, 2]
    assert with_rows(docs).columns == ["_0", "_1", "_2", "row"]


# 10: quality


def test_quality(spark, odd, empty):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(600):
        good = i % 4 > 0
        words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(60)]
        rows.append((i, ". ".join(words) if good else "&&& ".join(words[:6] * 10)))
        marks.append((i, int(good)))
    marks += [(1, 0), (2, None), (None, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    held = [r for r in got if is_held_out(r["doc_id"])]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    strange = quality.score(odd, model)
    assert strange.count() == odd.count() and strange.filter("score IS NULL").count() == 0
    assert quality.score(empty, model).count() == 0
    assert {r["score"] for r in quality.score(docs.limit(3), quality.fit(docs, labels.limit(0))).collect()} == {0.5}
