"""Collocations against counting everything in one place."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        for p, a in counts.items():
            if len(p) == 1 or a < least:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), p, counts[p[:k]], counts[p[k:]]))
        longer = Counter()
        for *_, p, _, _ in kept:
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], counts[p])
        kept = sorted(x for x in kept if 100 * longer[x[3]] < share * -x[1])
        out += [(lang, i + 1, x[2].decode(), -x[1], x[4], x[5], n[lang], -x[0]) for i, x in enumerate(kept[:top])]
    return sorted(out)


def rows_of_words(rng):
    words = np.array(["the", "of", "A", "b.c", "d", "É", "é", "stop!", "ﬀ", "x y z", "漢字", "-", "to be or", "Q\t", " ", "\x00"])
    rows = [(" ".join(words[np.minimum(rng.geometric(0.25, 40) - 1, len(words) - 1)]), ["en", None, "und", "fr"][i % 4]) for i in range(120)]
    rows += [("a a a a, a a\na", "en")] * 30 + [("new york city hall", "fr")] * 12 + [("new york city", "fr")] * 5 + [("york new", "fr")] * 3
    return rows + [(None, "en"), ("", "de"), (" \t ", None), ("word " * 30_000, "es"), ("x" * 50_000 + " tail", "es")]


def matches(spark, docs, rows):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs).select(*COLUMNS).collect())
    assert got == plain(rows)


@pytest.mark.parametrize("small", [{}, {"LISTED": 4, "SPLIT": 20, "CHUNK": 50}, {"BITS": 7, "LISTED": 6}, {"BITS": 7, "CHUNK": 100}])
def test_collocations(spark, monkeypatch, small):
    """Whole lists; most words beyond the list, common pivots dealt out, small stretches; words that share their hash."""
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    rows = rows_of_words(np.random.default_rng(0))
    matches(spark, spark.createDataFrame([(t, lang, "x", "y") for t, lang in rows], "text string, lang string, word string, f string").repartition(3), rows)


def test_odd_and_empty(spark, odd, empty):
    matches(spark, odd, [(r["text"], r["lang"]) for r in odd.select("text", "lang").collect()])
    assert collocations.collocations(empty).count() == 0


def test_first_of_many(spark):
    """More phrases than are returned, of one language, most with one score."""
    rows = [(f"p{i} q{i} " * 12, "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for top in (1, 7, 300):
        got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, top=top).collect())
        assert got == plain(rows, top=top)


def test_scores_of_large_counts_are_exact(spark):
    big = [9_000_000_000_000_001, 8_999_999_999_999_989, 3_037_000_499_976_049]
    found = spark.createDataFrame([(1, 2, 0, big[2]), (1, 2, 3, big[2] - 7)], "a long, b long, c long, f long")
    found = found.unionByName(spark.createDataFrame([(2, 3, 0, big[2] - 1)], "a long, b long, c long, f long"))
    names = spark.createDataFrame([(1, "en", "x", big[0]), (2, "en", "y", big[1]), (3, "en", "z", big[2])], "id long, lang string, word string, f long")
    got = {r["phrase"]: (r["f"], r["l"], r["r"], r["score"]) for r in collocations.scored(found, names).collect()}
    assert got["x y"] == (big[2], big[0], big[1], 1000000 * big[2] ** 2 // (big[0] * big[1]))
    cuts = [(1000000 * (big[2] - 7) ** 2 // (left * right), left, right) for left, right in ((big[0], big[2] - 1), (big[2], big[2]))]
    assert got["x y z"] == (big[2] - 7, cuts[0][1], cuts[0][2], cuts[0][0]) and cuts[0][0] < cuts[1][0]
