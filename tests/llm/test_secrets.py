"""Secrets: base spans against plain patterns, standing by ownership."""

import hashlib
import random
import re

import pytest

from vellum.llm import secrets

KEY = "Zq7Lw2Xv9Rt4Kp6Ns1Bd8Hf3"
COPIED = "Tb5Yc1Qm8Wz3Jg7Vd2Px6Ra9"


def plain_base(text):
    found = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.ASCII):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16))):
        found += [(m.start(), k + 1, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if m.end() - m.start() >= least]
    return [s for *_, s in sorted(found)]


def odd_texts(rng):
    pieces = ["password", "PassWd", "token", "TOKEN", "api_key", "ApiKey", "secret", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "DEADBEEF0123", "Aa0+/_.-", "=" * 3, "é", "漢", "\n", "\t", ".", "hunter2hunter2"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(600)]


def test_base_spans_are_those_of_the_plain_patterns():
    for text in odd_texts(random.Random(3)) + ["a" * 50_000, "AKIA" * 9000, "token" + " " * 20_000, "token =" * 5000 + "abcdefabcdef1"]:
        assert [f"{k}:{s}:{e}" for k, s, e, _ in secrets.base_spans(text)] == plain_base(text)


@pytest.fixture(scope="module")
def found(spark, odd):
    rows = [(5000 + i, f"set pwd = {COPIED} and go", f"owner{i % 6}") for i in range(40)]  # many owners
    rows += [(5100 + i, f"set pwd = {KEY} é now", "one") for i in range(9)]  # one owner, many repositories
    rows += [(5200, f'é token = "{COPIED}"', "one"), (5201, f"api_key={KEY}", None), (5202, "pwd = your_password_here_1", "one"), (5203, "https://me:Xk29dkQ0zz1p@host/x", "two"), (5204, "TOKEN = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"", "two")]
    rows += [(300 + i, t, None) for i, t in enumerate(odd_texts(random.Random(4))[:60])]
    extra = odd.drop("row").select("doc_id", "text", "source")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(extra)
    return docs.collect(), secrets.find(docs).collect()


def test_every_row_and_its_base_spans(found):
    rows, got = found
    want = sorted((str(r["doc_id"]), plain_base(r["text"])) for r in rows)
    assert sorted((str(r["doc_id"]), [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"] if s["base"]]) for r in got) == want
    for r in got:
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"] if s["base"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in secrets.KINDS]
        assert [(s["start"], secrets.KINDS.index(s["kind"])) for s in r["secrets"]] == sorted((s["start"], secrets.KINDS.index(s["kind"])) for s in r["secrets"])


def test_owners_tell_examples_from_secrets(found):
    rows, got = found
    text = {r["doc_id"]: r["text"] for r in rows}
    by = {r["doc_id"]: [(text[r["doc_id"]][s["start"] : s["end"]], s["base"], s["standing"], s["owners"], s["repositories"]) for s in r["secrets"]] for r in got if (r["doc_id"] or 0) in range(5000, 5300)}
    assert by[5030] == []  # copied: no candidate of it stands
    assert by[5103] == [(f"pwd = {KEY}", False, "live", 2, 10)]
    assert by[5200] == [(f'token = "{COPIED}', True, "copied", 7, 41)]
    assert by[5201] == [(f"api_key={KEY}", True, "live", 2, 10)]
    assert by[5202] == []
    assert [x[:3] for x in by[5203]] == [("https://me:Xk29dkQ0zz1p@", False, "live")]
    assert [x[:3] for x in by[5204]] == [('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B', True, "live"), ("9233A8ECF7C5B09FE5949719B6B82BC439E9329B", False, "live")]


def test_no_documents(empty):
    got = secrets.find(empty)
    assert got.count() == 0 and got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "secrets"]
