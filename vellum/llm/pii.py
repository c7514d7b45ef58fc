"""Personal data by weak supervision.

Four exact patterns give the base spans.  Besides, looser patterns propose candidate spans (written-out
addresses, numbers without prefix or of unknown check digit, long network addresses).  Labelers - patterns, gazetteers and the words
before a span - vote on each candidate; expectation-maximisation estimates how reliable each labeler is, and
from its posteriors a logistic span classifier is trained, which decides on every candidate.  The labelers
vote on base spans too, so that there are sure cases to learn from; base spans stay whatever is decided.

A candidate enters both steps as one of a bounded number of codes (kind, votes, shape), so all candidates of
all documents count, and only the codes' counts come to the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import documents, pick, stored

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns.  A digit run is entered at its start only and never given back, which finds
# the same spans as plain patterns would and takes linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: gazetteers of words near personal data
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "teléfono", "téléphone"),
}
AGAINST = ("version", "chapter", "page", "isbn", "section", "figure", "table", "order", "invoice", "item", "no.")
# fixed values: gazetteers of what such data starts or ends with.  Prefixes of card issuers with the lengths of their numbers; calling
# codes of countries; networks that are nobody's own (private, local, documentation, multicast)
ISSUERS = {("4",): (13, 16, 19), ("51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27"): (16,), ("34", "37"): (15,), ("36", "38", "39", "300", "301", "302", "303", "304", "305"): (14, 16, 19), ("6011", "65", "644", "645", "646", "647", "648", "649"): (16, 19), ("352", "353", "354", "355", "356", "357", "358"): (16, 19), ("62", "81"): (16, 17, 18, 19), ("50", "56", "57", "58", "63", "67", "60"): (12, 13, 14, 15, 16, 17, 18, 19)}
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "211", "212", "213", "216", "218", "220", "221", "225", "233", "234", "237", "249", "251", "254", "255", "256", "260", "263", "351", "352", "353", "354", "355", "356", "357", "358", "359", "370", "371", "372", "373", "374", "375", "380", "381", "385", "386", "387", "389", "420", "421", "502", "503", "506", "507", "591", "593", "595", "598", "852", "853", "855", "880", "886", "960", "961", "962", "963", "964", "965", "966", "968", "971", "972", "973", "974", "977", "994", "995", "996", "998")
NOBODYS = ("0.", "10.", "127.", "169.254.", "192.0.2.", "192.168.", "198.18.", "198.19.", "198.51.100.", "203.0.113.", *[f"172.{k}." for k in range(16, 32)], *[f"{k}." for k in range(224, 256)], "2001:db8:", "2001:0db8:", "fe8", "fe9", "fea", "feb", "fc", "fd", "ff", "0:", "0000:")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")

# fixed values: looser patterns of candidates
LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\(at\)|\[at\]|\{at\}|[\x20]at[\x20])[\x20]?[A-Za-z0-9-]{1,64}(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|[\x20]dot[\x20]|\.)[\x20]?[A-Za-z]{2,16})++", re.IGNORECASE),
    "phone": re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    "card": re.compile(r"(?<![0-9A-Za-z-])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,4}(?![0-9A-Za-z-])"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
}
#: A cheap test that has to hold for a loose pattern to match at all.
NEEDS = {"email": re.compile(r"[\x20(\[{]at[\x20)\]}]", re.IGNORECASE), "phone": re.compile(r"[0-9]{3}[\x20.-][0-9]{4}"), "card": re.compile(r"[0-9]{4}[\x20.-]?[0-9]{4}"), "ip": re.compile(r"(?::[0-9A-Fa-f]{1,4}){7}")}
LABELERS = 4
#: The words of this many characters before a span are its context.
CONTEXT = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of LOCAL+@DOMAIN, leftmost and not overlapping: from each @ to the left, at most back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, start) if start == at else last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in KINDS; a match that fails its check is dropped, not tried again elsewhere."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def votes(kind: str, span: str, before: str) -> list[int]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing."""
    digits = [c for c in span if "0" <= c <= "9"]
    words = re.findall(r"[^\s=:;,()\"']+", before.lower())
    near = words[-3:]
    # pattern: is the shape strict?
    if kind == "card":
        shape = 1 if 16 <= len(digits) <= 19 and luhn("".join(digits)) else -1
    elif kind == "phone":
        shape = 1 if (span[0] == "+" or digits[0] not in "01") and len(set(digits)) > 2 else -1
    elif kind == "email":
        shape = 1 if "@" in span or re.search(r"[(\[{](?:at|dot)[)\]}]", span, re.IGNORECASE) else 0
    else:
        shape = 1 if len(set(span)) > 3 else -1
    # gazetteer: known endings and prefixes
    if kind == "email":
        known = 1 if re.split(r"[^A-Za-z]+", span.lower().rstrip(")]}"))[-1] in TOP_DOMAINS else -1
    elif kind == "card":
        known = 1 if any("".join(digits).startswith(prefixes) and len(digits) in lengths for prefixes, lengths in ISSUERS.items()) else -1
    elif kind == "phone":
        # a number without a country is looked up by its area: no area starts with 0 or 1, and none has the exchange of made-up numbers
        number = "".join(digits)
        known = (1 if number.startswith(CALLING) else -1) if span[0] == "+" else 1 if number[0] not in "01" and number[3:6] != "555" else -1
    else:
        known = -1 if span.lower().startswith(NOBODYS) else 1
    # context: a cue close by; a word that speaks against it
    cue = 1 if any(w.strip(".") in CUES[kind] for w in near) else 0
    contrary = -1 if any(w in AGAINST for w in near) else 0
    return [shape, known, cue, contrary]


def code_of(kind: str, span: str, before: str, after: str) -> int:
    """kind, votes and shape of a candidate as one number: 4 kinds, 81 votes, 32 shapes."""
    v = 0
    for x in votes(kind, span, before):
        v = v * 3 + x + 1
    digits = sum("0" <= c <= "9" for c in span)
    shape = min(3, digits * 4 // max(1, len(span))) + 4 * bool(re.search(r"[=:]\s*[\"']?$", before)) + 8 * (after[:1] in ("\"", "'", ".", ",", ")")) + 16 * (len(span) > 24)
    return (list(CUES).index(kind) * 81 + v) * 32 + shape


def code_at(kind: str, text: str, start: int, end: int) -> int:
    return code_of(kind, text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 1])


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, code) of what the looser patterns find outside the base spans; of two that overlap, the first kind's."""
    taken = sorted(s for spans in base.values() for s in spans)
    found = []
    for kind, pattern in LOOSE.items():
        if not NEEDS[kind].search(text):
            continue
        new = [m.span() for m in pattern.finditer(text)]
        at, free = 0, []
        for start, end in new:
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at == len(taken) or taken[at][0] >= end:
                free.append((start, end))
                found.append((kind, start, end, code_at(kind, text, start, end)))
        taken = sorted(taken + free)
    return found


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes, shape) of each code."""
    v, shape = codes // 32 % 81, codes % 32
    return codes // (32 * 81), np.stack([v // 3 ** (LABELERS - 1 - k) % 3 - 1 for k in range(LABELERS)], axis=1), shape


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each vote pattern, table[class, labeler, vote], prior), starting from the majority of votes."""
    posterior = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    prior, table = 0.5, np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = float(np.clip(weight[1].sum() / counts.sum(), 0.02, 0.98))
        for c in (0, 1):
            for v in (-1, 0, 1):
                # what a labeler is expected to do counts as a few votes, so that none is ever turned around by few cases
                expected = 2.0 if v == 0 or (v == 1) == (c == 1) else 0.5
                table[c, :, v + 1] = (weight[c][:, None] * (votes == v)).sum(axis=0) + expected
            table[c] /= table[c].sum(axis=1, keepdims=True)
        logs = [np.log(p) + sum(np.log(table[c, k, votes[:, k] + 1]) for k in range(votes.shape[1])) for c, p in ((0, 1 - prior), (1, prior))]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, table, prior


def design(kind: np.ndarray, votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(kind)), *[kind == k for k in range(len(CUES))], *[shape % 4 == k for k in range(4)], *[shape >> k & 1 for k in (2, 3, 4)]]
    columns += [(votes[:, k] == v) for k in range(votes.shape[1]) for v in (-1, 1)]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def train(codes: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Whether each code is accepted: posteriors by expectation-maximisation per kind, then logistic regression on them."""
    if not len(codes):
        return np.zeros(0, bool)
    kind, v, shape = unpack(codes)
    posterior = np.zeros(len(codes))
    for k in np.unique(kind):
        here = kind == k
        posterior[here] = expectation_maximisation(v[here], counts[here].astype(float))[0]
    x = design(kind, v, shape)
    share = np.sqrt(counts) / np.sqrt(counts).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (share * (posterior - p)) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return x @ w > 0


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts and base_sha256 are of the base spans.  spans has base spans and accepted candidates; offsets are
    code points, the end exclusive.  Null and empty texts have none.  Rows that repeat a key each get theirs.
    """
    flat = pick(docs, doc_id=key, text=text)
    kind = dict(flat.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, extra, sure = [], [], [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                found = base_spans(t) if t else {k: [] for k in KINDS}
                counts.append([len(found[k]) for k in KINDS])
                base.append(written([(k, *s) for k, spans in found.items() for s in spans]))
                sure.append([code_at(k, t, *s) for k, spans in found.items() for s in spans])
                extra.append([{"kind": k, "start": s, "end": e, "code": c} for k, s, e, c in (candidates(t, found) if t else ())])
            extras = pa.array(extra, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])))
            shas = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array(shas), pa.array(base, pa.string()), extras, pa.array(sure, pa.list_(pa.int32()))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "extra", "sure"])

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, extra array<struct<kind: string, start: int, end: int, code: int>>, sure array<int>"
    found = stored(flat.mapInArrow(scan, schema), "spans")
    seen = found.select(F.explode(F.concat("extra.code", "sure")).alias("code")).groupBy("code").count().collect()
    seen = sorted((r["code"], r["count"]) for r in seen)
    accepted = train(np.array([c for c, _ in seen], np.int64), np.array([n for _, n in seen], np.int64))
    good = [int(c) for (c, _), ok in zip(seen, accepted, strict=True) if ok]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes = set(good)
        for batch in batches:
            out = []
            for base, extra in zip(batch.column("base").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                new = [(x["kind"], x["start"], x["end"]) for x in extra or () if x["code"] in yes]
                old = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)] if new else []
                out.append(written(old + new) if new else base)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.string()), pa.array([s.count(",") + 1 if s else 0 for s in out], pa.int64())], [*batch.schema.names[:6], "spans", "n_spans"])

    return found.mapInArrow(merge, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
