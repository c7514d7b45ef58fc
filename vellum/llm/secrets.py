"""Secrets by ownership frequency over the whole corpus.

Three exact patterns give the base spans.  Besides, looser patterns propose candidates: other names of credentials, tokens of known
issuers, keys in addresses, long runs of mixed characters.  What a candidate is worth shows across the corpus: the hash of its
value is counted by the distinct repositories and distinct owners that have it.  A value of many owners is an example that people
copy (documentation, tutorials, fixtures, licence texts); a value of few owners that looks made by a generator is somebody's
credential.  Candidates of the second sort become spans; base spans stay whatever they are and are told apart in the same way.

Values are never written: a value is a 16-byte hash from the scan on.  Counting goes by (value, owner, repository), then (value, owner),
then value, so that a value that a third of all documents has is added up in parts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import documents, join_hot, stored, with_rows

KINDS = ("assign", "access", "hex")

# fixed values: the base patterns and the words that the first of them needs
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# fixed values: looser patterns; the value is the group ``v``
LOOSE = (
    ("assign", re.compile(r"(?<![A-Za-z])(?:pass_?phrase|pwd|credentials?|auth_?key|access_?key|private_?key|signing_?key|client_?id|bearer|basic)[\"']?[\x20\t]*(?::=|=>|[:=]|\x20)[\x20\t]*[\"']?(?P<v>[A-Za-z0-9+/_.=~-]{12,512})", re.ASCII | re.IGNORECASE)),
    ("assign", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%+-]{1,64}:(?P<v>[^\s:@/\"'<>]{8,128})@")),
    ("access", re.compile(r"-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----\s*(?P<v>[A-Za-z0-9+/=\s]{32,8192}?)\s*-----END")),
    ("access", re.compile(r"(?<![A-Za-z0-9_-])(?P<v>eyJ[A-Za-z0-9_-]{10,2048}\.[A-Za-z0-9_-]{10,2048}\.[A-Za-z0-9_-]{10,1024})")),
    ("access", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:gh[oprsu]_|github_pat_|glpat-|xox[abeoprs]-|sk_live_|rk_live_|sk-|AIza|ASIA|SG\.|npm_|pypi-|dop_v1_)[A-Za-z0-9_.-]{14,512})")),
    ("hex", re.compile(r"(?<![A-Za-z0-9])(?P<v>[0-9A-F]{32,512})(?![A-Za-z0-9])")),
    ("access", re.compile(r"(?<![A-Za-z0-9+/_=.-])(?P<v>[A-Za-z0-9+/_=-]{24,512})(?![A-Za-z0-9+/_=-])")),
)
# fixed values: what a text needs, in lower case, for each of them to match at all; and how long its longest word has to be
NEEDED = (("phrase", "pwd", "credential", "key", "client", "bearer", "basic"), ("://",), ("-----begin",), ("eyj",), (), (), ())
LONG = (12, 12, 7, 32, 17, 32, 24)
# fixed values: parts of placeholders
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "change_me", "your", "xxxx", "test", "12345678", "abcdef", "redacted", "000000", "insert", "todo", "none", "null")
#: A value of so many owners and so many repositories is a copied example.
OWNERS, REPOSITORIES = 3, 5
#: Bits a character that a generated value has at least.
ENTROPY = 3.0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by start, then kind; a match that fails its check is dropped, not tried again."""
    found = []
    low, longest = text.lower(), max(map(len, text.split()), default=0)
    if any(n in low for n in NAMES):
        found += [("assign", *m.span(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    # a run of fewer than 16 fails as a whole, so the bound may stand in the pattern
    if longest >= 16:
        found += [("hex", *m.span(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def generated(value: str) -> bool:
    """Whether a value looks made by a generator: mixed, of many different characters, and no placeholder."""
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS) or not any("0" <= c <= "9" for c in value) or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return bits >= min(ENTROPY, 0.8 * math.log2(n))


def mixed(value: str) -> bool:
    """Digits, small and large letters, a few of each and not in words joined by signs."""
    return sum("0" <= c <= "9" for c in value) >= 3 and sum("a" <= c <= "z" for c in value) >= 3 and sum("A" <= c <= "Z" for c in value) >= 3 and sum(c in "+/_=-" for c in value) * 8 <= len(value)


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """What the looser patterns find outside the base spans; of two that overlap, the earlier pattern's.  A key in capital hex digits may stand in an assignment."""
    low, longest, found = text.lower(), max(map(len, text.split()), default=0), []
    for k, (kind, pattern) in enumerate(LOOSE):
        if longest < LONG[k] or NEEDED[k] and not any(n in low for n in NEEDED[k]):
            continue
        taken = sorted((s, e) for t, s, e, _ in base + found if kind != "hex" or t == kind)
        at, reach = 0, 0
        for m in pattern.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][0] < end:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= start and (k < len(LOOSE) - 1 or mixed(m["v"])):
                found.append((kind, start, end, m["v"]))
    return found


def digest(value: str) -> bytes:
    """The hash that stands for a value; hex digits count alike in either case."""
    return hashlib.sha256((value.lower() if re.fullmatch(r"[0-9A-Fa-f]+", value) else value).encode()).digest()[:16]


def scanned(rows: DataFrame) -> DataFrame:
    """rows with counts and digest of the base spans, and ``found``: base spans and candidates with the hashes of their values."""
    kinds = dict(rows.dtypes)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int8()), ("end", pa.int32()), ("base", pa.bool_()), ("made", pa.bool_()), ("value", pa.binary())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, found = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                shas.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest())
                found.append([{"start": s, "kind": KINDS.index(k), "end": e, "base": i < len(base), "made": generated(v), "value": digest(v)} for i, (k, s, e, v) in enumerate(base + candidates(text, base))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("owner"), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], pa.array(shas, pa.string()), pa.array(found, spans)],
                ["row", "doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    return rows.mapInArrow(scan, f"row long, doc_id {kinds['doc_id']}, owner {kinds['owner']}, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: int, kind: byte, end: int, base: boolean, made: boolean, value: binary>>")


def ownership(uses: DataFrame) -> DataFrame:
    """(value, owners, repositories, n) of each value."""
    per_place = uses.groupBy("value", "owner", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_place.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, secrets.

    A document counts as a repository, ``owner`` names who it belongs to; a null owner is one owner.  secrets has a struct (start, kind, end, base,
    standing, owners, repositories) per span, in order of start and kind: all base spans, and the candidates that stand as ``live``.
    standing is ``copied`` (many owners), ``live`` (few, and looks generated) or ``weak`` (few, and does not).  Offsets are code points,
    the end exclusive.  Null and empty texts have no spans.  Rows that repeat a key each get theirs and are one repository.
    """
    found = stored(scanned(with_rows(docs, doc_id=key, text=text, owner=owner)), "secrets")
    names = F.array(*[F.lit(k) for k in KINDS])
    uses = found.select("row", "doc_id", "owner", F.explode("found").alias("x")).select("row", "doc_id", "owner", "x.*")
    told = join_hot(uses.drop("doc_id", "owner"), ownership(uses), "value", "n", uses.count())
    standing = F.when((F.col("owners") >= OWNERS) & (F.col("repositories") >= REPOSITORIES), "copied").when(F.col("made"), "live").otherwise("weak")
    kept = told.withColumn("standing", standing).filter("base OR standing = 'live'")
    span = F.struct("start", "kind", "end", "base", "standing", "owners", "repositories")
    per_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    with_spans = found.filter(F.size("found") > 0).join(per_row, "row", "left")
    shown = F.transform(F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)), lambda s: s.withField("kind", names[s["kind"].cast("int")]))
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    none = F.array().cast(with_spans.select(shown.alias("s")).schema["s"].dataType)
    return with_spans.select(*columns, shown.alias("secrets")).unionByName(found.filter(F.size("found") == 0).select(*columns, none.alias("secrets")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    text = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = {f"n_{k}": F.expr(f"CAST(size(filter(secrets, s -> s.standing = '{k}')) AS LONG)") for k in ("live", "copied")}
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size("secrets").cast("long").alias("n_spans"), *[c.alias(n) for n, c in count.items()])
