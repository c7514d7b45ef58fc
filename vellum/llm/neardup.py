"""Near-duplicates by min-max hashing (Ji et al., 2013): of each permutation of the shingles both the minimum
and the maximum are kept, so a signature takes half the hash evaluations.

Bands of signature values propose pairs; links are confirmed on full shingle sets.  Documents of equal sets
are one node.  In each bucket of a band all nodes are first held against one of them, its centre.  A bucket whose
nodes are then in several components is searched pair by pair, in one block if it is small.  In a large one a node can
only have a link to another component if it shares enough shingles with nodes outside its own; the nodes that do are
held against the centre with most links, and then those outside the bucket's largest component against all of the
bucket, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import discard, documents, join_dealt, join_hot, plain, stored, wide, with_rows
from vellum.llm.components import components

SHINGLE = 5
PERMUTATIONS = 60
#: Values in a band, bands: two documents of similarity 0.85 share a band but for a chance of 8 in 10 million, of 0.8 but for 7 in 100,000.
ROWS, BANDS = 5, 24
#: Nodes in a block of a bucket that is searched pair by pair, their shingles, and cells of the table of these that is in memory at once.
BLOCK, SHINGLES, CELLS = 512, 1 << 22, 1 << 22
#: Row numbers are broadcast up to this many (16 MB), beyond it shuffled.
BROADCAST_ROWS = 2_000_000

# fixed values: ASCII capitals to small letters
SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = 0x9E3779B97F4A7C15
MOD = 1 << 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))))
            self.down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, pow(BASE, -1, MOD), np.uint64))))
        return self.up, self.down


def shingles(text: str | None, powers: Powers, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words; of all words if there are fewer than ``width``."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(SMALL), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers.to(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    if len(word) < width:
        h = np.full(1, len(word), np.uint64)
        for w in word:
            h = mix(h * np.uint64(BASE) + w)
        return h
    h = np.full(len(word) - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(BASE) + word[k : len(word) - width + 1 + k])
    return np.unique(h)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20130)
    return rng.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima, then as many maxima."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for at in range(0, len(x), 2048):
        h = a[:, None] * x[None, at : at + 2048] + b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate((low, high))


def bands_of(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit hashes; a band has minima and maxima of different permutations."""
    # 7 has no factor in common with 2 * PERMUTATIONS: values that lie side by side go to different bands
    order = np.arange(BANDS * ROWS) * 7 % len(sig)
    rows = sig[order].reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(BASE) + rows[:, k].astype(np.uint64))
    return h.view(np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """row, doc_id, n, digest (of the shingle set; null if empty), bands; docs has row, doc_id, text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (a, b) = Powers(), permutations()
        for batch in batches:
            n, digest, bands = [], [], []
            for value in batch.column("text"):
                s = shingles(value.as_py(), powers)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(bands_of(signature(s, a, b)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["row", "doc_id", "n", "digest", "bands"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n long, digest binary, bands array<long>")


def sets_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, shingle hashes) of those rows."""
    few = rows.count() <= BROADCAST_ROWS
    wanted = docs.select("row", "text").join(F.broadcast(rows) if few else rows, "row", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(v.as_py(), powers).view(np.int64) for v in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["row", "set"])

    return wanted.mapInArrow(run, "row long, set array<long>")


def similar(percent: int, a: str = "set_a", b: str = "set_b") -> Column:
    shared = F.size(F.array_intersect(a, b)).cast("long")
    return F.lit(100) * shared >= F.lit(percent) * (F.size(a) + F.size(b) - shared)


def centre_links(members: DataFrame, sets: DataFrame, percent: int, total: int, links: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of nodes (bucket, rep, n) to one node of their bucket: the one with most ``links`` so far, of equals the first."""
    held = members.select("bucket", "rep", "n")
    if links is None:
        held = held.withColumn("links", F.lit(0).cast("long"))
    else:
        ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        held = held.join(ends, "rep", "left").fillna(0, ["links"])
    centre = F.max(F.struct("links", (-F.col("rep")).alias("order"), "rep", "n")).alias("centre")
    centres = stored(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), centre), "centres")
    fits = F.lit(100) * F.least("n", "centre.n") >= F.lit(percent) * F.greatest("n", "centre.n")
    pairs = join_hot(members.select("bucket", "rep", "n"), centres, "bucket", "held", total).filter((F.col("rep") != F.col("centre.rep")) & fits)
    pairs = stored(pairs.select(F.col("rep").alias("a"), F.col("centre.rep").alias("b")).distinct(), "pairs")
    of_a = pairs.join(wide(sets.select(F.col("row").alias("a"), F.col("set").alias("set_a"))), "a")
    of_b = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("asked")).join(wide(sets.select(F.col("row").alias("b"), F.col("set").alias("set_b"))), "b")
    return join_dealt(of_a, of_b, "b", "asked", total).filter(similar(percent)).select("a", "b")


def still_open(members: DataFrame, star: DataFrame, total: int) -> DataFrame:
    """members (bucket, rep, n) with the component of their node, of buckets whose nodes are in several; with held and shingles of the bucket."""
    placed = members.join(star, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    several = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return join_hot(placed, stored(several.select("bucket", "held", "shingles"), "open"), "bucket", "held", total)


def is_small() -> Column:
    return (F.col("held") <= BLOCK) & (F.col("shingles") <= SHINGLES)


def reachable(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes (rep) of nodes (rep, component) that may have a link to another component: a link takes ``percent`` of a set's shingles, so a set of which fewer also occur in other components has none."""
    held = nodes.join(wide(sets.withColumnRenamed("row", "rep")), "rep")
    total = held.agg(F.sum(F.size("set").cast("long"))).first()[0] or 0
    each = held.select("rep", "component", F.size("set").cast("long").alias("n"), F.explode("set").alias("shingle"))
    known = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = join_hot(each.drop("component"), stored(known.filter("low < high").select("shingle", "often"), "shared"), "shingle", "often", total)
    return shared.groupBy("rep").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).filter(F.lit(100) * F.col("shared") >= F.col("n") * percent).select("rep")


def in_blocks(rest: DataFrame, total: int) -> DataFrame:
    """Nodes (bucket, rep, component, held, shingles) with the blocks (bucket, i, j) where they are compared.

    Nodes outside the bucket's largest component meet all nodes: block i, j has the i-th part of the former and
    the j-th part of all.
    """
    parts = rest.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"))
    size = parts.groupBy("bucket").agg(
        F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("largest"), F.sum("n").alias("held"), F.sum("shingles").alias("shingles"), (F.sum("n") - F.max("n")).alias("outside")
    )
    told = join_hot(rest.drop("held", "shingles"), size, "bucket", "held", total)
    chunks = F.greatest(F.ceil(F.col("held") / BLOCK), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
    outer = F.ceil(F.col("outside") * F.col("chunks") / F.col("held")).cast("int")
    told = told.withColumn("chunks", chunks).select("bucket", "rep", "component", (F.col("component") != F.col("largest")).alias("out"), "chunks", outer.alias("outer"))
    own, own_out = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("outer")).cast("int")
    told = told.withColumns({"own": own, "own_out": own_out})
    among = told.select("bucket", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), F.col("own").alias("j"))
    across = told.filter(F.col("out") & (F.col("chunks") > 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter((F.col("j") != F.col("own")))
    return among.unionByName(across.select("bucket", "rep", "component", F.col("own_out").alias("i"), "j"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share: products of tables of sets by shingles, so many shingles at a time that a table has CELLS cells."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    kept = (often > 1)[place]
    which, place = which[kept], number[place[kept]]
    by = np.argsort(place, kind="stable")
    which, place = which[by], place[by]
    shared, width = np.zeros((len(sets), len(sets)), np.int64), max(1, CELLS // len(sets))
    for at in range(0, int(number[-1]) + 1, width):
        low, high = np.searchsorted(place, [at, at + width])
        table = np.zeros((len(sets), min(width, int(number[-1]) + 1 - at)), np.float32)
        table[which[low:high], place[low:high] - at] = 1
        shared += np.rint(table @ table.T).astype(np.int64)
    return shared


def joining_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between nodes of one block, as many as join components that were apart."""
    rows, comps, parent = group["rep"].to_numpy(), group["component"].to_numpy(), {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    sets = [np.asarray(s, np.int64) for s in group["set"]]
    sizes = np.array([len(s) for s in sets])
    out = []
    if (comps != comps[0]).any():
        shared = common_counts(sets)
        linked = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (comps[:, None] != comps[None, :])
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            x, y = root(comps[i]), root(comps[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((rows[i], rows[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row, doc_id, n_shingles, component_id, kept, first.

    Documents are linked if ``percent`` of the union of their shingles, or more, are shared; component_id is
    the smallest key reachable, kept whether it is the document's own.  ``first`` is true for exactly one row of
    each component, that of the smallest key (null keys last, repeated keys by row).  A null or blank text has
    no shingles and no links.  docs has to come straight from files (see with_rows).
    """
    flat = with_rows(docs, doc_id=key, text=text)
    seen = stored(measured(flat), "signatures")
    total = seen.count()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    classes = stored(
        seen.filter("n > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("size"), best), "classes"
    )
    members = classes.select("rep", "n", F.posexplode("bands").alias("band", "hash")).select("rep", "n", F.xxhash64("band", "hash").alias("bucket"))
    buckets = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    crowded = stored(join_hot(members, buckets, "bucket", "size", total * BANDS), "members")
    sets = stored(sets_of(flat, crowded.select(F.col("rep").alias("row")).distinct()), "sets")

    links = stored(centre_links(crowded, sets, percent, total * BANDS), "links")
    star = stored(components(links), "stars")
    # buckets that have pairs not yet compared, of nodes in several components
    open_ = stored(still_open(crowded.filter("size > 2"), star, total * BANDS), "open")
    large = open_.filter(~is_small())
    if large.isEmpty():
        rest = open_
    else:
        near = reachable(large.select("rep", "component").distinct(), sets, percent)
        rest = stored(large.select("bucket", "rep", "n").join(near, "rep"), "near")
        links = links.unionByName(stored(centre_links(rest, sets, percent, total * BANDS, links), "links"))
        star = stored(components(links), "stars")
        small = open_.filter(is_small()).select("bucket", "rep", "n")
        rest = stored(still_open(small.unionByName(rest.select("bucket", "rep", "n")), star, total * BANDS), "rest")
    blocks = in_blocks(rest, total * BANDS).join(wide(sets.withColumnRenamed("row", "rep")), "rep")
    more = stored(blocks.groupBy("bucket", "i", "j").applyInPandas(lambda group: joining_links(group, percent), "a long, b long"), "links")
    final = components(star.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = classes.select("digest", "rep", "size", "best").join(final, F.col("rep") == F.col("node"), "left").select("digest", "size", "best", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named")
    discard(crowded, sets, open_, more, star)
    heads = named.groupBy("component").agg(F.min("best").alias("head"), F.count(F.lit(1)).alias("classes"))
    named = join_hot(named, heads, "component", "classes", total).select("digest", "size", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head"))
    linked = join_hot(seen.filter("n > 0").select("row", "doc_id", "n", "digest"), stored(named, "heads"), "digest", "size", total)
    out = linked.select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("head")).alias("first"))
    blank = seen.filter("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first"))
    return out.unionByName(blank)


def keep_first(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each group of near-duplicates; all columns stay."""
    gone = stored(near_duplicates(docs, percent, key, text).filter(~F.col("first")).select("row"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return plain(with_rows(docs).join(gone, "row", "left_anti"), docs)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (
  SELECT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i : i + 4] END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
