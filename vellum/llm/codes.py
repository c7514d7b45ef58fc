"""Codes of vectors: each vector's parts replaced by the nearest entries of codebooks that Lloyd's rounds have moved.

The rounds are filtered (Kanungo et al., 2002).  Once, every partition builds kd-trees over the parts of its vectors, a block of
vectors at a time; a node knows the box, the sum and the number of its points.  In a round all codebook entries start at
the root.  At each node, entries that are no point of the box's nearest are struck out: those that lose to the entry nearest to the
box's middle even in the box's corner that suits them most.  Where one entry is left, it takes the whole subtree by its sum and
number, no point is looked at; in a leaf, points are compared with what is left.  A round returns sums and numbers per entry
of a task, which Spark adds up: what comes to the driver has the size of the codebooks.

All numbers are whole and all comparisons exact: in doubles where these bear every sum, else in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import discard, join_hot, pick, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors of a block, and components: a task holds one block and its trees at a time.
BLOCK = 32_768
BLOCK_COMPONENTS = 4_000_000
#: Points of a leaf.
LEAF = 48
#: Components up to this one are stored in four bytes.
NARROW = 1 << 30
#: A vector with a larger component than this counts as not finite: only doubles reach it.
WIDEST = 2.0**128
MOST_LONG = (1 << 63) - 1
#: Sums are sent in two pieces, this many bits in the lower.
LOW = 80


def grow(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(order of the points, nodes (start, end, left, right)) of a kd-tree: halves at the median of the widest side; -1 for a leaf's children."""
    order, nodes, todo = np.arange(len(points)), [(0, len(points), -1, -1)], [0]
    while todo:
        k = todo.pop()
        start, end, *_ = nodes[k]
        mine = points[order[start:end]]
        spread = mine.max(axis=0) - mine.min(axis=0)
        side = int(np.argmax(spread))
        if end - start <= LEAF or spread[side] == 0:
            continue
        by = np.argsort(mine[:, side], kind="stable")
        order[start:end] = order[start:end][by]
        # a cut between different values, so that equal points stay together
        values = mine[by, side]
        middle = values[(end - start) // 2]
        cut = int(np.argmax(values >= middle)) or int(np.argmax(values > middle))
        nodes[k] = (start, end, len(nodes), len(nodes) + 1)
        todo += [len(nodes), len(nodes) + 1]
        nodes += [(start, start + cut, -1, -1), (start + cut, end, -1, -1)]
    return order, nodes


class Tree:
    """Points in tree order with the nodes over them: ends, children, boxes, sums."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> None:
        self.points, self.order, self.nodes = points[order], order, nodes
        self.low = np.array([self.points[s:e].min(axis=0) for s, e in nodes[:, :2]], points.dtype)
        self.high = np.array([self.points[s:e].max(axis=0) for s, e in nodes[:, :2]], points.dtype)
        self.sums = np.array([self.points[s:e].sum(axis=0) for s, e in nodes[:, :2]], points.dtype)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a by rows of b."""
    return a @ b.T


def filtered(tree: Tree, entries: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]]]:
    """([(node, entry)] of nodes taken as a whole, [(start, end, entry of each point)] of leaves).  Level by level; ties go to the lower index."""
    norms = (entries * entries).sum(axis=1)
    index = np.arange(len(entries))
    level, alive = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    whole, leaves = [], []
    while len(level):
        low, high = tree.low[level], tree.high[level]
        # twice the distance to the box's middle, but for what is the same for all entries
        inner = times(low + high, entries)
        offset = norms - inner
        first = np.argmin(np.where(alive, offset, offset.max() + 1), axis=1)
        for e in np.unique(first):
            rows = np.flatnonzero(first == e)
            # how much closer than e an entry comes at most, over all of the box
            gain = (offset[rows, e][:, None] - offset[rows]) + times(high[rows] - low[rows], np.abs(entries - entries[e]))
            alive[rows] &= (gain > 0) | ((gain == 0) & (index < e)) | (index == e)
        left = alive.sum(axis=1)
        inside = tree.nodes[level, 2] >= 0
        for at in np.flatnonzero(left == 1):
            whole.append((int(level[at]), int(first[at])))
        for at in np.flatnonzero((left > 1) & ~inside):
            start, end = tree.nodes[level[at], :2]
            some = np.flatnonzero(alive[at])
            far = norms[some] - 2 * times(tree.points[start:end], entries[some])
            leaves.append((int(start), int(end), some[np.argmin(far, axis=1)]))
        down = np.flatnonzero((left > 1) & inside)
        level, alive = tree.nodes[level[down], 2:4].reshape(-1), np.repeat(alive[down], 2, axis=0)
    return whole, leaves


def assigned(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point, in the order that the points came in."""
    found = np.zeros(len(tree.points), np.int64)
    whole, leaves = filtered(tree, entries)
    for node, e in whole:
        found[tree.nodes[node, 0] : tree.nodes[node, 1]] = e
    for start, end, e in leaves:
        found[start:end] = e
    back = np.empty_like(found)
    back[tree.order] = found
    return back


def gathered(tree: Tree, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds to the sums and numbers of the entries what this tree's points give."""
    whole, leaves = filtered(tree, entries)
    for node, e in whole:
        sums[e] += as_ints(tree.sums[node])
        counts[e] += int(tree.nodes[node, 1] - tree.nodes[node, 0])
    for start, end, which in leaves:
        by = np.argsort(which, kind="stable")
        heads = np.flatnonzero(np.diff(which[by], prepend=-1))
        for e, total, n in zip(which[by][heads], np.add.reduceat(tree.points[start:end][by], heads, axis=0), np.diff(np.append(heads, end - start)), strict=True):
            sums[e] += as_ints(total)
            counts[e] += int(n)


def as_ints(values: np.ndarray) -> np.ndarray:
    return values if values.dtype == object else values.astype(np.int64)


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x), exactly: a product with a power of two does not round."""
    floors = np.floor(values.astype(np.float64) * SCALE)
    if not len(floors) or np.abs(floors).max() <= NARROW:
        return floors
    return np.array([[int(x) for x in row] for row in floors], object).reshape(floors.shape)


def packed(points: np.ndarray) -> bytes:
    return ",".join(map(str, points.reshape(-1))).encode() if points.dtype == object else points.astype("<i4").tobytes()


def unpacked(data: bytes, wide: bool, dims: int) -> np.ndarray:
    values = np.array([int(x) for x in data.split(b",")], object) if wide else np.frombuffer(data, "<i4").astype(np.float64)
    return values.reshape(-1, dims)


def fitting(points: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Points and entries as numbers that bear both: no sum of a comparison passes 8 x width x the greatest square."""
    most = max(int(np.abs(points).max()), max(abs(x) for e in entries for x in e))
    if 8 * points.shape[1] * most * most <= 1 << 53:
        return points.astype(np.float64), np.array(entries, np.float64)
    return (points if points.dtype == object else points.astype(np.int64).astype(object)), np.array(entries, object).reshape(len(entries), points.shape[1])


def usable(table: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(vec_id, vector, label) of the rows that count, and their length."""
    flat = pick(table, vec_id=key, vector=vector, label=label)
    flat = flat.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < WIDEST)) & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    first = flat.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    dims = first[0]["n"] if first else PARTS
    return flat.filter(F.size("vector") == dims), dims


def blocks(flat: DataFrame, dims: int) -> DataFrame:
    """One row per block: vec_ids and labels, and per part the points, whether they are wide, and their tree."""
    kinds, size = dict(flat.dtypes), max(1, min(BLOCK, BLOCK_COMPONENTS // dims))
    width = dims // PARTS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(part: pa.Table) -> pa.RecordBatch:
            vectors = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            points = scaled(vectors)
            made = [grow(points[:, k * width : (k + 1) * width]) for k in range(PARTS)]
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c).combine_chunks())
            trees = [np.array(nodes, "<i4").tobytes() for _, nodes in made]
            return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([packed(points)], pa.binary()), pa.array([points.dtype == object]), pa.array([[o.astype("<i4").tobytes() for o, _ in made]], pa.list_(pa.binary())), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "points", "wide", "orders", "trees"])

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if room == held[-1].num_rows:
                    yield flush(pa.Table.from_batches(held))
                    held.clear()
        if held:
            yield flush(pa.Table.from_batches(held))

    return flat.mapInArrow(build, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, points binary, wide boolean, orders array<binary>, trees array<binary>")


def planted(row: dict, dims: int, codebooks: list[list[list[int]]]) -> Iterator[tuple[Tree, np.ndarray]]:
    """Each part's tree of a block and its codebook."""
    points, width = unpacked(row["points"], row["wide"], dims), dims // PARTS
    for k in range(PARTS):
        mine, entries = fitting(points[:, k * width : (k + 1) * width], codebooks[k])
        yield Tree(mine, np.frombuffer(row["orders"][k], "<i4"), np.frombuffer(row["trees"][k], "<i4").reshape(-1, 4)), entries


def moved(built: DataFrame, dims: int, codebooks: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round: each entry the floor of its points' mean; entries without points stay."""
    width, n = dims // PARTS, len(codebooks[0])
    sent = built.sparkSession.sparkContext.broadcast(codebooks)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, n, width), object), np.zeros((PARTS, n), object)
        for batch in batches:
            for row in batch.to_pylist():
                for k, (tree, entries) in enumerate(planted(row, dims, sent.value)):
                    gathered(tree, entries, sums[k], counts[k])
        part, entry = np.nonzero(counts)
        slots, values = [], []
        for p, e in zip(part.tolist(), entry.tolist(), strict=True):
            slots += range((p * n + e) * (width + 1), (p * n + e + 1) * (width + 1))
            values += [int(counts[p, e]), *map(int, sums[p, e])]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([v >> LOW for v in values], pa.int64()), pa.array([v & ((1 << LOW) - 1) for v in values], pa.decimal128(38, 0))], ["slot", "high", "low"])

    found = built.mapInArrow(gather, "slot long, high long, low decimal(38,0)").groupBy("slot").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sent.destroy()
    total = {r["slot"]: (r["high"] << LOW) + int(r["low"]) for r in found}
    new = []
    for p in range(PARTS):
        new.append([])
        for e in range(n):
            at = (p * n + e) * (width + 1)
            new[p].append([total[at + 1 + i] // total[at] for i in range(width)] if at in total else codebooks[p][e])
    return new


def coded(built: DataFrame, dims: int, codebooks: list[list[list[int]]], kinds: dict[str, str]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    sent = built.sparkSession.sparkContext.broadcast(codebooks)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["points", "wide", "orders", "trees"]).to_pylist()):
                which, errors = [], 0
                for tree, entries in planted(row, dims, sent.value):
                    mine = assigned(tree, entries)
                    back = np.empty_like(tree.points)
                    back[tree.order] = tree.points
                    gap = back - entries[mine]
                    errors = errors + (gap * gap).sum(axis=1)
                    which.append(mine)
                codes = ["".join(f"{c:02x}" for c in code) for code in np.stack(which, axis=1).tolist()]
                ids, labels = batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array([min(int(e), MOST_LONG) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    return built.mapInArrow(write, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def written(codebooks: list[list[list[int]]]) -> str:
    return ",".join(str(x) for part in codebooks for entry in part for x in entry)


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(codes, codebooks): codes has vec_id, label, code, error, label_error for each row kept; codebooks is [part][entry][component].

    Rows go whose vector is null or empty, holds null or a number that is not finite, or has another length than that of the row of
    the least key; lengths have to be multiples of PARTS.  Rows that repeat a key each count; a null key comes last.  With fewer than
    ENTRIES rows a codebook has as many entries as rows; an empty table has no entries and gives no rows.  Errors beyond a long
    are the greatest long.  Null labels are one label.
    """
    flat, dims = usable(table, key, vector, label)
    kinds, width = dict(flat.dtypes), dims // PARTS
    seeds = [list(map(int, row)) for row in scaled(np.array([r["vector"] for r in flat.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()], np.float64).reshape(-1, dims))]
    codebooks = [[seed[k * width : (k + 1) * width] for seed in seeds] for k in range(PARTS)]
    built = stored(blocks(flat, dims), "trees")
    if seeds:
        for _ in range(rounds):
            codebooks = moved(built, dims, codebooks)
    rows = stored(coded(built, dims, codebooks, kinds), "codes").withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    discard(built)
    sums = rows.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_hot(rows, sums, "_label", "_n", rows.count()).select("vec_id", "label", "code", "error", "label_error"), codebooks


def _round_sql(k: int) -> str:
    return f"""n{k} AS MATERIALIZED (SELECT v, p, min(d * 256 + e) AS best FROM (SELECT x.v, x.p, c.e, list_sum(list_transform(range(1, 17), lambda i: (x.w[i] - c.w[i]) * (x.w[i] - c.w[i])))::BIGINT AS d FROM x JOIN c{k} c USING (p)) GROUP BY v, p)"""


def _moved_sql(k: int) -> str:
    return f"""s{k} AS (SELECT p, best % 256 AS e, i, sum(w[i])::BIGINT AS s, count(*) AS n FROM (SELECT x.p, best, w, unnest(range(1, 17)) AS i FROM x JOIN n{k} USING (v, p)) GROUP BY ALL),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{k} GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.w, c.w) AS w FROM c{k} c LEFT JOIN m{k} m USING (p, e))"""


#: For vectors of 64 components and keys that do not repeat, as embeddings has.
OP11_SQL = (
    """WITH f AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id AS v, p, w[p * 16 + 1 : p * 16 + 16] AS w FROM f, range(4) r(p)),
z AS (SELECT vec_id AS v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM f ORDER BY vec_id LIMIT 256),
c0 AS MATERIALIZED (SELECT p, e, w FROM x JOIN z USING (v)),
"""
    + ",\n".join(f"{_round_sql(k)},\n{_moved_sql(k)}" for k in range(ROUNDS))
    + f""",
{_round_sql(ROUNDS)},
r AS (SELECT v, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM n4 GROUP BY v),
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS h FROM c4)
SELECT v AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM r JOIN f ON vec_id = v"""
)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(written(codebooks).encode()).hexdigest()).alias("codebooks_sha256"))
