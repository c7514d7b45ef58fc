"""Suffix-array dedup: bytes covered by a string of 100 bytes that also starts earlier are removed.

The suffixes are dealt out by content, so that each part is sorted on its own by the difference-cover
algorithm (Kärkkäinen and Sanders, 2003): sort the sampled triples, recurse on their names, merge the other
suffixes in, and compare the prefixes of neighbours.

Each string of 100 bytes has an anchor: of its 32-byte substrings the one of least hash, the leftmost of
equals.  Equal strings have equal anchors at equal places, so only strings of one anchor have to meet.  An
anchor's run is the stretch of text whose strings it is the anchor of.  Of runs of equal content (a 128-bit
digest) all but the first are repeats as a whole, and a run alone with its anchor has no repeats; suffixes are
sorted only of runs that share an anchor and differ, which is where copies begin, end or deviate.

A part is an anchor's differing runs.  One with more runs than a task should sort is split: its strings go to
two parts by the place of the anchor in them, and further by the bytes that all strings of such a half have in
common.  Every string goes to one part, equal strings to the same.  Halving ends, after seven times at most,
with parts of one string each, so parts are bounded however common a passage is.

Documents equal to an earlier one are set apart at the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from vellum.llm.common import discard, documents, join_hot, stored, with_rows
from vellum.llm.neardup import Powers, mix

LENGTH = 100
#: Long enough that few strings share one by chance.
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Strings whose anchors are found at once, and bytes of text that meet their runs at once.
PIECE = 1 << 20
#: Bytes of runs that are suffix-sorted together, at least, and runs of one part, at most.
BATCH, MOST = 1 << 18, 256
#: Ranges (16 MB) and row numbers (16 MB) broadcast to documents: up to so many; beyond, documents are shuffled.
BROADCAST_RANGES, BROADCAST_ROWS = 500_000, 2_000_000
LAST = (1 << 63) - 1
#: key: hash of the anchor; salt: see all_runs; left, right: digest of the content; at: the anchor's place from lo.
RUN = "key long, salt int, left long, right long, ord long, row long, lo int, hi int, at int, again boolean"
NAMES = [c.split()[0] for c in RUN.split(", ")]
CHUNK = 200_000
#: Bytes of short texts whose runs are found together.
TOGETHER = 1 << 17
#: Documents that tell which anchors are hot, and anchors that are taken for hot at most.
SAMPLE, MOST_HOT = 20_000, 10_000


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: np.ndarray, starts: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, digest in two halves, first string, last string, anchor's place from the first) of each run of the texts that raw holds one after the other, from ``starts`` on."""
    if len(raw) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(7))
    up, down = powers.to(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_minimum(grams >> np.uint64(22) << np.uint64(22) | place, SPAN)
    anchor = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    # strings that do not leave their text; those that do part the runs of one text from the next one's
    ends = np.append(starts[1:], len(raw))
    step = np.zeros(len(raw) + 1, np.int32)
    long = ends - starts >= LENGTH
    step[starts[long]] += 1
    step[ends[long] - LENGTH + 1] -= 1
    whole = np.cumsum(step)[: len(anchor)] > 0
    turn = np.append(True, (anchor[1:] != anchor[:-1]) | ~whole[:-1])
    lo = np.flatnonzero(whole & turn)
    hi = np.flatnonzero(whole & np.append(turn[1:] | ~whole[1:], True))
    view = memoryview(raw)
    digests = b"".join([xxh3_128_digest(view[i:j]) for i, j in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)])
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    text = np.searchsorted(starts, lo, "right") - 1
    at = anchor[lo]
    return text, grams[at].view(np.int64), halves[:, 0], halves[:, 1], lo - starts[text], hi - starts[text], at - lo


def texts_of(column: pa.Array) -> Iterator[tuple[np.ndarray, int, int]]:
    """(bytes, first text, texts) of stretches of a column's texts that are worked on together; a long text comes in pieces of its own, first -1 - its number and its place instead of texts."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + min(TOGETHER, PIECE), "right")) - 1)
        if k > i + 1 or offsets[k] - offsets[i] <= PIECE:
            yield raw[offsets[i] : offsets[k]], i, k - i
        else:
            for at in range(int(offsets[i]), int(offsets[k]) - LENGTH + 1, PIECE):
                yield raw[at : min(at + PIECE + LENGTH - 1, int(offsets[k]))], -1 - i, at - int(offsets[i])
        i = k


def run_batch(columns: list[list[np.ndarray]], hot: np.ndarray) -> pa.RecordBatch:
    """Runs as a batch.  Of equal ones within it all but the first are known to be repeats: they are marked, and dealt out at random instead of by anchor."""
    key, left, right, order, row, lo, hi, at = (np.concatenate(c) for c in columns)
    by = np.lexsort((lo, row, order, right, left, key))
    again = np.zeros(len(key), bool)
    again[by[1:]] = (key[by[1:]] == key[by[:-1]]) & (left[by[1:]] == left[by[:-1]]) & (right[by[1:]] == right[by[:-1]])
    key[again] = mix((row[again] + lo[again]).view(np.uint64)).view(np.int64)
    salt = np.where(np.isin(key, hot), 1 + (left & 0x3FF), 0)
    values = [key, salt.astype(np.int32), left, right, order, row, *(c.astype(np.int32) for c in (lo, hi, at)), again]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in values], NAMES)


def all_runs(docs: DataFrame, hot: list[int]) -> DataFrame:
    """Runs of all texts; salt is 0, or for anchors in ``hot`` a number that the content gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, columns, pending, crowded = Powers(), [[] for _ in range(8)], 0, np.array(hot, np.int64)
        for batch in batches:
            order, row, text = (batch.column(c) for c in ("ord", "row", "text"))
            order, row = order.to_numpy(), row.to_numpy()
            offsets = np.append(0, np.cumsum(pc.binary_length(text).to_numpy()))
            for raw, first, more in texts_of(text):
                starts = np.zeros(1, np.int64) if first < 0 else offsets[first : first + more] - offsets[first]
                number, *found, lo, hi, at = runs_of(raw, starts, powers)
                number, far = (number - 1 - first, more) if first < 0 else (number + first, 0)
                for column, x in zip(columns, (*found, order[number], row[number], lo + far, hi + far, at), strict=True):
                    column.append(x)
                pending += len(lo)
                if pending >= CHUNK:
                    yield run_batch(columns, crowded)
                    columns, pending = [[] for _ in range(8)], 0
        if pending:
            yield run_batch(columns, crowded)

    return docs.select("ord", "row", "text").mapInArrow(run, RUN)


def hot_anchors(docs: DataFrame, total: int) -> list[int]:
    """Anchors that many runs share, as a sample of documents tells: they are dealt out by content too.  What is in the list changes no result."""
    share = min(1.0, SAMPLE / max(1, total))
    some = all_runs(docs.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20))), []).filter("not again")
    found = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20").orderBy(F.desc("n"), "key").limit(MOST_HOT)
    return [r["key"] for r in found.collect()]


def sift(runs: DataFrame) -> DataFrame:
    """Runs sorted by anchor, content and order: repeats (again: true), and firsts of anchors with several contents (false).  Runs alone with their anchor go.

    A hot anchor's runs are dealt out by content over many tasks, so they all stay.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = left = right = held = None
        place = NAMES.index("again")
        for batch in batches:
            known = batch.column(place).to_numpy(zero_copy_only=False)
            if known.any():
                yield batch.filter(pa.array(known))
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            k, salt, a, b = (batch.column(c).to_numpy() for c in ("key", "salt", "left", "right"))
            new_key = np.append(k[0] != key if key is not None else True, k[1:] != k[:-1])
            new = new_key | np.append(key is None or a[0] != left or b[0] != right, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            firsts = np.flatnonzero(new)
            starts = new_key[firsts]
            # the first of an anchor goes out once a second content follows
            wanted = ~starts | (salt[firsts] > 0)
            wanted[:-1] |= ~starts[1:]
            if held is not None and len(firsts) and not starts[0]:
                yield held
            if len(firsts):
                held = None if wanted[-1] else batch.slice(int(firsts[-1]), 1)
            keep = np.sort(np.concatenate((np.flatnonzero(~new), firsts[wanted])))
            if len(keep):
                yield batch.take(pa.array(keep)).set_column(place, "again", pa.array(~new[keep]))
            key, left, right = k[-1], a[-1], b[-1]

    return runs.repartition("key", "salt").sortWithinPartitions("key", "salt", "left", "right", "ord", "row", "lo").mapInArrow(scan, RUN)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t, whole numbers from 1 to at most 2**21 of which there are as many at most."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    padded = np.concatenate((t.astype(np.int64), np.zeros(3, np.int64)))
    # sampled: places not divisible by 3, and the end if n leaves 1, so that every text part has a last triple
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    triple = padded[sample] << 42 | padded[sample + 1] << 21 | padded[sample + 2]
    order = np.argsort(triple, kind="stable")
    fresh = np.append(True, np.diff(triple[order]) != 0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(padded[zero] << 21 | rank[zero + 1], kind="stable")]
    # a place among the others: of those of residue 1 by character and rank behind, of residue 2 by two characters and rank behind
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    less = np.searchsorted(padded[first] << 21 | rank[first + 1], padded[zero] << 21 | rank[zero + 1])
    less = less + np.searchsorted(padded[second] << 42 | padded[second + 1] << 21 | rank[second + 2], padded[zero] << 42 | padded[zero + 1] << 21 | rank[zero + 2])
    merged = np.full(n, -1, np.int64)
    merged[less + np.arange(len(zero))] = zero
    merged[merged < 0] = sampled
    return merged


def repeats_in(contents: list[bytes], ords: np.ndarray, rows: np.ndarray, los: np.ndarray) -> np.ndarray:
    """Which strings of runs also start earlier in one of them: (run, place in it) pairs, by suffix array."""
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    t = text.astype(np.int64) + 2
    t[starts + sizes] = 1
    run = np.repeat(np.arange(len(contents)), sizes + 1)
    offset = np.arange(len(text)) - starts[run]
    order = suffix_array(t)
    order = order[offset[order] <= sizes[run[order]] - LENGTH]
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 16):
        here, before = order[at : at + (1 << 16)], order[at - 1 : at - 1 + (1 << 16)][: len(order[at : at + (1 << 16)])]
        same[at : at + len(here)] = (windows[here] == windows[before]).all(axis=1)
    group = np.cumsum(~same)
    by = np.lexsort((los[run[order]] + offset[order], rows[run[order]], ords[run[order]], group))
    again = np.append(False, group[by][1:] == group[by][:-1]) if len(by) else np.zeros(0, bool)
    hit = order[by][again]
    return np.stack([run[hit], offset[hit]], axis=1)


def as_ranges(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of neighbouring places."""
    o = np.lexsort((at, row))
    row, at = row[o], at[o]
    fresh = np.append(True, (np.diff(row) != 0) | (np.diff(at) != 1)) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    return row[begin], at[begin], at[end]


def sorted_parts(parts: DataFrame) -> DataFrame:
    """Ranges of repeated strings among runs (part, ord, row, lo, content), part by part, by suffix sorting."""

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        _, ords, ids, los, contents = zip(*rows, strict=True)
        ords, ids, los = np.array(ords), np.array(ids), np.array(los)
        hits = repeats_in(list(contents), ords, ids, los)
        row, lo, hi = as_ranges(ids[hits[:, 0]], los[hits[:, 0]] + hits[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["row", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("part", "ord", "row", "lo", "content")], strict=True):
                if size >= BATCH and row[0] != rows[-1][0]:
                    yield ranges(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield ranges(rows)

    return parts.select("part", "ord", "row", "lo", "content").repartition("part").sortWithinPartitions("part").mapInArrow(run, "row long, lo int, hi int")


def with_counts(runs: DataFrame, total: int) -> DataFrame:
    """Runs of parts that have several, with n, how many the part has."""
    counts = stored(runs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    return join_hot(runs, counts, "part", "n", total)


def halved(runs: DataFrame, block: int) -> DataFrame:
    """Runs cut so that the anchor's place in their strings, divided by block, is one number; with the part that their strings belong to."""
    least = F.col("at") - (F.octet_length("content") - LENGTH)
    cut = runs.select("*", least.alias("least"), F.explode(F.sequence(F.floor(least / block), F.floor(F.col("at") / block))).alias("half"))
    low, high = F.greatest("least", F.col("half") * block), F.least("at", F.col("half") * block + (block - 1))

    def piece(of: str, start: Column, length: Column) -> Column:
        return F.substring(of, (start + 1).cast("int"), length.cast("int"))

    cut = cut.select("part", "ord", "row", "half", (F.col("lo") + F.col("at") - high).cast("int").alias("lo"), high.cast("int").alias("at"), piece("content", F.col("at") - high, high - low + LENGTH).alias("content"))
    common = piece("content", F.col("at") - F.col("half") * block, F.lit(LENGTH - block + 1))
    return cut.select(F.xxhash64("part", "half", common).alias("part"), "ord", "row", "lo", "at", "content")


def repeated_ranges(runs: DataFrame, total: int) -> DataFrame:
    """(row, lo, hi) of repeated strings among runs (part, ord, row, lo, at, content) whose contents differ within a part."""
    found, block = [], SPAN
    rest = stored(with_counts(runs, total), "parts")
    while True:
        found.append(sorted_parts(rest.filter(F.col("n") <= MOST)))
        large = rest.filter(F.col("n") > MOST)
        if large.isEmpty():
            break
        block = (block + 1) // 2
        pieces = stored(halved(large, block).withColumn("same", F.struct("part", "content")), "pieces")
        firsts = stored(pieces.groupBy("same").agg(F.min(F.struct("ord", "row", "lo", "at")).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
        copies = join_hot(pieces, firsts.filter("copies > 1"), "same", "copies", total).filter(F.struct("ord", "row", "lo") != F.struct("first.ord", "first.row", "first.lo"))
        found.append(copies.select("row", "lo", (F.col("lo") + F.octet_length("content") - LENGTH).cast("int").alias("hi")))
        rest = stored(with_counts(firsts.select("same.part", "first.*", "same.content"), total), "parts")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contents(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes of runs (key, ord, row, lo, hi, at): most documents have some, so runs and pieces of documents meet in a shuffle."""
    asked = runs.groupBy("row", F.floor(F.col("lo") / PIECE).alias("piece")).agg(F.collect_list(F.struct("key", "ord", "lo", "hi", "at")).alias("asked"))
    raw = docs.select("row", F.col("text").cast("binary").alias("raw"))
    pieces = raw.select("row", "raw", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("raw") / PIECE))).alias("piece"))
    pieces = pieces.select("row", "piece", F.substring("raw", (F.col("piece") * PIECE + 1).cast("int"), F.lit(PIECE + SPAN + LENGTH)).alias("raw"))
    found = pieces.join(asked, ["row", "piece"]).select("row", "piece", "raw", F.explode("asked").alias("a"))
    start = (F.col("a.lo") - F.col("piece") * PIECE + 1).cast("int")
    return found.select(F.col("a.key").alias("part"), "a.ord", "row", "a.lo", "a.at", F.substring("raw", start, F.col("a.hi") - F.col("a.lo") + LENGTH).alias("content"))


def merged(marks: DataFrame) -> DataFrame:
    """(row, start, end) of the unions of strings (row, lo, hi) that overlap or touch; one sorted pass, a document's marks are never gathered."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(row, start, end):
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["row", "start", "end"])

        open_ = np.empty((3, 0), np.int64)
        for batch in batches:
            here = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("row", "lo", "hi")])
            here[2] += LENGTH
            row, start, end = np.concatenate((open_, here), axis=1)
            if not len(row):
                continue
            turn = np.cumsum(np.append(False, row[1:] != row[:-1]))
            # as turns grow, no end of an earlier row counts in a later one
            far = np.maximum.accumulate(turn << 33 | end)
            fresh = np.append(True, (turn[1:] != turn[:-1]) | (turn[1:] << 33 | start[1:] > far[:-1]))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(row)) - 1
            spans = np.stack((row[first], start[first], far[last] & ((1 << 33) - 1)))
            yield done(*spans[:, :-1])
            open_ = spans[:, -1:]
        yield done(*open_)

    return marks.repartition("row").sortWithinPartitions("row", "lo", "hi").mapInArrow(merge, "row long, start int, end int")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges, ends exclusive).

    Null counts as empty; texts under 100 bytes lose nothing.  Earlier means of smaller key (null keys last,
    repeated keys by row), or the same document and an earlier place.  Keys are integers.  docs has to come
    straight from files (see with_rows).
    """
    flat = with_rows(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "row")
    flat = flat.withColumn("ord", F.coalesce("doc_id", F.lit(LAST)))
    sums = stored(flat.select("row", "ord", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    total = sums.count()
    firsts = sums.groupBy("digest").agg(F.min(F.struct("ord", "row")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = stored(firsts, "copied")
    copies = stored(join_hot(sums.select("row", "n", "digest"), firsts, "digest", "copies", total).filter("row <> first.row").select("row", "n"), "copies")
    discard(sums, firsts)
    apart = F.broadcast(copies.select("row")) if copies.count() <= BROADCAST_ROWS else copies.select("row")

    single = flat.join(apart, "row", "left_anti")
    sifted = stored(sift(all_runs(single, hot_anchors(single, total))), "runs")
    marks = sifted.filter("again").select("row", "lo", "hi")
    marks = marks.unionByName(copies.filter(F.col("n") >= LENGTH).select("row", F.lit(0).alias("lo"), (F.col("n") - LENGTH).cast("int").alias("hi")))
    runs = stored(contents(flat, sifted.filter("not again")), "contents")
    ranges = stored(merged(marks.unionByName(repeated_ranges(runs, total))), "ranges")
    discard(sifted, copies, runs)
    few = ranges.count() <= BROADCAST_RANGES
    spans = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    marked = flat.select("doc_id", "text", "row").join(F.broadcast(spans) if few else spans, "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, number, sha = [], [], [], []
            for value, ranges in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw, at, h = memoryview(value.as_buffer()), 0, hashlib.sha256()
                for s in ranges or ():
                    h.update(raw[at : s["start"]])
                    at = s["end"]
                h.update(raw[at:])
                sizes.append(len(raw)), removed.append(sum(s["end"] - s["start"] for s in ranges or ())), number.append(len(ranges or ())), sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, number)], pa.array(sha), batch.column("spans")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return marked.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).drop("spans")
