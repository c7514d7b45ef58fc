"""Logs of edits to sessions of ordered pages, folded to the pages that they leave.

An edit names pages by their place at that time, so a log is folded in order.  What is folded is not the pages but a list of
pieces: stretches of the session as it was, and of pages that edits brought.  Moving or replacing a hundred pages moves a piece; the
session's own pages never pass through the fold, they are joined to the pieces at the end.  A task goes along its sessions' edits
in order and holds the pieces of one session, in blocks, so that an edit looks at one block and the blocks' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of a block before it is halved.
BLOCK = 256


class Piece(NamedTuple):
    """Pages lo to hi - 1 of the session as it was (``edit`` null) or of those that an edit brought, turned by ``turns`` degrees since, with the last label since."""

    edit: int | None
    lo: int
    hi: int
    turns: int = 0
    label: str | None = None

    def cut(self, n: int) -> list[Piece]:
        return [self._replace(hi=self.lo + n), self._replace(lo=self.lo + n)]


class Pieces:
    """A list of pieces that is cut, taken from and put into by places of pages."""

    def __init__(self, pages: int) -> None:
        self.blocks = [[Piece(None, 0, pages)] if pages else []]
        self.sizes = [pages]

    def __len__(self) -> int:
        return sum(self.sizes)

    def __iter__(self) -> Iterator[Piece]:
        return (p for block in self.blocks for p in block)

    def at(self, place: int) -> tuple[int, int]:
        """Block and index of the piece that starts at a place, which may have to be cut; the end counts as one."""
        b = 0
        while place > self.sizes[b]:
            place -= self.sizes[b]
            b += 1
        block, i = self.blocks[b], 0
        while place:
            size = block[i].hi - block[i].lo
            if place < size:
                block[i : i + 1] = block[i].cut(place)
                size = place
            place -= size
            i += 1
        return b, i

    def take(self, start: int, end: int) -> list[Piece]:
        """Removes pages start to end - 1 and returns their pieces."""
        self.at(end)
        b, i = self.at(start)
        left, taken = end - start, []
        while left:
            if i == len(self.blocks[b]):
                b, i = b + 1, 0
                continue
            taken.append(self.blocks[b].pop(i))
            size = taken[-1].hi - taken[-1].lo
            self.sizes[b] -= size
            left -= size
        return taken

    def put(self, place: int, new: list[Piece]) -> None:
        b, i = self.at(place)
        block = self.blocks[b]
        block[i:i] = new
        self.sizes[b] += sum(p.hi - p.lo for p in new)
        if len(block) > 2 * BLOCK:
            halves = [block[: len(block) // 2], block[len(block) // 2 :]]
            self.blocks[b : b + 1] = halves
            self.sizes[b : b + 1] = [sum(p.hi - p.lo for p in half) for half in halves]

    def places(self, wanted: set[tuple[int | None, int]]) -> list[int]:
        """Where the pages named by (edit, number) are now, in order."""
        found, start = [], 0
        for p in self:
            found += [start + n - p.lo for edit, n in wanted if edit == p.edit and p.lo <= n < p.hi]
            start += p.hi - p.lo
        return sorted(found)


def apply(pieces: Pieces, seq: int, op: str, index: int, other: int, brought: int, targets: set[tuple[int | None, int]], text: str | None) -> bool:
    """Carries an edit out, or returns False and changes nothing: an edit is refused if a place that it names is not there, or if it is unknown."""
    n = len(pieces)
    new = [Piece(seq, 0, brought)] if brought else []
    if op == "add":
        pieces.put(n, new)
    elif op == "replace_named":
        hit = pieces.places(targets)
        if not hit:
            return False
        for place in reversed(hit):
            pieces.take(place, place + 1)
        pieces.put(min(hit[0], len(pieces)), new)
    elif op in ("remove", "replace", "replace_range", "reorder", "rotate", "label"):
        many = other if op == "replace_range" else 1
        if index < 0 or many < 0 or index + many > n or op == "reorder" and not 0 <= other < n:
            return False
        taken = pieces.take(index, index + many)
        if op == "reorder":
            pieces.put(other, taken)
        elif op == "rotate":
            pieces.put(index, [p._replace(turns=(p.turns + 90) % 360) for p in taken])
        elif op == "label":
            pieces.put(index, [p._replace(label=p.label if text is None else text) for p in taken])
        elif op != "remove":
            pieces.put(index, new)
    else:
        return False
    return True


def folded(pages: DataFrame, edits: DataFrame, session: str, place: str, name: str) -> DataFrame:
    """Rows of two kinds: of each edit (seq, accepted), and of each piece left (first, edit, lo, hi, turns, label; accepted is null).

    pages has session, place (1 and on, gapless) and name, a key of the page within its session.  edits has session, seq, op, index (0 and on),
    other, named (names of pages), brought (names of new ones) and text.  Names are looked up among the session's pages and those that edits bring.
    """
    kind, kinds = dict(pages.dtypes)[session], dict(edits.dtypes)
    brought = edits.select(session, F.col("seq").alias("_edit"), F.posexplode("brought").alias("_number", "_name"))
    known = pages.select(session, F.lit(None).cast("long").alias("_edit"), (F.col(place) - 1).cast("int").alias("_number"), F.col(name).alias("_name")).unionByName(brought)
    wanted = edits.filter("op = 'replace_named'").select(session, "seq", F.explode("named").alias("_name")).join(known, [session, "_name"])
    targets = wanted.groupBy(session, "seq").agg(F.collect_set(F.struct(F.coalesce("_edit", F.lit(-1)).alias("edit"), F.col("_number").alias("number"))).alias("targets"))
    told = edits.select(session, "seq", "op", "index", "other", F.size("brought").alias("brought"), "text").join(targets, [session, "seq"], "left")
    sizes = pages.groupBy(session).agg(F.count(F.lit(1)).alias("index"))
    start = sizes.select(session, F.lit(None).cast(kinds["seq"]).alias("seq"), F.lit("").alias("op"), F.col("index").cast("int").alias("index"))
    steps = told.withColumn("index", F.col("index").cast("int")).unionByName(start, allowMissingColumns=True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, rows = None, None, []

        def left() -> None:
            first = 0
            for p in pieces if pieces is not None else ():
                rows.append((at, None, None, first, p.edit, p.lo, p.hi, p.turns, p.label))
                first += p.hi - p.lo

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            types[0] = batch.schema.field(0).type
            for s, seq, op, index, other, new, text, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pieces is None or s != at:
                    left()
                    at, pieces = s, Pieces(index if seq is None else 0)
                if seq is not None:
                    ok = apply(pieces, seq, op or "", -1 if index is None else index, -1 if other is None else other, max(new or 0, 0), {(None if t["edit"] < 0 else t["edit"], t["number"]) for t in named or ()}, text)
                    rows.append((at, seq, ok, None, None, None, None, None, None))
            if len(rows) > 10_000:
                yield flush()
                rows.clear()
        left()
        if rows:
            yield flush()

    names = [session, "seq", "accepted", "first", "edit", "lo", "hi", "turns", "label"]
    types = [None, pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    columns = [session, "seq", "op", "index", "other", "brought", "text", "targets"]
    ordered = steps.select(columns).repartition(session).sortWithinPartitions(F.col(session), F.col("seq").asc_nulls_first())
    return ordered.mapInArrow(fold, f"`{session}` {kind}, seq long, accepted boolean, first int, edit long, lo int, hi int, turns int, label string")


def decisions(fold: DataFrame, session: str) -> DataFrame:
    """(session, seq, accepted) of each edit."""
    return fold.filter("accepted IS NOT NULL").select(session, "seq", "accepted")


def pages_left(fold: DataFrame, pages: DataFrame, edits: DataFrame, session: str, place: str, name: str, rotation: str) -> DataFrame:
    """(session, place, name, rotation, label) of the pages after all edits; a page that an edit brought was not turned before."""
    number: Column = F.explode(F.sequence("lo", F.col("hi") - 1))
    spots = fold.filter("accepted IS NULL").select(session, "first", "lo", "edit", "turns", "label", number.alias("_number"))
    spots = spots.select(session, (F.col("first") + F.col("_number") - F.col("lo") + 1).alias("_place"), "edit", "turns", "label", "_number")
    old = pages.select(session, (F.col(place) - 1).cast("int").alias("_number"), F.col(name).alias("_name"), F.col(rotation).alias("_rotation"))
    new = edits.select(session, F.col("seq").alias("edit"), F.posexplode("brought").alias("_number", "_name"))
    both = spots.filter("edit IS NULL").join(old, [session, "_number"]).select(session, "_place", "_name", "_rotation", "turns", "label")
    both = both.unionByName(spots.join(new, [session, "edit", "_number"]).select(session, "_place", "_name", F.lit(0).alias("_rotation"), "turns", "label"))
    return both.select(session, F.col("_place").alias(place), F.col("_name").alias(name), ((F.col("_rotation") + F.col("turns")) % 360).cast("int").alias(rotation), "label")
