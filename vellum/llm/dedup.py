"""Exact dedup by two-pass Bloom filtering.

Pass one counts, per filter cell, none, one, or more of the hashes that fall on it.  A hash whose cells
all hold more than one is possibly repeated; pass two lets only rows with such hashes shuffle, where
equality of the full SHA-256 decides, and all other rows pass straight through as groups of one.

A filter has 16 cells a row; while it is counted, a task holds two bits a cell (64 MB at most).  Where that is more than executors should hold, the hashes are written in as many
ranges as keep each range's filter small, and both passes go range by range.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, documents, join_hot, shared_dir, stored, with_rows

#: A filter has this many cells a row, and MAX_CELLS (32 MB of bits) at most: beyond that there are several, one for each range of hashes.
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 28
HASHES = 3
SEGMENT = 1 << 16


def positions(digests: np.ndarray, cells: int) -> np.ndarray:
    """HASHES cells of each digest (two 64-bit words a row); cells is a power of two."""
    first, step = digests[:, 0], digests[:, 1] | np.uint64(1)
    return np.stack([(first + np.uint64(k) * step) & np.uint64(cells - 1) for k in range(HASHES)]).astype(np.int64)


def words_of_digests(column: pa.Array) -> np.ndarray:
    """The first 16 bytes of each binary value as two 64-bit words."""
    return np.frombuffer(b"".join(x[:16] for x in column.to_pylist()), np.uint64).reshape(-1, 2)


def cells_for(rows: int) -> int:
    return min(MAX_CELLS, max(SEGMENT, 1 << (rows * CELLS_PER_ROW - 1).bit_length() if rows else SEGMENT))


def count_cells(digests: DataFrame, column: str, cells: int) -> DataFrame:
    """One row per partition and segment that has hashes: the cells with one or more, and with two or more, as packed bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for batch in batches:
            for row in positions(words_of_digests(batch.column(0)), cells) if batch.num_rows else ():
                cell, n = np.unique(row, return_counts=True)
                place, first = np.unique(cell >> 3, return_index=True)
                bit = np.uint8(128) >> (cell & 7).astype(np.uint8)
                hit, again = np.bitwise_or.reduceat(bit, first), np.bitwise_or.reduceat(np.where(n > 1, bit, np.uint8(0)), first)
                twice[place] |= once[place] & hit | again
                once[place] |= hit
        size = SEGMENT // 8
        for k in np.flatnonzero(once.reshape(-1, size).any(axis=1)):
            packed = zlib.compress(once[k * size : (k + 1) * size].tobytes() + twice[k * size : (k + 1) * size].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([packed], pa.binary())], ["segment", "bits"])

    return digests.select(column).mapInArrow(count, "segment int, bits binary")


def merge_cells(parts: DataFrame) -> DataFrame:
    """One row per segment: the cells that two hashes or more fall on.  Holds one segment at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, two = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(two.tobytes(), 1)], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(bits), np.uint8).reshape(2, -1)
                if segment != at:
                    if at is not None:
                        yield done()
                    at, one, two = segment, more[0].copy(), more[1].copy()
                else:
                    two |= more[1] | (one & more[0])
                    one |= more[0]
        if at is not None:
            yield done()

    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")


def repeated_filter(digests: DataFrame, column: str, rows: int) -> tuple[int, Broadcast]:
    """A broadcast filter of MAX_CELLS bits at most: bits of the cells that two hashes or more fall on."""
    cells = cells_for(rows)
    twice = np.zeros(cells // 8, np.uint8)
    for segment, bits in merge_cells(count_cells(digests, column, cells)).collect():
        twice[segment * (SEGMENT // 8) : (segment + 1) * (SEGMENT // 8)] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return cells, digests.sparkSession.sparkContext.broadcast(twice)


def flag_repeated(df: DataFrame, column: str, rows: int, name: str = "maybe") -> DataFrame:
    """df with a boolean: false means that no other row has this digest (a binary of 16 bytes or more)."""
    return with_flags(df, column, *repeated_filter(df, column, rows), name)


def with_flags(df: DataFrame, column: str, cells: int, shared: Broadcast, name: str) -> DataFrame:
    place = df.columns.index(column)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` boolean"

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            if batch.num_rows:
                for row in positions(words_of_digests(batch.column(place)), cells):
                    hit &= (twice[row >> 3] >> (7 - (row & 7)).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, name])

    return df.mapInArrow(flag, schema)


def flagged(digests: DataFrame, column: str, name: str = "maybe") -> DataFrame:
    """flag_repeated() of a table of digests, written; range by range of their last byte where one filter does not hold them all."""
    spark, kept = digests.sparkSession, stored(digests, "digests")
    rows = kept.count()
    ranges = 1
    while ranges < 256 and rows * CELLS_PER_ROW > MAX_CELLS * ranges:
        ranges *= 2
    if ranges == 1:
        cells, shared = repeated_filter(kept, column, rows)
        told = stored(with_flags(kept, column, cells, shared, name), "flagged")
        shared.destroy()
        return told
    last = F.conv(F.hex(F.substring(column, -1, 1)), 16, 10).cast("int")
    dealt = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    kept.withColumn("range", F.floor(last * ranges / 256).cast("int")).write.partitionBy("range").parquet(dealt)
    path, found = f"{shared_dir(spark)}/flagged-{uuid.uuid4().hex}", spark.read.parquet(dealt)
    for r in range(ranges):
        part = found.filter(F.col("range") == r).select(*kept.columns)
        cells, shared = repeated_filter(part, column, -(-rows // ranges))
        with_flags(part, column, cells, shared, name).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.parquet(path)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical once each run of white space is one space; null counts as empty, so
    null and empty texts are equal.  Of equal texts the row of the smallest key stays; a null key comes
    after all others, and of rows that repeat a key exactly one stays.
    """
    digests = with_rows(docs, doc_id=key, text=text).select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), "row")
    told = flagged(digests, "digest")
    rows = told.count()
    alone = told.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    some = told.filter("maybe")
    groups = some.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    groups = stored(groups.select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    shared = join_hot(some.select("doc_id", "row", "digest"), groups, "digest", "group_size", rows).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    return alone.unionByName(shared).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
