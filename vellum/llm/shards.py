"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and one more shard takes
rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import documents, stored, with_rows, without

#: Rows that one sorting group of the slot numbering has on average.
GROUP_ROWS = 5_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    state = keys.astype(np.uint64)
    shard = np.full(len(state), -1, np.int64)
    landing = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while live.size:
        shard[live] = landing[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        stretch = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        landing[live] = ((shard[live] + 1) * stretch).astype(np.int64)
        live = live[landing[live] < shards]
    return shard.astype(np.int32)


def key_of(key: Column) -> Column:
    """A stable 64-bit key: the hash of the key's text, so that integers and strings work alike; null is the empty string."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")))


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return jump(key_of(key))


def with_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id") -> DataFrame:
    """docs with a column ``shard``; a column of that name is replaced.  No shuffle.

    A null key is sharded as the empty string; rows of equal keys share a shard; an empty table stays empty.
    """
    return without(docs, "shard").withColumn("shard", shard_of(docs[key], shards))


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 8.  slot numbers a shard's rows from 0 without
    gaps.  The numbering sorts groups of about GROUP_ROWS rows, dealt by row, and adds each
    group's offset, so neither a shard nor a repeated key has to fit one task.  Repeated rows get slots of
    their own; a null key counts as the empty string.  docs has to come straight from files (see with_rows).
    """
    rows = docs.count()
    groups = max(1, -(-rows // (shards * GROUP_ROWS)))
    body = F.coalesce(F.col("text"), F.lit(""))
    flat = with_rows(docs, doc_id=key, text=text).select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        "row",
    )
    dealt = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    flat = stored(flat.withColumn("grp", dealt), "shards")
    sizes = flat.groupBy("shard", "grp").count()
    before = W.partitionBy("shard").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "grp", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy("shard", "grp").orderBy("doc_id", "row")
    return (
        flat.withColumn("rank", F.row_number().over(order))
        .join(offsets, ["shard", "grp"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )


def write(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id", files: int = 1) -> None:
    """Writes docs as one folder of Parquet files per shard, ``files`` files each, rows in key order."""
    dealt = with_shards(docs, shards, key).withColumn("_file", F.pmod(F.xxhash64(docs[key].cast("string"), F.lit(1)), F.lit(files)))
    dealt.repartition(shards * files, "shard", "_file").sortWithinPartitions("shard", key).drop("_file").write.partitionBy("shard").parquet(path)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))
