"""The corpus pipeline: stages of training-data operators, each over all that its predecessor kept.

Every stage returns the columns of the table that it was given; the last replaces or adds ``shard``.  Rows come
out of each stage as often as it keeps them: once or not at all, and after mixing up to twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, langid, mix, neardup, shards
from vellum.llm.common import discard, documents, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the documents themselves; those that the classifier rejects go (no letter, or a confidence below its threshold)."""
    kept = langid.predict(numbered(docs), langid.fit(docs), text=at(docs, "text"), names=("_lang", "_score", "_rejected")).filter("not _rejected")
    return plain(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, the one of the smallest doc_id stays."""
    return neardup.keep_first(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard, 0 to 23, that the doc_id belongs to; takes the place of any column ``shard``."""
    return shards.with_shards(docs, 24)


def at(docs: DataFrame, name: str) -> str:
    """The name that numbered() gives a column; Spark finds columns in any case."""
    return f"_{[c.lower() for c in docs.columns].index(name.lower())}"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns _0, _1, ... so that no name of theirs clashes."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])


def plain(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*[kept[f"_{i}"].alias(c) for i, c in enumerate(docs.columns)])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Language identification is learned: SQL cannot express it.  A test holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path, before = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}", docs
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
