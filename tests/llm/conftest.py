import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns that clash with names that the operators use
    *[T.StructField(n, T.StringType()) for n in ("row", "Shard", "size", "keep_id", "set", "bits", "_row", "_0", "score", "rejected", "taken", "digest")],
])
N_EXTRA = len(SCHEMA) - 5


def prose(rng, n, words="the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "ing", "ed", "er"]) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and keys, near copies."""
    rng = random.Random(4)
    base, other = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[60] = "replaced"
    texts = [None, "", "   \t\n", "!!! ... 123", "word", "one two three four", base, base, base.upper(), " ".join(near), base + " tail", other, other.replace(" ", "  "), prose(rng, 20_000), "x" * 50_000, "é" * 300 + base, base + "\n" + base, "漢字 かな 한국어 русский"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", None, "b", "ß"][i % 4], None if i % 2 else i) for i, t in enumerate(texts)]
    rows += [(6, base, "en", "a", 1), (6, base, "en", "a", 1), (7, "other text under a known key", None, None, None), (None, base, None, None, None), (None, None, None, None, None), (10**15, other, "fr", "b", 3)]
    rows += [(100 + i, prose(rng, 30 + i), "en" if i % 2 else "fr", "abc"[i % 3], i) for i in range(20)]
    return [(*r, *["extra"] * N_EXTRA) for r in rows]


def stored(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("odd") / "documents.parquet", odd_rows())


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("empty") / "documents.parquet", [])
