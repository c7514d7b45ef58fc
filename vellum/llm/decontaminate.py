"""Benchmark decontamination by spaced-seed hashing (Ma, Tromp and Li, 2002), in DataFrame functions only.

Words are runs of letters and digits, in lower case.  Fixed masks pick some of the words from a place on;
their hash is a seed.  Seeds of documents (from every second place) meet seeds of benchmark items (from every
place); around each hit the document is laid along the item, and agrees with it if a window of 12 words
holds 10 equal ones.  In any such window, and in any window of 8 to 11 words with one exception, at least
one of the three masks fits between the exceptions, at even and at odd places, so no overlap goes unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import documents, join_dealt, pick, plain, stored, with_rows

# fixed values: the masks, found by search
MASKS = ("11111", "1101011", "111011")
STRIDE = 2
WINDOW, SHORTEST = 12, 8
#: Broadcast up to so many benchmark seeds, items or document numbers; beyond, they are shuffled.
BROADCAST_SEEDS, BROADCAST_ITEMS, BROADCAST_ROWS = 1_000_000, 10_000, 2_000_000


def words(text: str) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def seeds(rows: DataFrame, tokens: str, stride: int) -> DataFrame:
    """rows without tokens, one row for each place and mask that fits there: n (words), place, seed.

    Places are rows and seeds plain columns of words' hashes, so all of it is generated code.
    """
    others = [c for c in rows.columns if c != tokens]
    hashed = rows.select(*others, F.transform(tokens, lambda t: F.xxhash64(t)).alias("hashes"))
    shortest = min(map(len, MASKS))
    hashed = hashed.filter(F.size("hashes") >= shortest)
    placed = hashed.select(*others, "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - shortest, F.lit(stride))).alias("place"))
    found = []
    for number, mask in enumerate(MASKS):
        kept = [k for k, c in enumerate(mask) if c == "1"]
        seed = F.xxhash64(F.lit(number), *[F.get("hashes", F.col("place") + k) for k in kept])
        found.append(F.when(F.col("place") + len(mask) <= F.size("hashes"), seed))
    return placed.select(*others, F.size("hashes").alias("n"), "place", F.explode(F.array(*found)).alias("seed")).filter(F.col("seed").isNotNull())


def join_counted(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to groups, by shuffle: keys that many rows have are counted first, and their rows dealt out over copies of the group."""
    sizes = stored(rows.groupBy(key).agg(F.count("*").alias("times")).join(groups.select(key).distinct(), key, "left_semi"), "sizes")
    total = sizes.agg(F.sum("times")).first()[0] or 0
    return join_dealt(rows, groups.join(sizes, key), key, "times", total, sizes=sizes).drop("times")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """row, doc_id, item_id, n_item, agree: one row per document and item that overlap.

    n_item is the item's number of words, agree the most equal words in a window.  Items of fewer than 8
    words match nothing, as do null and empty texts; items of 8 to 11 words are one window, with one exception.
    Rows that repeat a key, and items that repeat an id, are documents and items of their own.  docs has to come
    straight from files (see with_rows).
    """
    flat = with_rows(docs, doc_id=key, text=text)
    items = pick(benchmark, item_id=item, text=item_text).withColumn("item", F.monotonically_increasing_id())
    items = stored(items.select("item", "item_id", words("text").alias("its")).filter(F.size("its") >= SHORTEST), "items")
    wanted = stored(seeds(items.select("item", "its"), "its", 1).select("seed", "item", F.col("n").alias("n_item"), F.col("place").alias("at_item")), "seeds")

    spread = seeds(flat.select("row", words("text").alias("tokens")), "tokens", STRIDE).select("row", "place", "seed")
    hits = spread.join(F.broadcast(wanted), "seed") if wanted.count() <= BROADCAST_SEEDS else join_counted(spread, wanted, "seed")
    hits = stored(hits.select("row", "item", "n_item", (F.col("place") - F.col("at_item")).alias("shift")).distinct(), "hits")

    rows = hits.select("row").distinct()
    some = flat.join(F.broadcast(rows) if hits.count() <= BROADCAST_ROWS else rows, "row", "left_semi").select("row", "doc_id", words("text").alias("tokens"))
    # of a document's words only those that lie along the item go on
    along = F.slice("tokens", F.greatest(F.lit(0), F.col("shift")) + 1, F.greatest(F.lit(0), F.col("n_item") + F.least(F.lit(0), F.col("shift"))))
    laid = some.join(hits, "row").select("row", "doc_id", "item", F.least(F.lit(0), F.col("shift")).alias("shift"), along.alias("tokens"))
    laid = laid.join(F.broadcast(items), "item") if items.count() <= BROADCAST_ITEMS else join_counted(laid, items, "item")
    start = F.greatest(F.lit(0), -F.col("shift"))
    end = F.least(F.size("its"), F.size("tokens") - F.col("shift"))
    equal = F.transform(F.sequence(start, end - 1), lambda q: (F.get("tokens", q + F.col("shift")) == F.get("its", q)).cast("int"))
    laid = laid.select("row", "doc_id", "item", "item_id", F.size("its").alias("n_item"), equal.alias("equal"))
    width = F.least(F.lit(WINDOW), F.col("n_item"))
    windows = F.transform(F.sequence(F.lit(1), F.size("equal") - width + 1), lambda s: F.aggregate(F.slice("equal", s, width), F.lit(0), lambda a, b: a + b))
    agree = F.when(F.size("equal") >= width, F.array_max(windows)).otherwise(0)
    found = laid.withColumn("agree", agree).filter(F.col("agree") >= width - F.floor(width / 6))
    return found.groupBy("row", "item").agg(*[F.first(c).alias(c) for c in ("doc_id", "item_id", "n_item")], F.max("agree").alias("agree")).drop("item")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that overlap with an item; all columns stay.

    Null, empty and short texts overlap with nothing and stay; rows that repeat a key or a text are judged each on
    its own; an empty table stays empty, and without items all rows stay.
    """
    gone = stored(overlaps(docs, benchmark, key, text).select("row").distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return plain(with_rows(docs).join(gone, "row", "left_anti"), docs)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "n_item", "agree")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
i AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM b WHERE len(ws) >= 8),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
m AS (SELECT doc_id, item_id, n, p - q AS shift, q FROM t JOIN i USING (w)),
many AS (SELECT doc_id, item_id, shift FROM m GROUP BY ALL HAVING count(*) >= least(12, any_value(n)) - least(12, any_value(n)) // 6),
r AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS agree
  FROM m SEMI JOIN many USING (doc_id, item_id, shift))
SELECT doc_id, item_id, any_value(n)::INTEGER AS n_item, max(agree)::INTEGER AS agree FROM r
WHERE agree >= least(12, n) - least(12, n) // 6 GROUP BY doc_id, item_id
"""
