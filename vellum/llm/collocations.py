"""Collocations of two and three words by pivot partitioning, as in MG-FSM (Miliaraki et al., 2013).

Words are ordered by frequency.  The pivot of a phrase is its rarest word.  Each occurrence of a word sends the text around it to
the partition of that word, rewritten: words that are rarer than it, or too rare to be in any result, become blanks,
and so does what lies beyond them.  Rewritten fragments are often equal; equal ones of a task travel as one, with
their number.  A partition counts the phrases whose pivot it holds, and only those: a phrase that has its pivot more
than once is counted at the leftmost, as equal words to the left are blanks too.  So counts are whole within a partition,
and rare phrases never leave it.  Very common pivots are dealt out over several partitions by fragment; counts of their phrases
are added up once more.

The order of words comes from a list of the LISTED commonest words at most, known by 64-bit hashes.  Any order gives the same
result as long as all use the same one: words beyond the list are rarer than all of it and ordered by hash.  Words that share a
hash (of a vocabulary of 10^9 words some 0.1 pairs) are looked for and told apart by themselves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vellum.llm.common import discard, documents, join_hot, pick, stored

#: A phrase counts from so many occurrences on.
LEAST = 10
#: A phrase goes if a longer one that holds it has so many hundredths of its occurrences.
SHARE = 50
#: Phrases returned per language.
TOP = 2000
#: Words in the list that every task gets (16 bytes each).
LISTED = 1_000_000
#: A pivot with more occurrences is dealt out over several partitions.
SPLIT = 100_000
#: Words that a task holds at once.
CHUNK = 1_000_000
#: Bits of a word's hash that count; fewer only in tests, where words then share theirs.
BITS = -1
#: Ids of words beyond the list have this bit.
BEYOND = 1 << 62
#: One byte for each byte: A-Z in lower case, every separator of pieces a full stop.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with b"." wherever a piece ends; no word holds a full stop."""
    return text.translate(FOLD).replace(b".", b" . ").split()


def texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    flat = pick(docs, lang=lang, text=text)
    return flat.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")


def vocabulary(flat: DataFrame) -> DataFrame:
    """(lang, word, f, h): every word with its number of occurrences and its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counter in counts.items():
                counter.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()).cast(pa.string()), pa.array(list(counter.values()), pa.int64())], ["lang", "word", "f"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counts.setdefault(lang, Counter()).update(tokens(text.as_py()))
                if sum(map(len, counts.values())) > CHUNK:
                    yield from flush()
        yield from flush()

    return flat.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")).withColumn("h", F.xxhash64("lang", "word").bitwiseAND(F.lit(BITS).cast("long")))


class Order:
    """The list of common words: hashes in order with rank and occurrences; words whose hash is not theirs alone, by themselves."""

    def __init__(self, words: DataFrame, least: int) -> None:
        step = F.floor(F.log2("f") * 8)
        bins = words.filter(F.col("f") >= least).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f")).orderBy(F.desc("step")).collect()  # 512 rows at most
        total, self.floor = 0, 1 << 62
        for r in bins:
            total += r["n"]
            if total > LISTED:
                break
            self.floor = r["f"]
        self.whole = total <= LISTED
        self.least = least
        # equal in all but the bit that ids beyond the list lose: those could be taken for one another
        shared = words.groupBy((F.col("h").bitwiseAND(BEYOND - 1)).alias("part")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part")
        clash = words.withColumn("part", F.col("h").bitwiseAND(BEYOND - 1)).join(shared, "part", "left_semi")
        alone = sorted((r["f"], r["lang"], r["word"], r["h"]) for r in clash.collect())
        self.hidden = np.unique(np.array([h for *_, h in alone], np.int64))
        listed = words.filter(F.col("f") >= self.floor).select("h", "f").toArrow()
        h, f = listed.column("h").to_numpy(), listed.column("f").to_numpy()
        own = ~np.isin(h, self.hidden)
        h, f = h[own], f[own]
        by = np.lexsort((h, -f))
        self.names = pa.table({"h": h[by], "id": np.arange(1, len(h) + 1)})
        f = f[by]
        extra = [(lang, word) for n, lang, word, _ in alone if n >= least]
        self.alone = {key: len(h) + 1 + i for i, key in enumerate(extra)}
        self.f = np.concatenate([[0], f, [n for n, *_ in alone if n >= least]]).astype(np.int64)
        sort = np.argsort(h[by], kind="stable")
        self.hashes, self.ranks = h[by][sort], (sort + 1).astype(np.int64)

    def plain(self) -> tuple:
        """What ids_of() needs, to be sent to the tasks as plain values."""
        return self.hashes, self.ranks, self.hidden, self.alone, self.whole, self.f


def ids_of(sent: tuple, lang: str, words: list[bytes]) -> np.ndarray:
    """The id of each word: its rank, or its hash with BEYOND; 0 for what is known to be too rare."""
    hashes, ranks, hidden, alone, whole, _ = sent
    seed = xxh64_intdigest(lang.encode(), 42)
    h = np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)).astype(np.int64) & BITS
    found = np.zeros(len(h), np.int64) if whole else (h & (BEYOND - 1)) | BEYOND
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        found = np.where(hashes[at] == h, ranks[at], found)
    for i in np.flatnonzero(np.isin(h, hidden)):
        found[i] = alone.get((lang, words[i].decode()), 0)
    return found


def fragments(ids: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    """Rewritten fragments of a row of words (0: blank or end of a piece) with their number: pivot, two words to the left, two to the right, number, copies, copy."""
    padded = np.concatenate([[0, 0], ids, [0, 0]])
    p, near, far, after, later = padded[2:-2], padded[1:-3], padded[:-4], padded[3:-1], padded[4:]
    near = np.where(near < p, near, 0)
    far = np.where((near > 0) & (far < p), far, 0)
    after = np.where(after <= p, after, 0)
    later = np.where((after > 0) & (later <= p), later, 0)
    keep = (p > 0) & ((near > 0) | (after > 0))
    columns = [c[keep] for c in (p, far, near, after, later)]
    if not keep.any():
        return [*columns, *[np.zeros(0, np.int64)] * 3]
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    by = np.argsort(h)
    columns, h = [c[by] for c in columns], h[by]
    new = np.ones(len(h), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    columns, h = [c[at] for c in columns], h[at]
    number = np.diff(np.append(at, len(new)))
    pivot = columns[0]
    copies = np.where(pivot < BEYOND, f[np.where(pivot < BEYOND, pivot, 0)] // SPLIT + 1, 1)
    return [*columns, number, copies, (h % copies.astype(np.uint64)).astype(np.int64)]


def routed(flat: DataFrame, order: Order) -> DataFrame:
    """Fragments of all texts, equal ones of a task's stretch of text once."""
    names = ["p", "far", "near", "after", "later", "n", "copies", "copy"]
    sent = flat.sparkSession.sparkContext.broadcast(order.plain())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        waiting: dict[str, list[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for lang, words in waiting.items():
                if sum(map(len, known.values())) > CHUNK:
                    known.clear()
                table = known.setdefault(lang, {b".": 0})
                new = list(set(words).difference(table))
                table.update(zip(new, ids_of(sent.value, lang, new).tolist(), strict=True))
                rows += [np.fromiter(map(table.__getitem__, words), np.int64, len(words)), [0, 0]]
            waiting.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in fragments(np.concatenate(rows), sent.value[-1])], names)

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = tokens(text.as_py())
                row = waiting.setdefault(lang, [])
                row += words
                row.append(b".")
                held += len(words)
                if held > CHUNK:
                    yield from flush()
                    held = 0
        yield from flush()

    return flat.mapInArrow(send, ", ".join(f"{n} long" for n in names))


def phrases(flat: DataFrame, order: Order) -> DataFrame:
    """(a, b, c, f): ids of the words of each phrase of two (c is 0) or three, and its occurrences, LEAST at least."""

    def phrase(needed: str, a: str, b: str, c: str = "0L") -> Column:
        return F.expr(f"CASE WHEN {needed} > 0 THEN struct({a} AS a, {b} AS b, {c} AS c) END")

    own = F.array(phrase("near", "near", "p"), phrase("after", "p", "after"), phrase("far", "far", "near", "p"), phrase("least(near, after)", "near", "p", "after"), phrase("later", "p", "after", "later"))
    # grouped by more columns than it is dealt out by: the counting needs no further shuffle
    dealt = routed(flat, order).repartition("p", "copy")
    local = dealt.select("p", "copy", "copies", "n", F.explode(own).alias("x")).filter("x IS NOT NULL").groupBy("p", "copy", "copies", "x.a", "x.b", "x.c").agg(F.sum("n").alias("f"))
    kept = local.filter((F.col("copies") > 1) | (F.col("f") >= order.least))
    return kept.groupBy("a", "b", "c").agg(F.sum("f").alias("f")).filter(F.col("f") >= order.least)


def named(words: DataFrame, order: Order) -> DataFrame:
    """(id, lang, word, f) of every word that may be in a phrase."""
    spark = words.sparkSession
    listed = words.join(spark.createDataFrame(order.names), "h").select("id", "lang", "word", "f")
    rows = [(i, lang, word, int(order.f[i])) for (lang, word), i in order.alone.items()]
    listed = listed.unionByName(spark.createDataFrame(rows, "id long, lang string, word string, f long"))
    if order.whole:
        return listed
    hidden = spark.createDataFrame([(int(h),) for h in order.hidden], "h long")
    rest = words.filter((F.col("f") >= order.least) & (F.col("f") < order.floor)).join(F.broadcast(hidden), "h", "left_anti")
    return listed.unionByName(rest.select(F.col("h").bitwiseAND(BEYOND - 1).bitwiseOR(F.lit(BEYOND)).alias("id"), "lang", "word", "f"))


def scored(found: DataFrame, names: DataFrame) -> DataFrame:
    """found with phrase, lang, l, r and score of the lowest-scoring cut."""
    pair = F.struct(F.col("a").alias("x"), F.col("b").alias("y"))
    units = names.select(F.struct(F.col("id").alias("x"), F.lit(0).cast("long").alias("y")).alias("key"), "f", "lang", "word").unionByName(
        found.filter("c = 0").select(pair.alias("key"), "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word"))
    )
    wanted = F.expr("""filter(array(struct(0 AS slot, struct(a AS x, 0L AS y) AS key), struct(1 AS slot, struct(b AS x, 0L AS y) AS key), struct(2 AS slot, struct(c AS x, 0L AS y) AS key),
        struct(3 AS slot, struct(a AS x, b AS y) AS key), struct(4 AS slot, struct(b AS x, c AS y) AS key)), z -> c > 0 OR z.slot < 2)""")
    looked = found.select("a", "b", "c", F.col("f").alias("whole"), F.explode(wanted).alias("z")).select("a", "b", "c", "whole", "z.slot", "z.key")
    sizes = looked.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    joined = join_hot(looked, units.join(sizes, "key"), "key", "size", looked.count())
    slots = [F.max(F.when(F.col("slot") == k, F.col("f"))).alias(f"f{k}") for k in range(5)] + [F.max(F.when(F.col("slot") == k, F.col("word"))).alias(f"w{k}") for k in range(3)]
    rows = joined.groupBy("a", "b", "c", "whole").agg(F.max("lang").alias("lang"), *slots)
    square = "CAST(whole AS DECIMAL(16,0)) * CAST(whole AS DECIMAL(16,0)) * CAST(1000000 AS DECIMAL(7,0))"
    # whole <= l and whole <= r, so the quotient is a million at most; sixteen digits each keep products below 38
    cut = "CAST(({0}) DIV (CAST({1} AS DECIMAL(16,0)) * CAST({2} AS DECIMAL(16,0))) AS LONG)"
    rows = rows.withColumn("second", F.coalesce(F.col("f4"), F.col("f1"))).withColumns({"one": F.expr(cut.format(square, "f0", "second")), "two": F.expr(cut.format(square, "f3", "f2"))})
    late = F.coalesce(F.col("two") < F.col("one"), F.lit(False))
    return rows.select(
        "a", "b", "c", F.col("whole").alias("f"), "lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"),
        F.when(late, F.col("f3")).otherwise(F.col("f0")).alias("l"), F.when(late, F.col("f2")).otherwise(F.col("second")).alias("r"), F.when(late, F.col("two")).otherwise(F.col("one")).alias("score"),
    )


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; a language's rows meet in one task only after most are gone."""
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    parts = max(1, math.isqrt(rows.count() // top))
    few = rows.withColumn("_part", F.pmod(F.xxhash64("a", "b", "c"), F.lit(parts)))
    few = few.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """One row per phrase kept: lang, rank, phrase, a, l, r, n, score.

    Null texts and empty ones have no words; a null language counts as ``und``, together with documents marked so.  Rows that repeat a
    document count again.  An empty table gives no row.  Order among equal scores: occurrences, then the phrase's UTF-8 bytes.
    """
    flat = texts(docs, text, lang)
    words = stored(vocabulary(flat), "vocabulary")
    order = Order(words, least)
    found = stored(phrases(flat, order), "phrases")
    rows = stored(scored(found, named(words, order)), "scored")
    longer = found.filter("c > 0").select(F.explode(F.expr("array(struct(a AS x, b AS y), struct(b AS x, c AS y))")).alias("k"), "f").groupBy("k.x", "k.y").agg(F.max("f").alias("most"))
    inside = rows.join(longer, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("c") == 0), "left")
    kept = inside.filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("f"))).drop("x", "y", "most")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    result = stored(best(kept, top).join(n, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score"), "collocations")
    discard(words, found, rows)
    return result


OP13_SQL = """WITH t AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM t),
i AS MATERIALIZED (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
o AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM i),
u AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM o GROUP BY ALL),
b AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM o WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
g AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM o WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, 1 AS k, l.f AS l, r.f AS r FROM b JOIN u l ON l.lang = b.lang AND l.x = b.x JOIN u r ON r.lang = b.lang AND r.x = b.y
    WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = b.lang AND 100 * g.f >= 50 * b.f AND ((g.x = b.x AND g.y = b.y) OR (g.y = b.x AND g.z = b.y)))
  UNION ALL SELECT g.lang, g.x || ' ' || g.y || ' ' || g.z, g.f, 1, l.f, r.f FROM g JOIN u l ON l.lang = g.lang AND l.x = g.x JOIN b r ON r.lang = g.lang AND r.x = g.y AND r.y = g.z
  UNION ALL SELECT g.lang, g.x || ' ' || g.y || ' ' || g.z, g.f, 2, l.f, r.f FROM g JOIN b l ON l.lang = g.lang AND l.x = g.x AND l.y = g.y JOIN u r ON r.lang = g.lang AND r.x = g.z),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM m WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM q JOIN (SELECT lang, sum(f) AS n FROM u GROUP BY lang) USING (lang) WHERE rank <= 2000"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
