"""Mixing sources to target weights by weighted fair queueing.

Each shuffled copy of a document has a virtual finish time: the tokens its source has sent up to and
with it, divided by the source's target.  All copies, sorted by that time and cut at the total budget,
are the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import WORD, documents, plain, stored, with_rows

#: Rows that one sorting group has on average.
GROUP_ROWS = 5_000
#: Keys whose rows are shuffled one by one, at most.
MOST_CROWDED = 10_000
#: Virtual time is 1 where every source has sent its target.
SHARES = (3, 1, 2)
#: A table of row numbers and counts of so many rows (16 MB) is broadcast, a larger one shuffled.
BROADCAST_ROWS = 1_000_000


def targets(sizes: DataFrame, share: float, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """source, place, source_size, target for one row of (source, source_size) a source.

    Sources take the weights in turn, by code point, null last, and share ``share`` of all tokens.  A target
    stops at ``repeats`` times its source's size.  A source is at its limit exactly if the level at which
    those with a smaller limit for their weight are full, and the others share the rest, reaches its own.  The first that is
    not has the level of all that are not; the levels of those after it only fall.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("place", turn).withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    by_limit = W.orderBy(F.col("most") / F.col("weight"), "place")
    everything = W.partitionBy(F.lit(0))
    t = (
        t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("most").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("left"))
        .withColumn("at_limit", F.col("level") * F.col("weight") >= F.col("most"))
        .withColumn("level", F.max(F.when(~F.col("at_limit"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("at_limit"), F.col("most")).otherwise(F.col("level") * F.col("weight")))
    )
    return t.select("source", "place", "source_size", "target")


def queue(docs: DataFrame, key: str, text: str, source: str, share: float, repeats: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(documents by row number, their copies with virtual finish time and the tokens sent until then)."""
    flat = with_rows(docs, doc_id=key, text=text, source=source)
    flat = flat.withColumn("size", F.regexp_count("text", F.lit(WORD))).withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    flat = stored(flat.select("doc_id", "source", "size", F.md5(name.cast("binary")).alias("turn"), "row"), "sizes")
    # rows of a key that many rows share take turns of their own; at least a ten-thousandth of all rows each, those keys are few
    crowd = flat.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(GROUP_ROWS, flat.count() // MOST_CROWDED)).select("turn", F.lit(True).alias("crowded"))
    own = F.md5(F.concat_ws(":", "turn", F.col("row").cast("string")).cast("binary"))
    flat = flat.join(F.broadcast(crowd), "turn", "left").withColumn("turn", F.when(F.col("crowded"), own).otherwise(F.col("turn"))).drop("crowded")
    by_source = flat.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = stored(targets(by_source.select("source", "source_size"), share, repeats, weights), "targets")

    # within a source: groups along the shuffled order, each of about GROUP_ROWS rows
    counts = plan.join(by_source.select("source", "rows"), plan["source"].eqNullSafe(by_source["source"])).select(
        plan["source"], "place", "source_size", "target", F.ceil(F.col("rows") / GROUP_ROWS).cast("long").alias("groups")
    )
    f = flat.alias("f").join(counts.alias("c"), F.col("f.source").eqNullSafe(F.col("c.source"))).drop(F.col("c.source"))
    where = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    f = f.withColumn("grp", F.floor(where * F.col("groups") / F.lit(float(1 << 32))).cast("long"))
    in_group = W.partitionBy("place", "grp").orderBy("turn", "doc_id", "size", "row")
    sums = f.groupBy("place", "grp").agg(F.sum("size").alias("tokens"))
    before = W.partitionBy("place").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("place", "grp", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    f = f.withColumn("sent", F.sum("size").over(in_group.rowsBetween(W.unboundedPreceding, 0))).join(offsets, ["place", "grp"])
    f = f.withColumn("sent", F.col("sent") + F.col("offset"))
    f = stored(f.select("doc_id", "source", "size", "turn", "row", "place", "source_size", "target", "sent"), "queues")

    # all sources: virtual time in ranges of equal width, which hold about equally many tokens
    copies = f.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("again"))
    copies = copies.withColumn("finish", F.try_divide(F.col("sent") + F.col("again") * F.col("source_size"), F.col("target")))
    rows = flat.count()
    ranges = max(1, rows // GROUP_ROWS + 1)
    # beyond 2, where only sources far over their target have copies left, widths grow with the time
    # a source without words sends nothing: its copies may stand anywhere before the cut
    finish = F.coalesce("finish", F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / float(1 << 32))
    scaled = F.when(finish < 2, finish).otherwise(F.log2(F.greatest(finish, F.lit(2.0))) + 1)
    copies = copies.withColumn("range", F.floor(scaled * F.lit(float(ranges))))
    loads = copies.groupBy("range").agg(F.sum("size").alias("tokens"))
    starts = loads.select("range", F.coalesce(F.sum("tokens").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    in_range = W.partitionBy("range").orderBy("finish", "place", "again", "sent", "turn", "row")
    copies = copies.withColumn("sum", F.sum("size").over(in_range.rowsBetween(W.unboundedPreceding, 0))).join(starts, "range")
    return f, copies.withColumn("until", F.col("start") + F.col("sum")).drop("sum", "start")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = SHARES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies, row.

    size is the number of words (null text: 0), taken the words the mix takes of the document, repeats
    counted.  Null is a source of its own, the last.  A source without words has target 0.  Rows that repeat
    a key are documents of their own; the shuffle orders documents by the hash of their key (of key and row number, for keys
    that more than GROUP_ROWS rows share), so reruns agree.
    """
    f, copies = queue(docs, key, text, source, share, repeats, weights)
    total = f.agg(F.sum("size")).first()[0] or 0
    kept = copies.filter(F.col("until") <= F.lit(total * float(share)))
    taken = kept.groupBy("row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).cast("int").alias("copies"))
    return f.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", F.coalesce("copies", F.lit(0)).alias("copies"), "row"
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.  docs has to come straight from files (see with_rows).

    Documents without words cost nothing and follow the same cut.
    """
    times = stored(mix(docs, **options).filter("copies > 0").select("row", F.col("copies").alias("_copies")), "taken")
    if times.count() <= BROADCAST_ROWS:
        times = F.broadcast(times)
    again = with_rows(docs).join(times, "row").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return plain(again, docs)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(place - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM p),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
g AS (SELECT *, lv * weight >= most AS at_limit FROM l),
t AS (SELECT source, place, source_size, CASE WHEN at_limit THEN most ELSE (max(lv) FILTER (NOT at_limit) OVER ()) * weight END AS target FROM g),
q AS (SELECT d.doc_id, d.size, d.turn, t.place, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.place ORDER BY d.turn, d.doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (sent + again * source_size) / target AS finish FROM q, (VALUES (0), (1)) a(again)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, place, again, sent, turn ROWS UNBOUNDED PRECEDING) AS until FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  coalesce(sum(size) FILTER (until <= (SELECT sum(size) * 1.5::DOUBLE FROM d)), 0)::BIGINT AS taken
FROM o GROUP BY doc_id
"""
