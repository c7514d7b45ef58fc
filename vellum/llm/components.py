"""Connected components of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_hot, stored

#: Of so many links (some 16 MB) no node can have more than one task bears: they are joined without a look for hot nodes.
FEW = 1_000_000


def round_of(pairs: DataFrame, links: int, large: bool) -> DataFrame:
    """One star operation on pairs (a, b), a > b: only minima are gathered of a node's neighbours, never their list."""
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = pairs.join(least, "a") if links <= FEW else join_hot(pairs, least, "a", "n", links)
    if large:
        new = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return new.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links (a, b) of whole numbers: component is the smallest node that it reaches.

    Links of a node to itself count for nothing.  Each round is written to the shared folder.
    """
    at = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        size = at.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before = size
        large = round_of(at, size[0], True)
        at = stored(round_of(large, size[0], False), "links")
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
