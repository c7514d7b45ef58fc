"""Choosing among the candidates of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best(candidates: DataFrame, page: str, by: Column, *keep: str, order: str = "ord") -> DataFrame:
    """The candidate of highest value; of equal ones the first.  One aggregation, combined before the shuffle."""
    top = candidates.groupBy(page).agg(F.max_by(F.struct(order, *keep, by.alias("value")), F.struct(by, -F.col(order))).alias("b"))
    return top.select(page, "b.*")


def best_conservative(scored: DataFrame, page: str) -> DataFrame:
    """The highest score, or the largest of the alternatives that are much larger and hardly worse.

    scored has ord, score, area_ratio, paper, contrast, line_penalty, continuation.  An alternative has 1.16 times the
    area, a score less by 0.10 at most, and evidence of its own.
    """
    narrow = scored.select(page, "ord", "score", "area_ratio", "paper", "contrast", "line_penalty", "continuation")
    # one sorted pass tells each candidate the best of its page; the choice among alternatives then needs no further shuffle
    by_score = W.partitionBy(page).orderBy(F.desc("score"), "ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = narrow.withColumn("t", F.first(F.struct("ord", "score", "area_ratio", "continuation")).over(by_score))
    other = (
        (F.col("area_ratio") >= F.col("t.area_ratio") * 1.16)
        & (F.col("score") >= F.col("t.score") - 0.10)
        & (F.col("paper") >= 0.50)
        & (F.col("contrast") >= 0.16)
        & (F.col("line_penalty") < 0.62)
        & (F.col("continuation") <= F.col("t.continuation") + 0.10)
    )
    found = F.struct("ord", "score", "area_ratio")
    chosen = told.groupBy(page).agg(F.first("t").alias("t"), F.max_by(F.when(other, found), F.when(other, F.struct(F.col("area_ratio"), -F.col("ord")))).alias("a"))
    return chosen.select(page, *[F.coalesce(F.col(f"a.{c}"), F.col(f"t.{c}")).alias(c) for c in ("ord", "score", "area_ratio")], F.col("a").isNotNull().alias("alternative"))


def top_k(candidates: DataFrame, page: str, kind: str, by: str, limits: dict[str, int]) -> DataFrame:
    """The first so many of each kind of a page, by value, equal ones in order: before costly scoring.  Other kinds go."""
    rank = F.row_number().over(W.partitionBy(page, kind).orderBy(F.desc(by), "ord"))
    limit = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in limits.items()], F.lit(0))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= limit)


def largest_plausible(components: DataFrame, page: str, ratio: str) -> DataFrame:
    """The largest component whose share of the mask is plausible; of equal ones the first."""
    return best(components.filter(F.col(ratio).between(0.02, 0.995)), page, F.col(ratio))
