"""Title suggestion: the best line of a page, and the first page of two that has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.numbers import rounded

#: Lines further down than this are not ranked once a line has been.
LOWEST = 0.62


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a plain projection would be copied into every condition that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def meaningful_lines(lines: DataFrame) -> DataFrame:
    """Lines that may be a title, with line, top and score.

    Lines have ord (reading order) and raw; where they have the columns box_top, box_height and page_height, place and
    size come from these (null or no page height: from the reading order, no size), and confidence counts if there.
    """
    df = computed(lines.filter(F.col("raw").rlike(T.LETTER)), "line", T.collapsed(F.col("raw"))).drop("raw")
    n = F.col("units")
    df = computed(df, "units", T.units(F.col("line"))).filter(T.is_meaningful(F.col("line"), n))
    confidence = F.col("confidence") if "confidence" in lines.columns else 0.5
    if "box_top" not in lines.columns:
        return df.withColumn("top", T.title_top(F.col("ord"))).withColumn("score", T.title_score(F.col("line"), F.col("top"), 0.0, confidence, n))
    boxed = F.col("box_top").isNotNull() & (F.col("page_height") > 0)
    height = F.when(boxed, F.col("box_height") / F.col("page_height")).otherwise(0.0)
    df = df.withColumn("top", T.title_top(F.col("ord"), F.col("box_top"), F.col("page_height")))
    return df.withColumn("score", T.title_score(F.col("line"), F.col("top"), height, confidence, n))


def best_titles(lines: DataFrame, *keys: str) -> DataFrame:
    """One row per page that has a meaningful line: its title and score.  Of equal scores the earlier line wins.

    A line too far down counts only where it is the first of the page's meaningful lines.  So the best of the
    lines above and the first of all compete, both found by one aggregation that combines before the shuffle.
    """
    rank = F.struct(F.col("score"), (-F.col("ord")).alias("turn"), F.col("line"))
    found = meaningful_lines(lines).groupBy(*keys).agg(F.max(F.when(F.col("top") <= LOWEST, rank)).alias("b"), F.min_by(rank, "ord").alias("f"))
    found = found.select(*keys, F.greatest("b", "f").alias("b"))
    return found.select(*keys, T.safe_base_name(T.truncated(F.col("b.line"))).alias("title"), rounded("b.score").alias("score"))


def recognised_lines(results: DataFrame) -> DataFrame:
    """Lines (page, ord, raw, box_top, box_height, confidence, language, page_height) of recognition results.

    Results: page, source_height, blocks (text, lines (text, box (left, top, right, bottom), confidence, language)).  Reading
    order goes through the blocks; empty and undetermined languages are null.
    """
    blocks = results.select("page", "source_height", F.posexplode("blocks").alias("block", "b"))
    lines = blocks.select("page", "source_height", "block", F.posexplode("b.lines").alias("at", "l"))
    order = F.row_number().over(W.partitionBy("page").orderBy("block", "at")) - 1
    return lines.select(
        "page", order.alias("ord"), F.col("l.text").alias("raw"), F.col("l.box.top").cast("double").alias("box_top"), (F.col("l.box.bottom") - F.col("l.box.top")).cast("double").alias("box_height"),
        F.col("l.confidence").alias("confidence"), T.language(F.col("l.language")).alias("language"), F.col("source_height").alias("page_height"),
    )


def first_titles(lines: DataFrame, key: str, page: str) -> DataFrame:
    """The title of the first page, in order, that has one which is not empty."""
    titles = best_titles(lines, key, page).filter("title <> ''")
    return titles.groupBy(key).agg(F.min_by("title", page).alias("title"), F.min(page).alias(page))
