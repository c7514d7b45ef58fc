"""Names that are still free, for many new files at once, as if they were given out one by one.

The names of a stem are numbered; some numbers are taken.  The k-th new file gets the k-th free number, which is k plus the
taken numbers below it: those before which there are fewer than k free ones.  That is a range lookup, done as one running count over taken
numbers and new files together, so a stem with very many files is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.scans import running


def free_numbers(new: DataFrame, taken: DataFrame, stem: str, order: list[str], number: str, start: int = 1, large: int | None = None) -> DataFrame:
    """new with ``number``: free ones from ``start`` on, in order.  Taken numbers below the start and repeated ones count for nothing."""
    used = taken.filter(F.col(number) >= start).select(stem, F.col(number).alias("_taken")).distinct()
    before = running(used, stem, ["_taken"], F.lit(1).cast("long"), "_rank", "sum", large)
    # free numbers below a taken one
    marks = before.select(stem, (F.col("_taken") - start - (F.col("_rank") - 1)).alias("_at"), F.lit(0).alias("_new"))
    turns = running(new, stem, order, F.lit(1).cast("long"), "_turn", "sum", large).withColumns({"_at": F.col("_turn") - 1, "_new": F.lit(1)})
    both = turns.unionByName(marks, allowMissingColumns=True)
    counted = running(both, stem, ["_at", "_new"], (F.col("_new") == 0).cast("long"), "_below", "sum", large)
    return counted.filter("_new = 1").withColumn(number, F.col("_turn") + F.col("_below") + (start - 1)).drop("_turn", "_at", "_new", "_below")


def numbered_name(stem: Column, number: Column, extension: str) -> Column:
    """base.ext, base_2.ext and so on."""
    return F.concat(stem, F.when(number == 1, "").otherwise(F.concat(F.lit("_"), number.cast("string"))), F.lit(f".{extension}"))


def number_of(name: Column, stem: Column, extension: str) -> Column:
    """The number that a file's name has among those of a stem; null if it is none of them."""
    rest = F.regexp_extract(F.substring(name, F.length(stem) + 1, F.length(name)), rf"^(?:_([0-9]{{1,18}}))?\.{extension}$", 1)
    mine = F.startswith(name, stem) & F.substring(name, F.length(stem) + 1, F.length(name)).rlike(rf"^(_([2-9]|[1-9][0-9]{{1,17}}))?\.{extension}$")
    return F.when(mine, F.when(rest == "", 1).otherwise(rest.cast("long")))
