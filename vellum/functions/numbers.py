"""Small numeric Columns that every policy uses.  Literals are doubles: Spark would read 20.0 as a decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int | str


def col(x: Number) -> Column:
    """A Column as it is, a name as that column, a number as a double."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Number, low: Number = 0.0, high: Number = 1.0) -> Column:
    """x held between low and high; null stays null, where greatest() alone would answer with the bound."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, col(low)), col(high)))


def weighted(*terms: tuple[float, Number]) -> Column:
    """The sum of weight times value, added in the order given."""
    total = None
    for weight, value in terms:
        part = col(value) * F.lit(float(weight))
        total = part if total is None else total + part
    return total


def ratio(a: Number, b: Number, otherwise: Number = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is not positive."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(col(otherwise))


def cascade(*steps: tuple[Column, Column | str], otherwise: Column | str | None = None) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in steps:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def rounded(x: Number) -> Column:
    """x to six places, halves up, by operations that every engine does alike."""
    return F.floor(col(x) * 1e6 + 0.5) / F.lit(1e6)


def rounded_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"
