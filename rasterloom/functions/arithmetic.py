"""Integer and rounding helpers that several column functions share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column from a name, a column or a number."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def bound(x, use) -> Column:
    """use(x), where x is worked out once for a row however often use refers to it, within lambdas, too."""
    return F.transform(F.array(col(x)), use)[0]


def bag_digest(*columns: str) -> Column:
    """An aggregate that is equal for equal bags of rows, whatever their order: their number and two sums
    of independent hashes. Unlike a sorted list it has a fixed size and is summed up before a shuffle."""
    sums = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return F.struct(F.count(F.lit(1)).alias("n"), *(s.alias(f"h{i}") for i, s in enumerate(sums)))


def div(a, b) -> Column:
    """Integer quotient of non-negative numbers, as bigint."""
    return F.call_function("div", col(a).cast("bigint"), col(b).cast("bigint"))


def ceil_div(a, b) -> Column:
    """Number of steps of b that cover a (non-negative)."""
    return div(col(a) + col(b) - 1, b)


def half_floor(total) -> Column:
    """Half of a sum, rounded down for negative sums, too."""
    return F.floor(col(total) * 0.5).cast("bigint")


def clamp(x, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(x)))


def bounded_int(text, default: int, low: int, high: int) -> Column:
    """An option given as text: unreadable text counts as the default, then it is clamped."""
    return clamp(F.coalesce(col(text).try_cast("bigint"), F.lit(default)), low, high).cast("bigint")


def missing_zero(x, default) -> Column:
    """Zero and null both mean that a header field is missing."""
    return F.coalesce(F.nullif(col(x), F.lit(0)), col(default))
