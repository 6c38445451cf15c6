"""Missing-value rules.

Spark aggregates skip NULL; the summaries rebuilt here mostly must not. The
``strict_*`` aggregates return NULL as soon as one input row is NULL, the plain
Spark aggregates are used where missing values are to be skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_count() -> Column:
    """Rows of the group, rows with missing values included."""
    return F.count(F.lit(1))


def strict(aggregate: Callable[[Column], Column], c: str | Column) -> Column:
    """``aggregate(c)``, or NULL when any row of the group has a NULL ``c``."""
    c = as_col(c)
    return F.when(row_count() == F.count(c), aggregate(c))


def finite(c: str | Column) -> Column:
    """The value as a double; NULL for NaN and infinities."""
    c = as_col(c).try_cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def strict_min(c: str | Column) -> Column:
    return strict(F.min, c)


def strict_max(c: str | Column) -> Column:
    return strict(F.max, c)


def distinct_with_null(c: str | Column) -> Column:
    """Distinct values of the group, a missing value counting as one of them."""
    c = as_col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0))


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that stays NULL where the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def is_in(c: str | Column, values: Iterable) -> Column:
    """Membership that is never NULL, so it can be negated safely."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def null_to(c: str | Column, value) -> Column:
    return F.coalesce(as_col(c), F.lit(value))


def zero_fallback(c: str | Column, fallback: str | Column) -> Column:
    """``fallback`` where ``c`` is 0. A NULL ``c`` is kept, not replaced."""
    c = as_col(c)
    return F.when(c == 0, as_col(fallback)).otherwise(c)
