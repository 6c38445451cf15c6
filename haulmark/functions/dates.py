"""Dates and durations, independent of the session time zone.

A ``timestamp_ntz`` column is taken as written; an instant (``timestamp``)
is read on the UTC calendar.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from haulmark.functions.nulls import as_col


def utc_date(df: DataFrame, name: str) -> Column:
    """Calendar date of ``df[name]``."""
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.to_date(F.to_utc_timestamp(F.col(name), F.current_timezone()))
    return F.to_date(F.col(name))


def in_years(c: str | Column, first: int, last: int) -> Column:
    """Whether a date or timestamp falls in a closed range of years.

    A plain range on the stored column, so it prunes Parquet row groups.
    """
    c = as_col(c)
    return (c >= F.lit(date(first, 1, 1))) & (c < F.lit(date(last + 1, 1, 1)))


def day_of_year(date: Column) -> Column:
    return F.dayofyear(date)


def hours_between(start: str, end: str) -> Column:
    """Signed hours from ``start`` to ``end`` as a double."""
    seconds = (F.col(end) - F.col(start)).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / F.lit(3600.0)
