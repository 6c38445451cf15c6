"""Row selection, ordering and stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def below_global_max(df: DataFrame, c: str) -> DataFrame:
    """Drop the rows that hold the largest value of ``c``.

    The maximum is a scalar subquery, a second pass over that one column; where a summary
    is wanted, ``without_newest`` drops it from the groups instead.
    """
    return df.filter(F.col(c) < df.agg(F.max(c)).scalar())


def without_newest(summary: DataFrame, c: str) -> DataFrame:
    """Drop the largest value of ``c`` from a summary, whose groups meet in one window."""
    newest = F.max(c).over(Window.partitionBy())
    return summary.withColumn("_newest", newest).filter(F.col(c) < F.col("_newest")).drop("_newest")


def outside(c: Column, low: float, high: float) -> Column:
    return (c < low) | (c > high)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged(df: DataFrame, **tags: str) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in tags.items()})


def order_nulls_last(df: DataFrame, *cols: str) -> DataFrame:
    """Ascending sort with missing values last. For sinks and reports."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def level_position(c: str, levels: Sequence) -> Column:
    """Position of a value in its declared level order, NULL when undeclared."""
    return F.nullif(
        F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c)), F.lit(0).cast("bigint")
    )


def order_by_levels(
    df: DataFrame, levels: Mapping[str, Sequence], order: Sequence[str]
) -> DataFrame:
    """Sort by ``order``, the columns in ``levels`` by declared position."""
    keys = [level_position(c, levels[c]) if c in levels else F.col(c) for c in order]
    return df.orderBy(*[k.asc_nulls_last() for k in keys])
