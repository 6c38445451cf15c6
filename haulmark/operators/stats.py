"""Summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.measures import ratio, round_even
from haulmark.functions.nulls import (
    distinct_with_null,
    row_count,
    strict_max,
    strict_min,
)
from haulmark.operators import totals


def share_of_total(
    df: DataFrame, value: str, within: Sequence[str], digits: int = 4, name: str = "proportion"
) -> DataFrame:
    """``value`` over its total in ``within``, rounded half to even."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(name, round_even(F.col(value) / total, digits))


def rate_summary(
    df: DataFrame, value: str, by: Sequence[str], mean: str = "mean", counted: Column | None = None
) -> DataFrame:
    """Mean, sd, n, se, CV and RSE of a rate.

    Missing rates are skipped by the mean and sd but counted in ``n``. Each later column
    uses the rounded earlier ones. Built from exact sums, so no published digit depends on
    how the rows are spread. Rows that are not ``counted`` still make a group, of 0 rows.
    """
    counted = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    rate = F.when(counted, F.col(value))
    parts = totals.exact_parts(df, by, rate, spread=True, counts={"n": counted})
    return (
        totals.exact_totals(parts, by, ["n"], **{mean: totals.mean(2), "sd": totals.sd(2), "n": F.col("n")})
        .withColumn("se", round_even(F.col("sd") / F.sqrt(F.col("n")), 4))
        .withColumn("CV", round_even(ratio("sd", mean), 2))
        .withColumn("RSE", round_even(ratio("se", mean), 2))
    )


def coverage(df: DataFrame, by: Sequence[str], year: str = "year") -> DataFrame:
    """First year, last year and number of years per group."""
    return df.groupBy(*by).agg(
        strict_min(year).alias("min_year"),
        strict_max(year).alias("max_year"),
        distinct_with_null(year).alias("no_of_years"),
    )


def effort_span(df: DataFrame, by: Sequence[str], year: str = "year") -> DataFrame:
    """Rows, first and last year per group."""
    return df.groupBy(*by).agg(
        row_count().alias("n"),
        strict_min(year).alias("min_yr"),
        strict_max(year).alias("max_yr"),
    )
