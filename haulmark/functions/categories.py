"""Codes to labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.nulls import as_col


def derive_category(conditions: Mapping[str, Column], default: str | None = None) -> Column:
    """Label of the condition that holds; ``default`` (NULL) when none does."""
    out = None
    for label, condition in conditions.items():
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default).cast("string"))


def map_codes(
    c: str | Column, codes: Mapping[str, Sequence], default: str | None = None
) -> Column:
    """Label whose code list contains ``c``.

    Long code lists stay cheap: Spark turns them into a hash-set probe per label.
    """
    c = as_col(c)
    return derive_category({label: c.isin(list(v)) for label, v in codes.items()}, default)


def by_range(
    c: str | Column, ranges: Sequence[tuple[float | None, float | None, object]]
) -> Column:
    """Value of the closed range ``(low, high, value)`` that holds ``c``.

    ``None`` leaves a side open; NULL or uncovered ``c`` gives NULL.
    """
    c = as_col(c)
    out = None
    for low, high, value in ranges:
        hit = c.isNotNull()
        if low is not None:
            hit = hit & (c >= F.lit(low))
        if high is not None:
            hit = hit & (c <= F.lit(high))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out
