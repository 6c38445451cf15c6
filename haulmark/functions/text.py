"""Text to numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.nulls import as_col


def digits_to_number(c: str | Column) -> Column:
    """The digits of a text as a number; NULL when it has none."""
    return F.regexp_replace(as_col(c), "[^0-9]", "").try_cast("double")


def whole_number(c: str | Column) -> Column:
    """A number written as text, ``2e3`` included, as an int; NULL when it is none."""
    return as_col(c).try_cast("double").try_cast("int")


def prefixed_label(prefix: str, c: str | Column) -> Column:
    """``prefix`` followed by the value, with a missing value spelled NA."""
    return F.concat(F.lit(prefix), F.coalesce(as_col(c).cast("string"), F.lit("NA")))


def blank_to_null(c: str | Column, *tokens: str) -> Column:
    """NULL for an empty text and for each of the given stand-ins."""
    c = as_col(c)
    return F.when(~c.isin("", *tokens), c)
