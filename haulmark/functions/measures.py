"""Numeric rules: units, clamps, bins, effort standardization, rounding."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.categories import by_range
from haulmark.functions.nulls import as_col

# They decide the published numbers and must not change.
POUNDS_TO_TONNES = 0.000453592
FATHOM_TO_METER = 1.8288
INCH_TO_METER = 0.0254
INCHES_PER_METER = 39.37
HOOK_SCALE = 2.2
HOOK_DECAY = -0.57
ONE_HOUR_SOAK_FACTOR = 1.43
LAST_ONE_HOUR_SOAK_YEAR = 1996
SPACING_INCHES_BY_YEAR = [(None, 1996, 118), (1997, 1997, 72), (1998, 1999, 64), (2000, None, 78)]
DEPTH_STRATA_METERS = [(201, 300, 3), (301, 400, 4), (401, 600, 5), (601, 800, 6), (801, 1000, 7)]
LENGTH_BIN_FIRST_BREAK = "39.9"
LENGTH_BIN_WIDTH = "2"
LENGTH_BINS = [str(center) for center in range(41, 100, 2)]


def pounds_to_tonnes(c: str | Column) -> Column:
    return as_col(c) * F.lit(POUNDS_TO_TONNES)


def millimeters_to_centimeters(c: str | Column) -> Column:
    return as_col(c) / F.lit(10)


def fathoms_to_meters(c: str | Column) -> Column:
    return as_col(c) * F.lit(FATHOM_TO_METER)


def survey_inches_to_meters(c: str | Column) -> Column:
    return as_col(c) * F.lit(INCH_TO_METER)


def fishery_inches_to_meters(c: str | Column) -> Column:
    """The fishery series divides by 39.37, which is not quite the survey factor."""
    return as_col(c) / F.lit(INCHES_PER_METER)


def round_even(c: str | Column, digits: int) -> Column:
    return F.bround(as_col(c), digits)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient; a zero denominator gives NULL instead of an error."""
    return F.try_divide(as_col(numerator), as_col(denominator))


def plus_group(c: str | Column, at: int) -> Column:
    c = as_col(c)
    return F.when(c >= at, F.lit(at)).otherwise(c)


def clamp(c: str | Column, low: float, high: float) -> Column:
    c = as_col(c)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def bin_right_closed(
    c: str | Column, first_break: str, width: str, labels: Sequence[str], digits: int = 6
) -> Column:
    """Label of the bin ``(first_break + k*width, first_break + (k+1)*width]``.

    Breaks are decimal text. Values are compared as whole multiples of
    ``10**-digits``, so an edge such as 41.9 falls left, as its decimal text says.
    Values outside every bin give NULL.
    """
    unit = Decimal(10) ** digits
    start, step = int(Decimal(first_break) * unit), int(Decimal(width) * unit)
    scaled = F.rint(as_col(c).cast("double") * F.lit(float(unit))).cast("bigint")
    position = F.ceil((scaled - F.lit(start)) / F.lit(step)).cast("int")
    names = F.array(*[F.lit(label) for label in labels])
    return F.when(position.between(1, len(labels)), F.element_at(names, position))


def length_bin(c: str | Column) -> Column:
    """Two-centimeter bin center of a fork length, ends lumped into 41 and 99."""
    return bin_right_closed(
        clamp(as_col(c).cast("double"), 41.0, 99.0),
        LENGTH_BIN_FIRST_BREAK,
        LENGTH_BIN_WIDTH,
        LENGTH_BINS,
    )


def standard_hooks(hooks: str | Column, spacing_meters: Column) -> Column:
    """Effective hooks for a hook spacing (Sigler and Lunsford 2001)."""
    saturation = F.lit(1.0) - F.exp(F.lit(HOOK_DECAY) * spacing_meters)
    return F.lit(HOOK_SCALE) * as_col(hooks) * saturation


def spacing_by_year(year: str | Column) -> Column:
    """Hook spacing in inches for the survey era of ``year``."""
    return by_range(year, SPACING_INCHES_BY_YEAR)


def soak_adjusted(catch: str | Column, year: str | Column) -> Column:
    """Catch raised for the years with one-hour soaks; NULL year gives NULL."""
    catch, year = as_col(catch), as_col(year)
    early = year <= LAST_ONE_HOUR_SOAK_YEAR
    return F.when(early, F.lit(ONE_HOUR_SOAK_FACTOR) * catch).when(~early, catch)


def depth_stratum(depth_meters: str | Column) -> Column:
    return by_range(depth_meters, DEPTH_STRATA_METERS)
