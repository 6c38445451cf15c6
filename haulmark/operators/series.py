"""Annual series: comparing, splicing, filling and labelling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.operators.joins import lookup_join


@dataclass(frozen=True)
class SpliceRule:
    """Rows to take: an area and one source, optionally a closed year range."""

    area: str
    source: str
    first_year: int | None = None
    last_year: int | None = None

    def condition(self, area: str, source: str, year: str) -> Column:
        hit = (F.col(area) == self.area) & (F.col(source) == self.source)
        if self.first_year is not None:
            hit = hit & (F.col(year) >= self.first_year)
        if self.last_year is not None:
            hit = hit & (F.col(year) <= self.last_year)
        return hit


def splice(
    series: DataFrame,
    rules: Sequence[SpliceRule],
    area: str = "Mgmt_area",
    source: str = "data_source",
    year: str = "year",
) -> DataFrame:
    """One best series: the rows any rule takes."""
    return series.filter(reduce(lambda a, b: a | b, [r.condition(area, source, year) for r in rules]))


#: Stretches that the range of ``x`` is cut into; a series may use as many tasks.
STRETCHES = 256


def interpolate_gaps(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Fill NULL ``y`` on the straight line between its known neighbours in ``x``.

    Gaps at either end of a series stay NULL, and so does ``y`` where ``x`` is. The range of
    ``x`` is cut into stretches. Windows run per series and stretch, so a long series is
    spread over tasks; a small table of the first and last known point of every stretch says
    what neighbours the others give.
    """
    place = F.col(x).cast("double")
    span = df.agg(F.struct(F.min(place).alias("low"), F.max(place).alias("high"))).scalar()
    share = F.try_divide(place - span["low"], span["high"] - span["low"])
    stretch = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(float(STRETCHES))), F.lit(STRETCHES - 1)).cast("int")
    known = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    rows = df.withColumns({"_stretch": stretch, "_known": known})
    key = [*by, "_stretch"]
    ends = rows.groupBy(*key).agg(F.min("_known").alias("_first"), F.max("_known").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    outer = ends.select(
        *key,
        F.last("_last", ignorenulls=True).over(earlier).alias("_before"),
        F.last("_first", ignorenulls=True).over(later).alias("_after"),
    )
    upto = Window.partitionBy(*key).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    # the rows after, as a frame that grows row by row
    onward = Window.partitionBy(*key).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns(
        {"_p": F.last("_known", ignorenulls=True).over(upto), "_q": F.last("_known", ignorenulls=True).over(onward)}
    )
    met = lookup_join(near, outer, key, "left")
    p, q = F.coalesce("_p", "_before"), F.coalesce("_q", "_after")
    slope = (q["y"] - p["y"]) / (q["x"] - p["x"])
    line = F.when(q["x"] > p["x"], p["y"] + (F.col(x) - p["x"]) * slope)
    return met.withColumn(y, F.coalesce(F.col(y), line)).select(*df.columns)


def tick_labels(df: DataFrame, c: str, step: int) -> DataFrame:
    """Distinct values with a label on every ``step``-th one and ``""`` elsewhere.

    Ticks start at the smallest value rounded, half to even, to a multiple of ``step``. It is a
    scalar of the same distinct values, so that no task sees them all.
    """
    values = df.select(F.col(c).alias("breaks")).distinct()
    lowest = values.agg(F.min("breaks")).scalar()
    start = F.bround(lowest / F.lit(step), 0).cast("bigint") * F.lit(step)
    on_tick = (F.col("breaks") >= start) & ((F.col("breaks") - start) % F.lit(step) == 0)
    return values.select(
        "breaks", F.when(on_tick, F.col("breaks").cast("string")).otherwise(F.lit("")).alias("labels")
    )
