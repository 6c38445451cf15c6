"""Completing category grids.

``complete`` is meant for aggregated frames with one row per cell, so a key tuple
holds at most one row per combination of the inner levels. The missing cells are added
inside the partition of each key tuple, without joining the frame to itself. Levels are
declared lists, or frames of the values present, which may be of any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Levels = Sequence | DataFrame

#: Levels of a bucket, about: there are as many buckets as the levels ask for.
BUCKET_LEVELS = 1024


def present_levels(df: DataFrame, c: str, count: str | None = None) -> DataFrame:
    """The distinct values of ``c``, NULL included.

    With ``count``, the values whose total count is positive. The count is read either way
    where it is given, so that an aggregate below is computed once for rows and levels.
    """
    if count is None:
        return df.select(c).distinct()
    return df.groupBy(c).agg(F.sum(count).alias("_n")).filter(F.col("_n") > 0).select(c)


def complete(
    df: DataFrame, within: Sequence[str], levels: Mapping[str, Levels], fill: Mapping[str, object] | None = None
) -> DataFrame:
    """Give every existing ``within`` tuple a row for each combination of ``levels``.

    ``levels`` maps an inner column to its values: a list, or a frame such as
    ``present_levels``. Added rows are NULL outside ``within`` and ``levels``; the
    measures in ``fill`` get their fill value wherever they are NULL. Rows whose
    values are not among the levels are kept. Missing keys count as values.
    """
    types = {f.name: f.dataType for f in df.schema}
    if within:
        first = F.row_number().over(Window.partitionBy(*within).orderBy(*levels)) == 1
        copies = F.when(F.col("_first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        rows = df.withColumn("_first", first).withColumn("_blank", F.explode(copies)).drop("_first")
    else:
        empty = [F.lit(None).cast(t).alias(c) for c, t in types.items()]
        blank = df.sparkSession.range(1).select(*empty, F.lit(True).alias("_blank"))
        rows = df.withColumn("_blank", F.lit(False)).unionByName(blank)
    for c, given in levels.items():
        if isinstance(given, DataFrame):
            rows = _met(rows, c, given.select(F.col(c).cast(types[c]).alias("_level")))
        else:
            values = F.array(*[F.lit(v) for v in dict.fromkeys(given)]).cast(f"array<{types[c].simpleString()}>")
            rows = rows.withColumn(c, F.explode(F.when(F.col("_blank"), values).otherwise(F.array(F.col(c)))))
    cell = Window.partitionBy(*within, *levels)
    kept = rows.withColumn("_filled", F.min("_blank").over(cell)).filter(F.col("_blank") == F.col("_filled"))
    out = []
    for c in df.columns:
        value = F.col(c) if c in within or c in levels else F.when(~F.col("_blank"), F.col(c))
        if fill and c in fill:
            value = F.coalesce(value, F.lit(fill[c]))
        out.append(value.alias(c))
    return kept.select(*out)


def _met(rows: DataFrame, c: str, levels: DataFrame) -> DataFrame:
    """Blank rows once for each level, by an equal join on buckets; other rows as they are.

    The number of buckets is a scalar of the levels, rounded up to a power of two; a blank row
    goes to all of them. Few levels are one bucket, which Spark may broadcast.
    """
    distinct = levels.distinct()
    asked = F.greatest(distinct.agg(F.count(F.lit(1))).scalar() / F.lit(BUCKET_LEVELS), F.lit(1.0))
    # never NULL, as _bits
    last = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2(asked))).cast("bigint") - F.lit(1), F.lit(0).cast("bigint"))
    level = distinct.select("_level", F.xxhash64("_level").bitwiseAND(last).alias("_bucket"), F.lit(True).alias("_given"))
    # rows that are not blank have buckets of their own, which spreads them and meets no level
    own = F.array(-1 - _bits(F.xxhash64(*rows.columns), 1 << 20))
    every = F.sequence(F.lit(0).cast("bigint"), last)
    dealt = rows.withColumn("_bucket", F.explode(F.when(F.col("_blank"), every).otherwise(own)))
    return (
        dealt.join(level, "_bucket", "left")
        .filter(~F.col("_blank") | F.col("_given"))
        .withColumn(c, F.when(F.col("_blank"), F.col("_level")).otherwise(F.col(c)))
        .drop("_bucket", "_level", "_given")
    )


def _bits(c: Column, n: int) -> Column:
    """The remainder by a power of two, which is never NULL, so that no filter is derived from it."""
    return c.bitwiseAND(F.lit(n - 1).cast("bigint"))


def complete_global(
    df: DataFrame,
    cols: Sequence[str],
    levels: Mapping[str, Sequence] | None = None,
    fill: Mapping[str, object] | None = None,
    count: str | None = None,
) -> DataFrame:
    """Every combination of the values of ``cols``, whatever occurs together.

    Declared columns use their levels, the others their distinct values; with ``count``
    those that are counted at least once.
    """
    levels = levels or {}
    undeclared = [c for c in cols if c not in levels]
    inner: dict[str, Levels] = {c: levels[c] for c in cols if c in levels}
    inner |= {c: present_levels(df, c, count) for c in undeclared[1:]}
    return complete(df, undeclared[:1], inner, fill)
