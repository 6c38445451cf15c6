"""Lookup joins.

Spark decides by size whether a lookup is broadcast: from file statistics before the run,
from shuffle statistics during it. Give lookups as they are stored, one join each: of a
lookup that is itself joined Spark has no estimate before the run. A larger lookup gets a
sort-merge join, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_matches_null: bool = True,
    unique: bool = False,
) -> DataFrame:
    """Join ``lookup`` by equal names; a missing key matches a missing key.

    ``<=>`` still runs as a hash or merge join. The lookup's key columns are dropped. With
    ``unique`` the lookup carries the number of its rows with each key, and a row that would be
    multiplied is an error; keys that nothing matches may be doubled.
    """
    if unique:
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        joined = lookup_join(left, lookup.withColumn("_lk_same", same), keys, how, null_matches_null)
        # names columns of both sides, so it is not tested on the lookup alone
        shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
        clash = F.raise_error(F.concat(F.lit(f"several rows for {', '.join(keys)} = "), shown)).cast("boolean")
        return joined.filter(F.when(F.col("_lk_same") > 1, clash).otherwise(True)).drop("_lk_same")
    if not null_matches_null:
        return left.join(lookup, list(keys), how)
    renamed = lookup.withColumnsRenamed({k: f"_lk_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_lk_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_lk_{k}" for k in keys])


def override_from(
    df: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    target: str,
    update: str,
    unique: bool = False,
) -> DataFrame:
    """Replace ``target`` by ``update`` where the update table has a value."""
    new = updates.select(*keys, update)
    joined = lookup_join(df, new, keys, "left", unique=unique)
    return joined.withColumn(target, F.coalesce(F.col(update), F.col(target))).drop(update)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count.

    A lookup with such keys multiplies the rows it is joined to.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
