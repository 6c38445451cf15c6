"""The same summary at several levels of detail, in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.operators import totals


def by_levels(
    df: DataFrame,
    keys: Sequence[str],
    combined: Mapping[str, str],
    levels: Mapping[str, Sequence[str]],
    measures: Mapping[str, Column],
    label: str = "description",
) -> DataFrame:
    """Aggregate once per level and stack the levels.

    ``keys`` are kept at every level. ``combined`` maps each column that may be
    rolled up to the text that stands for it where it is. ``levels`` maps the
    level's label to the rolled columns it keeps. A missing value stays a group of
    its own: it is told from a rolled-up column by ``grouping()``, not by NULL.
    """
    rolled = list(combined)
    sets = [[*keys, *kept] for kept in levels.values()]
    grouped = df.groupingSets(sets, *keys, *rolled).agg(
        *[m.alias(name) for name, m in measures.items()],
        *[F.grouping(c).alias(f"_up_{c}") for c in rolled],
    )
    name = None
    for text, kept in levels.items():
        hit = F.lit(True)
        for c in rolled:
            hit = hit & (F.col(f"_up_{c}") == F.lit(0 if c in kept else 1))
        name = F.when(hit, F.lit(text)) if name is None else name.when(hit, F.lit(text))
    shown = {
        c: F.when(F.col(f"_up_{c}") == 1, F.lit(combined[c])).otherwise(F.col(c)) for c in rolled
    }
    return grouped.select(
        name.alias(label),
        *keys,
        *[shown[c].alias(c) for c in rolled],
        *measures,
    )


def count_rows(df: DataFrame, cols: Sequence[str], count: str = "n") -> DataFrame:
    """Row counts at the finest grain, for the levels to add up.

    Counting first collapses hot groups on the map side, and the levels then
    multiply this small table instead of the rows.
    """
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count))


def mean_sd_by_levels(
    df: DataFrame,
    measure: str,
    keys: Sequence[str],
    combined: Mapping[str, str],
    levels: Mapping[str, Sequence[str]],
    digits: int = 1,
    label: str = "description",
) -> DataFrame:
    """Strict mean, standard deviation and row count of ``measure`` per level.

    Exact sums are taken once at the finest grain; the levels add those up. A
    combined level therefore describes its rows, not the means of its parts, and the
    rows themselves are never multiplied by the levels.
    """
    fine = totals.exact_parts(df, [*keys, *combined], measure, spread=True)
    parts = by_levels(fine, [*keys, "_class"], combined, levels, totals.part_sums(fine), label)
    summary = {f"mean_{measure}": totals.mean(digits, True), f"sd_{measure}": totals.sd(digits, True), "n": totals.rows()}
    return totals.exact_totals(parts, [label, *keys, *combined], **summary)
