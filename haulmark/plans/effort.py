"""Effort pipelines: extracts, standardized rates and their indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.dates import day_of_year, hours_between, utc_date
from haulmark.functions.measures import (
    fathoms_to_meters,
    fishery_inches_to_meters,
    ratio,
    round_even,
    soak_adjusted,
    spacing_by_year,
    standard_hooks,
    survey_inches_to_meters,
)
from haulmark.functions.nulls import null_to
from haulmark.functions.text import digits_to_number, prefixed_label
from haulmark.operators import totals
from haulmark.operators.joins import lookup_join
from haulmark.operators.rows import below_global_max, stack, without_newest
from haulmark.operators.stats import rate_summary
from haulmark.sources.readers import inline_series, scan
from haulmark.sources.schemas import LOGBOOK_SETS, SURVEY_HOOKS

# Codes, labels and legacy rates of the published indices.
INVALID_CONDITION = "02"
FIRST_INDEX_YEAR = 1997
SURVEY_PROJECTS = ["603", "03", "601", "01"]
LOGBOOK_AREAS = ["NSEI", "SSEI"]
SURVEY_COLUMNS = {
    "stat": "g_stat_area",
    "start_lat": "start_latitude_decimal_degrees",
    "start_lon": "start_longitude_decimal_degree",
    "end_lat": "end_latitude_decimal_degrees",
    "end_lon": "end_longitude_decimal_degrees",
}
SURVEY_LABEL = "ADFG_LLsrv_NPUE_"
FISHERY_LABEL = "ADFG_LLfishery_WPUE_"
LEGACY_WPUE = {
    "NSEI": (1980, [0.719, 0.980, 1.240, 1.521, 1.304, 1.880, 1.581, 1.704, 1.579, 1.156, 1.402,
                    1.267, 1.468, 1.587, 0.993, 0.838, 0.730]),
    "SSEI": (1985, [0.232, 0.280, 0.185, 0.228, 0.242, 0.248, 0.211, 0.269, 0.219, 0.210, 0.227,
                    0.171]),
}


def survey_scan(store: DataFrame) -> DataFrame:
    """Survey sets of the two sablefish surveys under the short position names."""
    wanted = F.col("project_code").isin(SURVEY_PROJECTS)
    kept = [f.name for f in SURVEY_HOOKS if f.name not in SURVEY_COLUMNS]
    return scan(store, {**{name: name for name in kept}, **SURVEY_COLUMNS}, wanted)


def survey_effort(hooks: DataFrame, stat_sizes: DataFrame, with_newest: bool = False) -> DataFrame:
    """Survey sets under the common names, with area and size of their stat area.

    The newest year holds dummy rows and is dropped, which takes a second pass over the
    year; the indices take the sets with it and drop it from their groups. Sets whose stat
    area is unknown keep NULL area and size.
    """
    scanned = hooks.filter(F.col("project_code").isin(SURVEY_PROJECTS))
    day = utc_date(hooks, "time_first_buoy_onboard")
    kept = (scanned if with_newest else below_global_max(scanned, "year")).select(
        "year",
        F.col("project_code").alias("Project_cde"),
        F.col("station_no").alias("Station_no"),
        "trip_no",
        F.col("adfg_no").alias("Adfg"),
        F.col("vessel_name").alias("Vessel"),
        day.alias("date"),
        day_of_year(day).alias("julian_day"),
        F.col("stat").alias("Stat"),
        F.col("effort_no").alias("set"),
        "start_lat",
        "start_lon",
        "end_lat",
        "end_lon",
        fathoms_to_meters("avg_depth_fathoms").alias("depth"),
        F.col("number_hooks").alias("no_hooks"),
        F.col("bare").alias("hooks_bare"),
        F.col("bait").alias("hooks_bait"),
        F.col("invalid").alias("hook_invalid"),
        F.col("sablefish").alias("hooks_sablefish"),
        F.col("subset_condition_code").alias("subset_condition_cde"),
    )
    sizes = stat_sizes.select(F.col("Stat").cast("string").alias("Stat"), "Mgmt_area", "stat_km2")
    return lookup_join(kept, sizes, ["Stat"], "left")


def logbook_scan(store: DataFrame, areas: Sequence[str] | None = LOGBOOK_AREAS) -> DataFrame:
    """The columns used of the logbook sets of some areas."""
    kept = [name for name in LOGBOOK_SETS.names if name in store.columns]
    return scan(store, kept, None if areas is None else F.col("g_management_area_code").isin(list(areas)))


def logbook_effort(sets: DataFrame, areas: Sequence[str] | None = LOGBOOK_AREAS) -> DataFrame:
    """Logbook sets under the common names, with soak hours and numeric hook size."""
    day = utc_date(sets, "time_set")
    return logbook_scan(sets, areas).select(
        "year",
        F.col("g_management_area_code").alias("Mgmt_area"),
        "trip_no",
        F.col("adfg_no").alias("Adfg"),
        F.col("trip_target").alias("Spp_cde"),
        day.alias("date"),
        day_of_year(day).alias("julian_day"),
        hours_between("time_set", "time_hauled").alias("soak"),
        F.col("longline_system_code").alias("Gear"),
        F.col("hook_size").alias("Hook_size"),
        digits_to_number("hook_size").alias("Size"),
        F.col("hook_spacing").alias("hook_space"),
        F.col("g_stat_area").alias("Stat"),
        F.col("number_of_hooks").alias("no_hooks"),
        F.col("average_depth_meters").alias("depth"),
        F.col("effort_no").alias("sets"),
        F.col("sable_lbs_per_set").alias("sable_lbs_set"),
        F.col("start_latitude_decimal_degrees").alias("start_lat"),
        F.col("start_longitude_decimal_degree").alias("start_lon"),
    )


def valid_set() -> Column:
    """Sets of unknown condition are left out with the invalid ones."""
    return F.coalesce(F.col("subset_condition_cde") != INVALID_CONDITION, F.lit(False))


def survey_rates(effort: DataFrame, every_set: bool = False) -> DataFrame:
    """Valid survey sets, or every set, with standardized hooks and catch per hook.

    Each column builds on the ones before it.
    """
    return (
        (effort if every_set else effort.filter(valid_set()))
        .withColumn("hooks_bare", null_to("hooks_bare", 0))
        .withColumn("hooks_bait", null_to("hooks_bait", 0))
        .withColumn("hook_invalid", null_to("hook_invalid", 0))
        .withColumn("no_hooks", F.col("no_hooks") - F.col("hook_invalid"))
        .withColumn(
            "std_hooks",
            standard_hooks("no_hooks", survey_inches_to_meters(spacing_by_year("year"))),
        )
        .withColumn("sablefish_retained", null_to("hooks_sablefish", 0))
        .withColumn("std_cpue", ratio(soak_adjusted("sablefish_retained", "year"), "std_hooks"))
    )


def fishery_rates(effort: DataFrame) -> DataFrame:
    """Logbook sets with standardized hooks and pounds per hook."""
    spacing = fishery_inches_to_meters("hook_space")
    return effort.withColumn("std_hooks", standard_hooks("no_hooks", spacing)).withColumn(
        "std_cpue", ratio("sable_lbs_set", "std_hooks")
    )


def _index(summary: DataFrame, value: str, label: str) -> DataFrame:
    """Published layout. The CV column carries the relative standard error."""
    return summary.select(
        F.col("year").alias("Year"),
        F.col(value).alias("Value"),
        F.col("RSE").alias("CV"),
        prefixed_label(label, "Mgmt_area").alias("description"),
    )


def survey_npue_index(
    effort: DataFrame, first_year: int = FIRST_INDEX_YEAR, label: str = SURVEY_LABEL
) -> DataFrame:
    """Fish per standardized hook by year and area, from ``first_year`` on."""
    rates = survey_rates(effort).filter(F.col("year") >= first_year)
    return _index(rate_summary(rates, "std_cpue", ["year", "Mgmt_area"], "NPUE"), "NPUE", label)


def survey_npue_of_hooks(
    hooks: DataFrame, stat_sizes: DataFrame, first_year: int = FIRST_INDEX_YEAR, label: str = SURVEY_LABEL
) -> DataFrame:
    """The survey index from the raw sets, read once: the newest year goes from the groups."""
    rates = survey_rates(survey_effort(hooks, stat_sizes, with_newest=True), every_set=True)
    summary = rate_summary(rates, "std_cpue", ["year", "Mgmt_area"], "NPUE", valid_set())
    kept = without_newest(summary, "year").filter((F.col("n") > 0) & (F.col("year") >= first_year))
    return _index(kept, "NPUE", label)


def legacy_wpue(spark: SparkSession, legacy: dict[str, tuple[int, list[float]]] = LEGACY_WPUE) -> DataFrame:
    """Published rates from before the logbook."""
    return stack(
        [
            inline_series(spark, {"Mgmt_area": area}, first, values, "WPUE")
            for area, (first, values) in legacy.items()
        ]
    )


def fishery_wpue_index(
    effort: DataFrame, legacy: DataFrame | None = None, label: str = FISHERY_LABEL
) -> DataFrame:
    """Pounds per standardized hook by year and area, legacy rows first, without CV."""
    legacy = legacy_wpue(effort.sparkSession) if legacy is None else legacy
    modern = rate_summary(fishery_rates(effort), "std_cpue", ["year", "Mgmt_area"], "WPUE")
    return _index(stack([legacy, modern]), "WPUE", label)


def cpue_indices(survey: DataFrame, fishery: DataFrame) -> DataFrame:
    return stack([survey, fishery])


def rpn_index(
    rates: DataFrame,
    sizes: DataFrame,
    stratum: str = "Stat",
    size: str = "stat_km2",
    names: tuple[str, str] = ("RPN", "NPUE"),
    counted: Column | None = None,
    newest_is_dummy: bool = False,
) -> DataFrame:
    """Relative population number: catch rates weighted by the size of their stratum.

    Give weight rates and names for the relative population weight, or a depth stratum
    for totals over depth. One pass over the sets: exact sums and counts per stratum serve
    both the weighted total and the overall rate. A stratum of unknown size makes its
    total NULL. Sets that are not ``counted`` make no stratum, only a year; with
    ``newest_is_dummy`` the newest of all years is left out.
    """
    counted = F.lit(True) if counted is None else counted
    group = ["year", "Mgmt_area"]
    named = rates.withColumn("_stratum", F.col(stratum).cast("string"))
    parts = totals.exact_parts(named, [*group, "_stratum"], F.when(counted, F.col("std_cpue")), counts={"_sets": counted})
    per_stratum = totals.exact_totals(parts, [*group, "_stratum"], ["_sets"], _rate=totals.mean(2), _sets=F.col("_sets"))
    area = sizes.select(F.col(stratum).cast("string").alias("_stratum"), F.col(size).alias("_size"))
    weighted = lookup_join(per_stratum.filter("_sets > 0"), area.distinct(), ["_stratum"], "left")
    total = totals.exact_parts(weighted, group, F.col("_rate") * F.col("_size"))
    total = totals.exact_totals(total, group, **{names[0]: totals.round_to_even(totals.total(True), 2)})
    overall = totals.exact_totals(parts, group, ["_sets"], **{names[1]: totals.mean(2), "_sets": F.col("_sets")})
    index = lookup_join(overall, total, group, "left").select(*group, *names, "_sets")
    if newest_is_dummy:
        index = without_newest(index, "year")
    return index.filter("_sets > 0").drop("_sets")


def rpn_of_hooks(hooks: DataFrame, stat_sizes: DataFrame) -> DataFrame:
    """The population index from the raw sets, read once: the newest year goes from the groups."""
    rates = survey_rates(survey_effort(hooks, stat_sizes, with_newest=True), every_set=True)
    return rpn_index(rates, stat_sizes, counted=valid_set(), newest_is_dummy=True)
