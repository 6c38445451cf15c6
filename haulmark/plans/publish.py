"""Jobs: from source tables to the published files.

Each job writes a shared intermediate once, as Parquet below its ``work`` folder, and goes
on from the written table, so no upstream step runs again for the next output and a lost
executor costs no more than the current step. ``work`` must be storage that all executors
share. Published tables are written first and named by what was written; they are sorted at
the sink only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.operators.rows import order_by_levels, order_nulls_last
from haulmark.operators.series import SpliceRule
from haulmark.plans import biology, effort, landings
from haulmark.sources.writers import write_and_keep, write_csv, write_spanned_csv


def refresh_catch(
    earnings: DataFrame,
    stat_areas: DataFrame,
    updates: DataFrame,
    store: str,
    years: Sequence[int],
    species: str = landings.SPECIES,
) -> DataFrame:
    """The catch grid of all stored years, after the landings of ``years`` alone were added up anew.

    ``store`` keeps exact sums per stat area, year and gear code as Parquet, a directory a year.
    The sums of ``years`` replace what is stored for them, other years are not touched, and the
    grid is made of sums, so it equals that of a full run to the last digit. A year that has
    lost all its landings keeps the sums it had. Landings keep their years as the store does.
    """
    scanned = landings.earnings_scan(earnings, species)
    year = scanned.schema["year"].dataType
    changed = scanned.filter(F.col("year").isin([F.lit(y).cast(year) for y in years]))
    parts = landings.catch_parts(changed)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(store)
    kept = earnings.sparkSession.read.schema(parts.schema).parquet(store)
    lookup = landings.resolved_stat_areas(stat_areas, updates, unique=True)
    return landings.catch_of_parts(kept, lookup, unique=True)


def publish_catch(
    tickets: DataFrame,
    earnings: DataFrame,
    stat_areas: DataFrame,
    updates: DataFrame,
    historical: DataFrame,
    out: str,
    run_year: int,
    work: str,
    compared_areas: Sequence[str] = ("NSEI", "SSEI"),
    areas: Mapping[str, Sequence[str]] = landings.AREA_DISTRICTS,
    gears: Mapping[str, Sequence[str]] = landings.GEAR_CODES,
    rules: Sequence[SpliceRule] = landings.BEST_SERIES,
    species: str = landings.SPECIES,
    ticket_areas: Sequence[str] = landings.TICKET_AREAS,
) -> dict[str, str]:
    """Write landings, the catch grid, the source comparison and the best series.

    Only ``species`` is published, and tickets of ``ticket_areas``. Landings of a stat area
    that is held twice, or has two corrections, are an error.
    """
    written: dict[str, str] = {}
    scanned = landings.ticket_scan(tickets, species, ticket_areas)
    cleaned = write_and_keep(landings.clean_tickets(scanned), f"{work}/tickets")
    written["tickets"] = write_spanned_csv(cleaned, f"{out}/ticket_landings")
    landed = write_and_keep(landings.earnings_scan(earnings, species), f"{work}/earnings")
    lookup = write_and_keep(landings.resolved_stat_areas(stat_areas, updates, unique=True), f"{work}/stat_areas")
    placed = write_and_keep(landings.landings_with_areas(landed, lookup, unique=True), f"{work}/landings")
    written["landings"] = write_spanned_csv(placed, f"{out}/landings_with_areas")
    grid = write_and_keep(
        landings.catch_by_year_area_gear(landed, lookup, areas=areas, gears=gears, unique=True), f"{work}/catch_grid"
    )
    levels = {"Mgmt_area": list(areas), "gear": list(gears)}
    written["grid"] = write_spanned_csv(
        order_by_levels(grid, levels, ["year", "Mgmt_area", "gear"]), f"{out}/catch_by_year_area_gear"
    )
    by_area = landings.catch_by_year_area(grid)
    sources = {
        landings.HISTORICAL: historical,
        landings.EARNINGS: by_area,
        landings.TICKETS: landings.ticket_catch(cleaned),
    }
    shown = {**sources, landings.EARNINGS: by_area.filter(F.col("Mgmt_area").isin(list(compared_areas)))}
    order = ["Mgmt_area", "year", "data_source"]
    comparison = write_and_keep(landings.compare_sources(shown), f"{work}/comparison")
    written["comparison"] = write_spanned_csv(order_nulls_last(comparison, *order), f"{out}/catch_comparison")
    best = order_nulls_last(landings.best_series(sources, rules), *order)
    written["best"] = write_csv(best, f"{out}/best_catch_{run_year}")
    return written


def publish_biology(extracts: Mapping[str, DataFrame], out: str, work: str) -> dict[str, str]:
    """Write each specimen extract, its coverage and the five summaries."""
    kept = {}
    written = {}
    for name, extract in extracts.items():
        kept[name] = write_and_keep(extract, f"{work}/{name}")
        written[name] = write_spanned_csv(kept[name], f"{out}/detailed_{name}")
    bio = biology.stack_bio(*kept.values())
    written["coverage"] = write_csv(
        order_nulls_last(biology.bio_coverage(bio), "Gear", "Source", "Mgmt_area"), f"{out}/coverage"
    )
    keys = ["description", "Source", "Gear", "Mgmt_area", "Sex", "year"]
    by_gear = ["description", "Gear", "Source", "Mgmt_area", "Sex", "year", "age"]
    summaries = {
        "agecomps": (biology.age_composition(bio), [*keys, "age"]),
        "lengthcomps": (biology.length_composition(bio), [*keys, "length_bin"]),
        "proportionmature": (biology.proportion_mature(bio), [*keys, "age"]),
        "lengthage": (biology.length_at_age(bio), by_gear),
        "weightage": (biology.weight_at_age(bio), by_gear),
    }
    for name, (summary, order) in summaries.items():
        written[name] = write_csv(order_nulls_last(summary, *order), f"{out}/{name}")
    return written


def publish_effort(
    hooks: DataFrame, stat_sizes: DataFrame, logbook: DataFrame, out: str, work: str
) -> dict[str, str]:
    """Write both effort extracts and the stacked indices."""
    survey = write_and_keep(effort.survey_effort(hooks, stat_sizes), f"{work}/survey_effort")
    fishery = write_and_keep(effort.logbook_effort(logbook), f"{work}/fishery_effort")
    indices = effort.cpue_indices(
        effort.survey_npue_index(survey), effort.fishery_wpue_index(fishery)
    )
    return {
        "survey": write_spanned_csv(survey, f"{out}/survey_effort"),
        "fishery": write_spanned_csv(fishery, f"{out}/fishery_effort"),
        "indices": write_csv(order_nulls_last(indices, "description", "Year"), f"{out}/cpue_indices"),
    }
