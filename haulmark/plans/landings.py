"""Catch pipelines: tickets, earnings landings, comparison and the spliced series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.categories import map_codes
from haulmark.functions.measures import pounds_to_tonnes
from haulmark.functions.nulls import zero_fallback
from haulmark.functions.text import whole_number
from haulmark.operators import totals
from haulmark.operators.grid import complete
from haulmark.operators.joins import lookup_join, override_from
from haulmark.operators.rows import stack, tagged
from haulmark.operators.series import SpliceRule, splice
from haulmark.sources.readers import scan
from haulmark.sources.schemas import TICKET_LANDINGS

# Store columns, area and gear groups of the published catch tables.
SPECIES = "710"
TICKET_AREAS = ["NSEI", "SSEI"]
TICKET_COLUMNS = TICKET_LANDINGS.names
EARNINGS_COLUMNS = {
    "year": "adfg_b_batch_year",
    "date_landed": "adfg_h_date_landed",
    "gear_code": "adfg_h_gear_code",
    "port_code": "adfg_h_port",
    "cfec_harvest_area": "cfec_harvest_area",
    "cfec_permit": "adfg_h_permit_fishery",
    "delivery_code": "adfg_i_delivery_code",
    "harvest_code": "adfg_i_harvest_code",
    "mgt_program_code": "adfg_h_mgt_program_id",
    "species_code": "adfg_i_species_code",
    "stat_area": "adfg_i_stat_area",
    "stat_area_type": "adfg_h_stat_area_type",
    "landing_status": "cfec_landing_status",
    "pounds": "adfg_i_pounds",
    "whole_pounds": "adfg_i_whole_pounds",
}
STAT_AREA_COLUMNS = {
    "stat_area": "stat_area",
    "stat_area_type": "database_type",
    "region": "region",
    "waters": "waters",
    "start_date": "start_date",
    "end_date": "end_date",
    "g_mgt_area_district": "g_mgt_area_district",
    "g_nmfs_area": "g_nmfs_area",
}
UPDATE_KEYS = ["stat_area", "start_date", "end_date"]
AREA_DISTRICTS = {
    "PWS": ["PWS", "PWSE", "PWSI", "PWSW"],
    "NSEI": ["NSEI"],
    "SSEI": ["SSEI"],
    "LOWCI": ["LOWCI"],
}
GEAR_CODES = {
    "HAL": ["61", "06"],
    "POT": ["91", "09"],
    "TRW": ["07", "47", "27", "17"],
    "JIG/TRL": ["26", "05", "25", "15"],
    "GNT": ["03", "04", "41"],
    "UNK": ["99"],
}
TICKET_GEARS = {
    "HAL": ["Longline-keel < 60 ft.", "Longline"],
    "POT": ["Pot"],
    "TRW": ["Beam Trawl"],
    "JIG/TRL": ["Power Troll", "Hand Line/Jig/Troll"],
    "UNK": ["Other/Unknown/Missing"],
}
STATE_WATERS = ["STATE"]
EARNINGS = "Gross Earnings File"
TICKETS = "IFDB (Region I fish ticket database)"
HISTORICAL = "Historical (Carlile et al. 2002)"
BEST_SERIES = [
    SpliceRule("NSEI", HISTORICAL, last_year=1984),
    SpliceRule("NSEI", EARNINGS, first_year=1985),
    SpliceRule("SSEI", EARNINGS),
    SpliceRule("PWS", EARNINGS),
]


def ticket_scan(
    store: DataFrame, species: str = SPECIES, areas: Sequence[str] = TICKET_AREAS
) -> DataFrame:
    wanted = (F.col("species_code") == species) & F.col("g_management_area_code").isin(list(areas))
    return scan(store, TICKET_COLUMNS, wanted)


def earnings_scan(store: DataFrame, species: str = SPECIES) -> DataFrame:
    """Landings of one species, under the store's column names or the short ones."""
    named = EARNINGS_COLUMNS["species_code"] in store.columns
    columns = EARNINGS_COLUMNS if named else list(EARNINGS_COLUMNS)
    return scan(store, columns, F.col(EARNINGS_COLUMNS["species_code"] if named else "species_code") == species)


def stat_area_scan(store: DataFrame) -> DataFrame:
    return scan(store, STAT_AREA_COLUMNS)


def unknown_waters(landings: DataFrame, stat_areas: DataFrame, districts: Sequence[str]) -> DataFrame:
    """The stat areas of some districts as they occur in the landings, for review.

    Only lookup columns are wanted, so the landings reduce to their keys before the join.
    """
    keys = ["stat_area", "stat_area_type"]
    wanted = stat_areas.filter(F.col("g_mgt_area_district").isin(list(districts)))
    shown = ["g_mgt_area_district", "stat_area", "waters", "start_date", "end_date"]
    return lookup_join(wanted, landings.select(*keys).distinct(), keys, "inner").select(*shown).distinct()


def clean_tickets(tickets: DataFrame) -> DataFrame:
    """Ticket landings with whole weight filled from landed weight where it is 0."""
    return tickets.withColumnRenamed("g_management_area_code", "Mgmt_area").withColumn(
        "round_pounds", zero_fallback("round_pounds", "pounds")
    )


def ticket_catch(cleaned: DataFrame) -> DataFrame:
    """Ticket landings by year and area."""
    return totals.exact_total(cleaned, ["year", "Mgmt_area"], "round_pounds", "whole_pounds", strictly=True)


def resolved_stat_areas(stat_areas: DataFrame, updates: DataFrame, unique: bool = False) -> DataFrame:
    """Stat-area lookup with its waters replaced where a correction exists.

    The correction depends on the lookup alone, so it is applied to the lookup and
    never to the landings.
    """
    return override_from(stat_areas, updates, UPDATE_KEYS, "waters", "updated_waters", unique)


def landings_with_areas(
    landings: DataFrame, stat_areas: DataFrame, updates: DataFrame | None = None, unique: bool = False
) -> DataFrame:
    """Every landing with its stat-area attributes, corrected where ``updates`` are given.

    Both lookups are joined as they are stored, so that Spark knows their size. With
    ``unique`` a landing whose stat area is held twice is an error instead of two rows.
    """
    dated = landings.withColumn("year", whole_number("year"))
    placed = lookup_join(dated, stat_areas, ["stat_area", "stat_area_type"], "inner", unique=unique)
    return placed if updates is None else override_from(placed, updates, UPDATE_KEYS, "waters", "updated_waters")


CATCH_PLACE = ["stat_area", "stat_area_type"]


def catch_parts(landings: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Exact sums of the weight per stat area, year and gear code, to be added up by ``catch_of_parts``.

    Landings are added up before any join, so what is shuffled does not grow with the
    landings and a hot stat area is collapsed on the map side.
    """
    if years is not None:
        landings = landings.filter(whole_number("year").between(*years))
    return totals.exact_parts(landings, [*CATCH_PLACE, "year", "gear_code"], zero_fallback("whole_pounds", "pounds"))


def catch_of_parts(
    parts: DataFrame,
    stat_areas: DataFrame,
    updates: DataFrame | None = None,
    areas: Mapping[str, Sequence[str]] = AREA_DISTRICTS,
    gears: Mapping[str, Sequence[str]] = GEAR_CODES,
    waters: Sequence[str] = STATE_WATERS,
    shown: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """State-water catch for every year, area and gear, zeros included.

    Codes are decoded on the sums, not on the rows. The lookup is corrected, if there are
    ``updates``, and filtered on its own, then joined to the sums. With ``shown`` only these
    areas are added up and filled; the others count for one thing, that a year has catch, so
    the rows are those of the whole grid. With ``unique`` catch of a stat area that the lookup
    holds twice is an error; without, it counts twice.
    """
    shown = list(areas) if shown is None else [a for a in areas if a in shown]
    districts = [d for codes in areas.values() for d in codes]
    resolved = stat_areas if updates is None else resolved_stat_areas(stat_areas, updates)
    wanted = (
        resolved
        .filter(F.col("g_mgt_area_district").isin(districts) & F.col("waters").isin(list(waters)))
        .select(
            *CATCH_PLACE, map_codes("g_mgt_area_district", {a: areas[a] for a in shown}).alias("Mgmt_area")
        )
    )
    named = {"year": whole_number("year"), "gear": F.when(F.col("Mgmt_area").isNotNull(), map_codes("gear_code", gears))}
    decoded = lookup_join(parts, wanted, CATCH_PLACE, "inner", unique=unique).withColumns(named).drop(*CATCH_PLACE, "gear_code")
    cell = ["year", "Mgmt_area", "gear"]
    catch = totals.exact_totals(totals.add_parts(decoded, cell), cell, whole_pounds=totals.total(strictly=True))
    grid = complete(catch, ["year"], {"Mgmt_area": shown, "gear": list(gears)}, {"whole_pounds": 0.0})
    return grid if len(shown) == len(areas) else grid.filter(F.col("Mgmt_area").isNotNull())


def catch_by_year_area_gear(
    landings: DataFrame,
    stat_areas: DataFrame,
    updates: DataFrame | None = None,
    areas: Mapping[str, Sequence[str]] = AREA_DISTRICTS,
    gears: Mapping[str, Sequence[str]] = GEAR_CODES,
    waters: Sequence[str] = STATE_WATERS,
    shown: Sequence[str] | None = None,
    years: tuple[int, int] | None = None,
    unique: bool = False,
) -> DataFrame:
    """The catch grid of landings, in whole or for the ``shown`` areas and a closed range of ``years``."""
    return catch_of_parts(catch_parts(landings, years), stat_areas, updates, areas, gears, waters, shown, unique)


def catch_by_year_area(grid: DataFrame) -> DataFrame:
    """The catch grid added up over gears."""
    return totals.exact_total(grid, ["year", "Mgmt_area"], "whole_pounds", "whole_pounds", strictly=True)


def in_tonnes(series: DataFrame) -> DataFrame:
    return series.select(
        "year", "Mgmt_area", pounds_to_tonnes("whole_pounds").alias("whole_mt"), "data_source"
    )


def compare_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Yearly catch in tonnes of several sources, stacked and tagged by source."""
    return in_tonnes(stack([tagged(df, data_source=name) for name, df in sources.items()]))


def best_series(
    sources: Mapping[str, DataFrame], rules: Sequence[SpliceRule] = BEST_SERIES
) -> DataFrame:
    """The source to use for each area and year range.

    A source is cut to its own rules before it is added to the series, so one that no rule
    names is not read. Two rows for one area and year are an error.
    """
    used = {name: rows for name, rows in sources.items() if any(r.source == name for r in rules)}
    cut = [splice(tagged(rows, data_source=name), [r for r in rules if r.source == name]) for name, rows in used.items()]
    series = in_tonnes(stack(cut))
    same = F.count(F.lit(1)).over(Window.partitionBy("Mgmt_area", "year"))
    clash = F.concat(F.lit("two rows for "), F.concat_ws(" ", "Mgmt_area", "year"))
    checked = F.when(F.col("_same") > 1, F.raise_error(clash)).otherwise(F.col("data_source"))
    return series.withColumn("_same", same).withColumn("data_source", checked).drop("_same")


def discrepancy_by_gear(
    grid: DataFrame,
    cleaned_tickets: DataFrame,
    area: str,
    first_year: int,
    last_year: int,
    ticket_gears: Mapping[str, Sequence[str]] = TICKET_GEARS,
    names: tuple[str, str] = (EARNINGS, TICKETS),
) -> DataFrame:
    """Catch of two sources by gear for one area and year range, in tonnes."""
    span = (F.col("Mgmt_area") == area) & F.col("year").between(first_year, last_year)
    left = totals.exact_total(grid.filter(span), ["year", "gear"], "whole_pounds", "_w", strictly=True)
    tickets = cleaned_tickets.filter(span).withColumn("gear", map_codes("gear", ticket_gears))
    right = totals.exact_total(tickets, ["year", "gear"], "round_pounds", "_w", strictly=True)
    both = stack([tagged(left, data_source=names[0]), tagged(right, data_source=names[1])])
    return both.withColumn("whole_mt", pounds_to_tonnes("_w")).drop("_w")

