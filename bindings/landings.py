"""Catch pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import roles
from bindings.registry import query
from bindings.roles import AREAS, GEARS, ctes, sql_map
from haulmark.operators.series import SpliceRule
from haulmark.plans import landings as plans
from haulmark.sources.readers import inline_series, scan

S = SparkSession
EARNINGS, TICKETS, OLD = "Earnings file", "Fish tickets", "Historical"
HISTORY = [74603.25, 41269.5, 69841.75, 182539.0, 90210.5, 66000.0]
TICKET_GEARS = {
    "HAL": ["1-URGENT", "2-HIGH"],
    "POT": ["3-MEDIUM"],
    "TRW": ["4-NOT SPECIFIED"],
}
RULES = [
    SpliceRule("AFRICA", OLD, last_year=1997),
    SpliceRule("AFRICA", EARNINGS, first_year=1998),
    SpliceRule("AMERICA", EARNINGS),
    SpliceRule("ASIA", EARNINGS),
]
_TONNES = "whole_pounds * 0.000453592e0 AS whole_mt"
_HISTORY = "(VALUES " + ", ".join(f"({1992 + i}, {v}e0)" for i, v in enumerate(HISTORY)) + ") h(year, whole_pounds)"


def catch_grid(
    spark: S, sf: str, shown: list[str] | None = None, years: tuple[int, int] | None = None
) -> DataFrame:
    landed = roles.landings(spark, sf, years)
    return plans.catch_by_year_area_gear(
        landed.filter(F.col("species_code") == plans.SPECIES),
        roles.stat_areas(spark, sf),
        roles.waters_updates(spark, sf),
        AREAS,
        GEARS,
        shown=shown,
    )


def _sources(spark: S, sf: str, earnings: DataFrame) -> dict[str, DataFrame]:
    wanted = _wanted(roles.tickets(spark, sf), ["AFRICA", "AMERICA"])
    return {
        OLD: inline_series(spark, {"Mgmt_area": "AFRICA"}, 1992, HISTORY, "whole_pounds"),
        EARNINGS: earnings,
        TICKETS: plans.ticket_catch(plans.clean_tickets(wanted)),
    }


def _wanted(tickets: DataFrame, areas: list[str]) -> DataFrame:
    """The rows of the ticket scan, whose other columns no test table has."""
    return scan(
        tickets,
        ["year", "g_management_area_code", "gear", "pounds", "round_pounds"],
        (F.col("species_code") == plans.SPECIES) & F.col("g_management_area_code").isin(areas),
    )


@query(
    "landings_by_year_area",
    ctes("ticket_year_area") + " SELECT * FROM ticket_year_area WHERE Mgmt_area IN ('AFRICA', 'ASIA')",
)
def landings_by_year_area(spark: S, sf: str) -> DataFrame:
    return plans.ticket_catch(plans.clean_tickets(_wanted(roles.tickets(spark, sf), ["AFRICA", "ASIA"])))


@query("catch_by_year_area_gear", ctes("catch_grid") + " SELECT * FROM catch_grid")
def catch_by_year_area_gear(spark: S, sf: str) -> DataFrame:
    return catch_grid(spark, sf)


@query(
    "compare_sources",
    ctes("catch_year_area", "ticket_year_area")
    + f"""
    SELECT CAST(year AS INTEGER) AS year, 'AFRICA' AS Mgmt_area, {_TONNES}, '{OLD}' AS data_source FROM {_HISTORY}
    UNION ALL SELECT year, Mgmt_area, {_TONNES}, '{EARNINGS}' FROM catch_year_area WHERE Mgmt_area IN ('AFRICA', 'AMERICA')
    UNION ALL SELECT year, Mgmt_area, {_TONNES}, '{TICKETS}' FROM ticket_year_area WHERE Mgmt_area IN ('AFRICA', 'AMERICA')""",
)
def compare_sources(spark: S, sf: str) -> DataFrame:
    earnings = plans.catch_by_year_area(catch_grid(spark, sf, ["AFRICA", "AMERICA"]))
    return plans.compare_sources(_sources(spark, sf, earnings))


@query(
    "splice_sources",
    ctes("catch_year_area")
    + f"""
    SELECT CAST(year AS INTEGER) AS year, 'AFRICA' AS Mgmt_area, {_TONNES}, '{OLD}' AS data_source FROM {_HISTORY}
    WHERE year <= 1997
    UNION ALL SELECT year, Mgmt_area, {_TONNES}, '{EARNINGS}' FROM catch_year_area
    WHERE (Mgmt_area = 'AFRICA' AND year >= 1998) OR Mgmt_area IN ('AMERICA', 'ASIA')""",
)
def splice_sources(spark: S, sf: str) -> DataFrame:
    earnings = plans.catch_by_year_area(catch_grid(spark, sf, [r.area for r in RULES if r.source == EARNINGS]))
    return plans.best_series(_sources(spark, sf, earnings), RULES)


@query(
    "discrepancy_by_gear",
    ctes("catch_grid", "clean_tickets")
    + f"""
    SELECT year, gear, w * 0.000453592e0 AS whole_mt, data_source FROM (
      SELECT year, gear, CAST(sum(CAST(whole_pounds AS DECIMAL(18, 4))) AS DOUBLE) AS w, '{EARNINGS}' AS data_source
      FROM catch_grid WHERE Mgmt_area = 'AFRICA' AND year BETWEEN 1996 AND 1998 GROUP BY year, gear
      UNION ALL
      SELECT year, {sql_map("gear", TICKET_GEARS)} AS g, CAST(sum(CAST(round_pounds AS DECIMAL(18, 4))) AS DOUBLE),
        '{TICKETS}' FROM clean_tickets WHERE Mgmt_area = 'AFRICA' AND year BETWEEN 1996 AND 1998 GROUP BY year, g)""",
)
def discrepancy_by_gear(spark: S, sf: str) -> DataFrame:
    return plans.discrepancy_by_gear(
        catch_grid(spark, sf, ["AFRICA"], (1996, 1998)),
        plans.clean_tickets(_wanted(roles.tickets(spark, sf, (1996, 1998)), ["AFRICA"])),
        "AFRICA",
        1996,
        1998,
        TICKET_GEARS,
        (EARNINGS, TICKETS),
    )


# Stores with every column that the scans fetch, by expressions that both engines read alike.
TICKET_STORE = {
    "year": "CAST(year(o_orderdate) AS INT)",
    "adfg_no": "CAST(o_custkey AS STRING)",
    "trip_no": "CAST(o_orderkey AS STRING)",
    "vessel_name": "concat('V-', CAST(o_custkey % 97 AS STRING))",
    "port_code": "o_orderstatus",
    "gear": "o_orderpriority",
    "catch_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "sell_date": "CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "harvest_code": "CASE WHEN o_orderkey % 5 = 0 THEN '43' ELSE '11' END",
    "harvest": "CASE WHEN o_orderkey % 5 = 0 THEN 'Survey' ELSE 'State' END",
    "g_stat_area": "CAST(345000 + o_custkey % 700 AS STRING)",
    "g_management_area_code": "CASE o_custkey % 4 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' END",
    "species_code": "CASE WHEN o_custkey % 7 = 3 THEN '711' ELSE '710' END",
    "pounds": "o_totalprice",
    "round_pounds": "CASE WHEN o_orderstatus = 'P' THEN 0e0 ELSE o_totalprice END",
    "delivery_code": "CAST(o_orderkey % 10 AS STRING)",
    "g_cfec_fishery_group": "substring(o_orderpriority, 1, 1)",
    "g_cfec_fishery": "concat(substring(o_orderpriority, 1, 1), CAST(o_custkey % 3 AS STRING))",
    "not_fetched": "o_orderkey + o_custkey",
}
EARNINGS_STORE = {
    "year": "CAST(year(l_shipdate) AS STRING)",
    "date_landed": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "gear_code": "concat(l_returnflag, l_linestatus)",
    "port_code": "CAST(l_suppkey % 11 AS STRING)",
    "cfec_harvest_area": "CAST(l_partkey % 13 AS STRING)",
    "cfec_permit": "concat('C', CAST(l_partkey % 29 AS STRING))",
    "delivery_code": "CAST(l_linenumber AS STRING)",
    "harvest_code": "CASE WHEN l_linenumber = 7 THEN '43' ELSE '11' END",
    "mgt_program_code": "CASE WHEN l_orderkey % 3 = 0 THEN 'IFQ' END",
    "species_code": "CASE WHEN l_tax = 3e-2 THEN '711' ELSE '710' END",
    "stat_area": "CAST(l_suppkey AS STRING)",
    "stat_area_type": "CAST(l_suppkey % 2 AS STRING)",
    "landing_status": "l_linestatus",
    "pounds": "l_quantity",
    "whole_pounds": "CASE WHEN l_discount = 0 THEN 0e0 ELSE l_extendedprice END",
    "not_fetched": "l_orderkey + l_partkey",
}


def _sql(store: dict[str, str], source: str, columns: list[str], where: str) -> str:
    fetched = ", ".join(columns)
    return f"SELECT {fetched} FROM (SELECT {', '.join(f'{x} AS {c}' for c, x in store.items())} FROM {source}) WHERE {where}"


@query(
    "ticket_scan",
    _sql(
        TICKET_STORE,
        "orders",
        plans.TICKET_COLUMNS,
        "species_code = '710' AND g_management_area_code IN ('AFRICA', 'AMERICA')",
    ),
)
def ticket_scan(spark: S, sf: str) -> DataFrame:
    store = roles.table(spark, sf, "orders").selectExpr(*[f"{x} AS {c}" for c, x in TICKET_STORE.items()])
    return plans.ticket_scan(store, areas=["AFRICA", "AMERICA"])


@query(
    "earnings_scan",
    _sql(EARNINGS_STORE, "lineitem", list(plans.EARNINGS_COLUMNS), "species_code = '710'"),
)
def earnings_scan(spark: S, sf: str) -> DataFrame:
    """The store's own column names, which the scan shortens."""
    named = {plans.EARNINGS_COLUMNS.get(c, c): x for c, x in EARNINGS_STORE.items()}
    store = roles.table(spark, sf, "lineitem").selectExpr(*[f"{x} AS {c}" for c, x in named.items()])
    return plans.earnings_scan(store)
