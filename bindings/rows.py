"""Scans, projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import roles
from bindings.registry import query
from bindings.roles import AREAS, ctes, table
from haulmark.functions.dates import in_years
from haulmark.functions.measures import (
    fathoms_to_meters,
    millimeters_to_centimeters,
    pounds_to_tonnes,
)
from haulmark.functions.nulls import is_in, null_to
from haulmark.operators.joins import duplicate_keys, lookup_join, override_from
from haulmark.operators.rows import (
    below_global_max,
    order_by_levels,
    order_nulls_last,
    outside,
    stack,
    tagged,
)
from haulmark.operators.totals import exact_total
from haulmark.plans.landings import landings_with_areas, unknown_waters
from haulmark.sources.readers import inline_series, scan

S = SparkSession


@query(
    "src_scan_project_filter",
    """
    SELECT l_orderkey AS trip_no, l_suppkey AS adfg_no, l_returnflag AS gear, l_shipdate AS catch_date,
      l_quantity AS pounds, l_extendedprice AS round_pounds
    FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('F', 'O')""",
)
def src_scan_project_filter(spark: S, sf: str) -> DataFrame:
    return scan(
        table(spark, sf, "lineitem"),
        {
            "trip_no": "l_orderkey",
            "adfg_no": "l_suppkey",
            "gear": "l_returnflag",
            "catch_date": "l_shipdate",
            "pounds": "l_quantity",
            "round_pounds": "l_extendedprice",
        },
        (F.col("l_returnflag") == "R") & F.col("l_linestatus").isin("F", "O"),
    )


@query(
    "proj_sql_alias",
    """
    SELECT o_orderkey AS trip_no, o_custkey AS permit, o_orderstatus AS landing_status, o_totalprice AS pounds,
      o_orderdate AS date_landed, o_orderpriority
    FROM orders WHERE o_orderstatus = 'F'""",
)
def proj_sql_alias(spark: S, sf: str) -> DataFrame:
    return scan(
        table(spark, sf, "orders"),
        {
            "trip_no": "o_orderkey",
            "permit": "o_custkey",
            "landing_status": "o_orderstatus",
            "pounds": "o_totalprice",
            "date_landed": "o_orderdate",
            "o_orderpriority": "o_orderpriority",
        },
        F.col("o_orderstatus") == "F",
    )


@query(
    "proj_computed_scan",
    """
    SELECT p_partkey AS fish, CAST(180 + 21 * p_size AS DOUBLE) / 10 AS length, p_size * 1.8288e0 AS depth_meters,
      p_type AS project_code
    FROM part WHERE p_type IN ('ECONOMY', 'PROMO')""",
)
def proj_computed_scan(spark: S, sf: str) -> DataFrame:
    return scan(
        table(spark, sf, "part"),
        {
            "fish": "p_partkey",
            "length": millimeters_to_centimeters(180 + 21 * F.col("p_size")),
            "depth_meters": fathoms_to_meters("p_size"),
            "project_code": "p_type",
        },
        F.col("p_type").isin("ECONOMY", "PROMO"),
    )


@query(
    "src_inline_series",
    """
    WITH historical AS (
      SELECT * FROM (VALUES (1993, 74.5), (1994, 81.25), (1995, 60.0), (1996, 99.75)) AS h(year, whole_pounds)),
    modern AS (
      SELECT year(l_shipdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS whole_pounds
      FROM lineitem GROUP BY 1)
    SELECT CAST(year AS INTEGER) AS year, CAST(whole_pounds AS DOUBLE) AS whole_pounds, 'Historical' AS data_source,
      'AFRICA' AS Mgmt_area FROM historical
    UNION ALL
    SELECT CAST(year AS INTEGER), whole_pounds, 'Landings', NULL FROM modern""",
)
def src_inline_series(spark: S, sf: str) -> DataFrame:
    old = inline_series(spark, {"Mgmt_area": "AFRICA"}, 1993, [74.5, 81.25, 60.0, 99.75], "whole_pounds")
    dated = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), "l_extendedprice")
    new = exact_total(dated, ["year"], "l_extendedprice", "whole_pounds")
    return stack([tagged(old, data_source="Historical"), tagged(new, data_source="Landings")])


@query(
    "proj_rename",
    """SELECT c_custkey AS vessel, c_name AS vessel_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def proj_rename(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "customer").withColumnsRenamed(
        {"c_custkey": "vessel", "c_name": "vessel_name"}
    )


@query(
    "proj_select_rename",
    """
    SELECT l_quantity AS weight, CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS Gear, l_suppkey
    FROM lineitem""",
)
def proj_select_rename(spark: S, sf: str) -> DataFrame:
    # The derived Gear is replaced by the raw column, as an explicit select does.
    derived = table(spark, sf, "lineitem").withColumn("Gear", F.lower("l_linestatus"))
    return derived.select(
        F.col("l_quantity").alias("weight"),
        F.year("l_shipdate").alias("year"),
        F.col("l_linestatus").alias("Gear"),
        "l_suppkey",
    )


@query("proj_drop", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def proj_drop(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").drop("o_orderstatus", "o_orderpriority")


@query(
    "proj_mutate",
    """
    SELECT l_orderkey, l_extendedprice * 0.000453592e0 AS whole_mt, l_quantity + 1 AS adjusted,
      l_returnflag || '/' || l_linestatus AS code
    FROM lineitem""",
)
def proj_mutate(spark: S, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .withColumns(
            {
                "whole_mt": pounds_to_tonnes("l_extendedprice"),
                "adjusted": F.col("l_quantity") + 1,
                "code": F.concat("l_returnflag", F.lit("/"), "l_linestatus"),
            }
        )
        .select("l_orderkey", "whole_mt", "adjusted", "code")
    )


@query(
    "proj_sequential_mutate",
    """
    SELECT l_orderkey, l_linenumber, invalid, hooks, hooks / 2 AS half_hooks
    FROM (SELECT *, l_quantity - invalid AS hooks
          FROM (SELECT *, coalesce(nullif(l_linenumber, 3), 0) AS invalid FROM lineitem))""",
)
def proj_sequential_mutate(spark: S, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .withColumn("invalid", F.nullif(F.col("l_linenumber"), F.lit(3)))
        .withColumn("invalid", null_to("invalid", 0))
        .withColumn("hooks", F.col("l_quantity") - F.col("invalid"))
        .withColumn("half_hooks", F.col("hooks") / 2)
        .select("l_orderkey", "l_linenumber", "invalid", "hooks", "half_hooks")
    )


@query(
    "proj_tag",
    "SELECT s_suppkey, s_name, 'Survey' AS Source, 'Longline' AS Gear FROM supplier",
)
def proj_tag(spark: S, sf: str) -> DataFrame:
    return tagged(table(spark, sf, "supplier").select("s_suppkey", "s_name"), Source="Survey", Gear="Longline")


@query(
    "proj_cast",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS trip_no, CAST(CAST(year(o_orderdate) AS VARCHAR) AS DOUBLE) AS year,
      TRY_CAST(o_orderpriority AS DOUBLE) AS not_a_number
    FROM orders""",
)
def proj_cast(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("trip_no"),
        F.year("o_orderdate").cast("string").cast("double").alias("year"),
        F.col("o_orderpriority").try_cast("double").alias("not_a_number"),
    )


@query("flt_eq", "SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag = 'A'")
def flt_eq(spark: S, sf: str) -> DataFrame:
    return scan(
        table(spark, sf, "lineitem"),
        ["l_orderkey", "l_returnflag", "l_quantity"],
        F.col("l_returnflag") == "A",
    )


@query(
    "flt_in",
    """
    SELECT o_orderkey, o_orderstatus, o_orderpriority,
      NOT coalesce(nullif(o_orderstatus, 'O') IN ('F'), FALSE) AS not_f
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')""",
)
def flt_in(spark: S, sf: str) -> DataFrame:
    kept = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "O")
    return table(spark, sf, "orders").filter(kept).select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        (~is_in(F.nullif(F.col("o_orderstatus"), F.lit("O")), ["F"])).alias("not_f"),
    )


@query(
    "flt_not_null",
    """
    SELECT * FROM (SELECT l_orderkey, nullif(l_quantity, 13) AS length FROM lineitem) WHERE length IS NOT NULL""",
)
def flt_not_null(spark: S, sf: str) -> DataFrame:
    fish = table(spark, sf, "lineitem").select(
        "l_orderkey", F.nullif(F.col("l_quantity"), F.lit(13.0)).alias("length")
    )
    return fish.filter(F.col("length").isNotNull())


@query(
    "flt_outlier_range",
    """
    SELECT * FROM (SELECT l_orderkey, nullif(l_quantity, 25) AS length FROM lineitem)
    WHERE NOT (length < 5 OR length > 45) AND NOT (length < 8)""",
)
def flt_outlier_range(spark: S, sf: str) -> DataFrame:
    fish = table(spark, sf, "lineitem").select(
        "l_orderkey", F.nullif(F.col("l_quantity"), F.lit(25.0)).alias("length")
    )
    return fish.filter(~outside(F.col("length"), 5, 45)).filter(~(F.col("length") < 8))


@query(
    "flt_ne_null",
    """
    SELECT * FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN '02' WHEN 'R' THEN '01' END AS condition_code
                   FROM lineitem) WHERE condition_code <> '02'""",
)
def flt_ne_null(spark: S, sf: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", "02").when(F.col("l_returnflag") == "R", "01")
    sets = table(spark, sf, "lineitem").select("l_orderkey", code.alias("condition_code"))
    return sets.filter(F.col("condition_code") != "02")


@query(
    "flt_below_global_max",
    """
    SELECT l_orderkey, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity FROM lineitem
    WHERE year(l_shipdate) < (SELECT max(year(l_shipdate)) FROM lineitem)""",
)
def flt_below_global_max(spark: S, sf: str) -> DataFrame:
    sets = table(spark, sf, "lineitem").select(
        "l_orderkey", F.year("l_shipdate").alias("year"), "l_quantity"
    )
    return below_global_max(sets, "year")


@query(
    "flt_year_range",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
    WHERE year(o_orderdate) BETWEEN 1996 AND 1998""",
)
def flt_year_range(spark: S, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter(in_years("o_orderdate", 1996, 1998))
    return orders.select("o_orderkey", F.year("o_orderdate").alias("year"))


@query(
    "join_inner_two_keys",
    ctes("landings", "stat_areas")
    + """
    SELECT l.stat_area, l.stat_area_type, l.year, l.gear_code, l.pounds, a.region, a.waters
    FROM landings l JOIN stat_areas a ON l.stat_area IS NOT DISTINCT FROM a.stat_area
      AND l.stat_area_type IS NOT DISTINCT FROM a.stat_area_type""",
)
def join_inner_two_keys(spark: S, sf: str) -> DataFrame:
    lookup = roles.stat_areas(spark, sf).select("stat_area", "stat_area_type", "region", "waters")
    return lookup_join(
        roles.landings(spark, sf),
        lookup,
        ["stat_area", "stat_area_type"],
        "inner",
    ).select("stat_area", "stat_area_type", "year", "gear_code", "pounds", "region", "waters")


@query(
    "join_inner_lookup",
    ctes("landings", "stat_to_area")
    + """
    SELECT l.stat_area AS stat, l.year, l.pounds, a.g_management_area_code
    FROM landings l JOIN stat_to_area a ON l.stat_area = a.stat""",
)
def join_inner_lookup(spark: S, sf: str) -> DataFrame:
    fish = roles.landings(spark, sf).select(F.col("stat_area").alias("stat"), "year", "pounds")
    areas = roles.stat_to_area(spark, sf)
    return lookup_join(fish, areas, ["stat"], "inner")


_SET_WATERS = """
    SELECT l_orderkey, l_linenumber, l_suppkey AS block, 1985 + 5 * (l_suppkey % 4 // 2) AS start_year,
      CASE WHEN l_suppkey % 2 = 0 THEN 'closed' END AS end_code, 'FED' AS waters FROM lineitem"""
_SUPPLIER_UPDATES = """
    SELECT s_suppkey AS block, CASE WHEN s_nationkey = 7 THEN 1970 ELSE 1985 + 5 * (s_suppkey % 4 // 2) END AS start_year,
      CASE WHEN s_suppkey % 2 = 0 THEN 'closed' END AS end_code,
      CASE WHEN s_acctbal < 2500 THEN 'STATE' END AS updated_waters FROM supplier"""
_WATERS_JOIN = """
    FROM w LEFT JOIN u ON w.block IS NOT DISTINCT FROM u.block
      AND w.start_year IS NOT DISTINCT FROM u.start_year AND w.end_code IS NOT DISTINCT FROM u.end_code"""


def _set_waters(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sets whose key has a missing part in half the blocks, and updates of which some match none."""

    def validity(key: str) -> list[Column]:
        start = F.when(F.col(key) % 4 < 2, 1985).otherwise(1990)
        return [start.alias("start_year"), F.when(F.col(key) % 2 == 0, "closed").alias("end_code")]

    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("block"), *validity("l_suppkey"), F.lit("FED").alias("waters")
    )
    start, end = validity("s_suppkey")
    updates = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("block"),
        F.when(F.col("s_nationkey") == 7, 1970).otherwise(start).alias("start_year"),
        end,
        F.when(F.col("s_acctbal") < 2500, "STATE").alias("updated_waters"),
    )
    return rows, updates


@query(
    "join_left_nullsafe",
    f"WITH w AS ({_SET_WATERS}), u AS ({_SUPPLIER_UPDATES}) SELECT w.*, u.updated_waters {_WATERS_JOIN}",
)
def join_left_nullsafe(spark: S, sf: str) -> DataFrame:
    rows, updates = _set_waters(spark, sf)
    return lookup_join(rows, updates, ["block", "start_year", "end_code"], "left")


@query(
    "join_override_coalesce",
    f"""WITH w AS ({_SET_WATERS}), u AS ({_SUPPLIER_UPDATES})
    SELECT w.l_orderkey, w.l_linenumber, w.block, w.start_year, w.end_code, coalesce(u.updated_waters, w.waters) AS waters
    {_WATERS_JOIN}""",
)
def join_override_coalesce(spark: S, sf: str) -> DataFrame:
    rows, updates = _set_waters(spark, sf)
    return override_from(rows, updates, ["block", "start_year", "end_code"], "waters", "updated_waters")


@query(
    "join_left_lookup",
    ctes("landings", "stat_sizes")
    + """
    SELECT CAST(l.stat_area AS VARCHAR) AS Stat, l.year, l.pounds, s.Mgmt_area, s.stat_km2
    FROM landings l LEFT JOIN stat_sizes s ON CAST(l.stat_area AS VARCHAR) = CAST(s.Stat AS VARCHAR)""",
)
def join_left_lookup(spark: S, sf: str) -> DataFrame:
    stat = F.col("stat_area").cast("string").alias("Stat")
    sets = roles.landings(spark, sf).select(stat, "year", "pounds")
    sizes = roles.stat_sizes(spark, sf).withColumn("Stat", F.col("Stat").cast("string"))
    return lookup_join(sets, sizes, ["Stat"], "left")


@query(
    "landings_with_areas",
    ctes("landings_areas") + " SELECT * FROM landings_areas",
)
def landings_with_areas_query(spark: S, sf: str) -> DataFrame:
    return landings_with_areas(
        roles.landings(spark, sf), roles.stat_areas(spark, sf), roles.waters_updates(spark, sf)
    )


@query(
    "sort_multi_key",
    """
    SELECT l_returnflag AS Mgmt_area, CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS data_source,
      count(*) AS n
    FROM lineitem GROUP BY ALL ORDER BY 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST""",
)
def sort_multi_key(spark: S, sf: str) -> DataFrame:
    counts = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("Mgmt_area"),
            F.year("l_shipdate").alias("year"),
            F.col("l_linestatus").alias("data_source"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return order_nulls_last(counts, "Mgmt_area", "year", "data_source")


_LEVELS = ["N", "A", "R"]


@query(
    "sort_by_levels",
    """
    SELECT l_returnflag AS gear, l_linestatus AS area, count(*) AS n FROM lineitem GROUP BY 1, 2
    ORDER BY array_position(['N', 'A', 'R'], l_returnflag), l_linestatus""",
)
def sort_by_levels(spark: S, sf: str) -> DataFrame:
    counts = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("gear"), F.col("l_linestatus").alias("area"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return order_by_levels(counts, {"gear": _LEVELS}, ["gear", "area"])


@query(
    "set_union_by_name",
    """
    SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value, NULL AS sd FROM orders
    UNION ALL BY NAME
    SELECT l_tax AS sd, l_quantity AS value, CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey AS key FROM lineitem""",
)
def set_union_by_name(spark: S, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("value"),
    )
    b = table(spark, sf, "lineitem").select(
        F.col("l_tax").alias("sd"),
        F.col("l_quantity").alias("value"),
        F.year("l_shipdate").alias("year"),
        F.col("l_orderkey").alias("key"),
    )
    return stack([a, b])


@query(
    "set_distinct",
    ctes("stat_areas", "landings")
    + """
    SELECT DISTINCT a.g_mgt_area_district, a.stat_area, a.waters, a.start_date, a.end_date
    FROM landings l JOIN stat_areas a ON l.stat_area = a.stat_area AND l.stat_area_type = a.stat_area_type
    WHERE a.region IN ('AFRICA', 'ASIA')""",
)
def set_distinct(spark: S, sf: str) -> DataFrame:
    districts = [d for area in ("AFRICA", "ASIA") for d in AREAS[area]]
    return unknown_waters(roles.landings(spark, sf), roles.stat_areas(spark, sf), districts)


@query(
    "dq_duplicate_keys",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dq_duplicate_keys(spark: S, sf: str) -> DataFrame:
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
