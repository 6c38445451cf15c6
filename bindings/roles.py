"""Landing, specimen and effort roles played by the test tables.

Every frame is derived from whole tables. ``SQL`` holds the same derivations as
common table expressions, used by the reference queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.categories import map_codes
from haulmark.functions.dates import in_years
from haulmark.plans.biology import MATURITY_CODES, SEX_CODES

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
# Districts of an area are the nations of a region; the last region is only partly used.
AREAS = {r: [f"NATION_{k}" for k in range(i, 25, 5)] for i, r in enumerate(REGIONS[:4])}
AREAS["MIDDLE EAST"] = ["NATION_4", "NATION_9"]
# UNK is declared but never observed, so the grid has cells to add.
GEARS = {
    "HAL": ["AF", "AO"],
    "POT": ["NF"],
    "TRW": ["NO"],
    "JIG/TRL": ["RF"],
    "GNT": ["RO"],
    "UNK": ["ZZ"],
}


# Declared, so that opening a table reads no file footer.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def area_of(key: str) -> Column:
    """Area recorded on a row, from a key every row has."""
    return F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col(key) % 5 + 1).cast("int"))


def sql_area(key: str) -> str:
    return f"([{sql_list(REGIONS)}])[{key} % 5 + 1]"


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_map(c: str, codes: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN {c} IN ({sql_list(v)}) THEN '{k}'" for k, v in codes.items())
    return f"CASE {whens} END"


def sql_values(values: list[str], name: str) -> str:
    return "(VALUES " + ", ".join(f"('{v}')" for v in values) + f") AS {name}_levels({name})"


def region_of_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier with the names of its nation and region, which follow from its nation's key."""
    return table(spark, sf, "supplier").select(
        "*",
        F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("n_name"),
        area_of("s_nationkey").alias("r_name"),
    )


def landings(spark: SparkSession, sf: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Landings: the supplier is the stat area, the return and line flags the gear."""
    items = table(spark, sf, "lineitem")
    return (items.filter(in_years("l_shipdate", *years)) if years else items).select(
        F.year("l_shipdate").alias("year"),
        F.concat("l_returnflag", "l_linestatus").alias("gear_code"),
        F.col("l_suppkey").alias("stat_area"),
        (F.col("l_suppkey") % 2).alias("stat_area_type"),
        F.col("l_quantity").alias("pounds"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("whole_pounds"),
        species_of("l_tax").alias("species_code"),
    )


def species_of(c: str) -> Column:
    """Some rows are of another species, which no catch table may count."""
    return F.when(F.col(c) == 0.03, "711").otherwise("710")


def _waters() -> Column:
    """Recorded waters; missing for the smallest balances."""
    return F.when(F.col("s_acctbal") >= 6500, "FED").when(F.col("s_acctbal") >= 2500, "STATE")


def _validity() -> tuple[Column, Column]:
    start = F.when(F.col("s_suppkey") % 4 < 2, "1985-01-01").otherwise("1990-01-01")
    end = F.when(F.col("s_suppkey") % 2 == 0, "1999-12-31")
    return start.cast("timestamp_ntz"), end.cast("timestamp_ntz")


def stat_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Stat-area lookup: the areas of one nation have a type no landing uses."""
    start, end = _validity()
    kind = F.when(F.col("n_name") == "NATION_7", 9).otherwise(F.col("s_suppkey") % 2)
    return region_of_supplier(spark, sf).select(
        F.col("s_suppkey").alias("stat_area"),
        kind.alias("stat_area_type"),
        F.col("r_name").alias("region"),
        _waters().alias("waters"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.col("n_name").alias("g_mgt_area_district"),
    )


def waters_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Waters of the stat areas that lack them, half of all with an open validity."""
    start, end = _validity()
    new = F.when(F.col("s_suppkey") % 4 < 2, "STATE").otherwise("FED")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("stat_area"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.when(_waters().isNull(), new).alias("updated_waters"),
    )


def tickets(spark: SparkSession, sf: str, years: tuple[int, int] | None = None) -> DataFrame:
    """A second landing source: orders, the customer giving the area."""
    orders = table(spark, sf, "orders")
    return (orders.filter(in_years("o_orderdate", *years)) if years else orders).select(
        F.year("o_orderdate").alias("year"),
        area_of("o_custkey").alias("g_management_area_code"),
        F.col("o_orderpriority").alias("gear"),
        F.col("o_totalprice").alias("pounds"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice")).alias("round_pounds"),
        F.when(F.col("o_custkey") % 7 == 3, "711").otherwise("710").alias("species_code"),
    )


PROJECTS = ["02", "17", "10", "11", "601", "603", "02"]
STAGES = ["01", "02", "03", "04", "05", "06", "07", "08", "09"]


def specimens(spark: SparkSession, sf: str) -> DataFrame:
    """Raw specimens of all projects, the line number giving the project."""
    size = F.col("l_partkey") % 50
    stage = F.rint(F.col("l_tax") * 100).cast("int") + 1
    area = area_of("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.element_at(F.array(*map(F.lit, PROJECTS)), F.col("l_linenumber")).alias("project_code"),
        area.alias("g_management_area_code"),
        area.alias("management_area"),
        F.col("l_suppkey").alias("stat"),
        F.when(F.col("l_linenumber") == 7, "711").otherwise("710").alias("species_code"),
        F.when(size != 13, 180 + 21 * size + F.col("l_orderkey") % 7).alias("length_millimeters"),
        F.when(F.col("l_discount") != 0.05, F.col("l_extendedprice") / 10000).alias("weight_kilograms"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity").cast("int")).alias("age"),
        F.when(F.col("l_returnflag") == "A", "01")
        .when(F.col("l_returnflag") == "R", "02")
        .alias("sex_code"),
        F.element_at(F.array(*map(F.lit, STAGES)), stage).alias("maturity_code"),
    )


def stat_to_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area of a stat area; the keys of one nation match no set."""
    return region_of_supplier(spark, sf).select(
        _known_stat().alias("stat"), F.col("r_name").alias("g_management_area_code")
    )


def _known_stat() -> Column:
    return F.when(F.col("n_name") == "NATION_13", -F.col("s_suppkey")).otherwise(F.col("s_suppkey"))


def bio(spark: SparkSession, sf: str) -> DataFrame:
    """All specimens under the common column names, missing values left in."""
    project = F.col("project_code")
    return specimens(spark, sf).select(
        "year",
        F.when(project.isin("02", "601", "603"), "Longline").otherwise("Pot").alias("Gear"),
        F.when(project.isin("02", "17"), "Fishery").otherwise("Survey").alias("Source"),
        F.col("management_area").alias("Mgmt_area"),
        F.col("species_code").alias("Spp_cde"),
        (F.col("length_millimeters") / 10).alias("length"),
        F.col("weight_kilograms").alias("weight"),
        "age",
        map_codes("sex_code", SEX_CODES).alias("Sex"),
        map_codes("maturity_code", MATURITY_CODES).cast("int").alias("Maturity"),
    )


def survey_hooks(spark: SparkSession, sf: str) -> DataFrame:
    """Survey sets. One set in seven belongs to another project."""
    line = F.col("l_linenumber")
    project = (
        F.when(line == 7, "999").when(line % 4 == 0, "603").when(line % 4 == 1, "03")
        .when(line % 4 == 2, "601").otherwise("01")
    )
    condition = F.when(F.col("l_returnflag") == "A", "02").when(F.col("l_returnflag") == "R", "01")
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        project.alias("project_code"),
        F.col("l_orderkey").cast("string").alias("trip_no"),
        F.col("l_partkey").cast("string").alias("station_no"),
        F.col("l_suppkey").cast("string").alias("adfg_no"),
        F.col("l_linestatus").alias("vessel_name"),
        F.col("l_shipdate").alias("time_first_buoy_onboard"),
        F.col("l_suppkey").cast("string").alias("stat"),
        F.col("l_linenumber").alias("effort_no"),
        F.col("l_discount").alias("start_lat"),
        F.col("l_tax").alias("start_lon"),
        (F.col("l_discount") + 1).alias("end_lat"),
        (F.col("l_tax") + 1).alias("end_lon"),
        F.col("l_quantity").alias("avg_depth_fathoms"),
        (F.floor(F.col("l_extendedprice") / 1000).cast("int") + line).alias("number_hooks"),
        F.when(line != 2, F.lit(1)).alias("bare"),
        F.when(line != 4, F.lit(2)).alias("bait"),
        F.when(line % 3 != 0, line).alias("invalid"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity").cast("int")).alias("sablefish"),
        condition.alias("subset_condition_code"),
    )


def stat_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Area and size of a stat area; the keys of one nation match no set."""
    return region_of_supplier(spark, sf).select(
        _known_stat().alias("Stat"),
        F.col("r_name").alias("Mgmt_area"),
        (F.lit(10.0) + F.col("s_suppkey")).alias("stat_km2"),
    )


def logbook_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Logbook sets; some are hauled before they were set, some name no hook size."""
    line = F.col("l_linenumber")
    soak = F.make_dt_interval(hours=F.col("l_quantity").cast("int") - 10, mins=line)
    size = F.when(line != 3, F.concat(F.lit("No. "), (line + 10).cast("string"), F.lit("/0")))
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        area_of("l_suppkey").alias("g_management_area_code"),
        F.col("l_orderkey").cast("string").alias("trip_no"),
        F.col("l_suppkey").cast("string").alias("adfg_no"),
        F.col("l_returnflag").alias("trip_target"),
        F.col("l_shipdate").alias("time_set"),
        (F.col("l_shipdate") + soak).alias("time_hauled"),
        F.col("l_linestatus").alias("longline_system_code"),
        F.coalesce(size, F.lit("mixed")).alias("hook_size"),
        (F.lit(30.0) + 3 * line).alias("hook_spacing"),
        F.col("l_suppkey").cast("string").alias("g_stat_area"),
        F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("number_of_hooks"),
        F.col("l_quantity").alias("average_depth_meters"),
        F.col("l_linenumber").alias("effort_no"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity")).alias("sable_lbs_per_set"),
        F.col("l_discount").alias("start_latitude_decimal_degrees"),
        F.col("l_tax").alias("start_longitude_decimal_degree"),
    )


SQL = {
    "region_of_supplier": """
    SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
    "landings": """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag || l_linestatus AS gear_code,
      l_suppkey AS stat_area, l_suppkey % 2 AS stat_area_type,
      l_quantity AS pounds, CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS whole_pounds,
      CASE WHEN l_tax = 0.03 THEN '711' ELSE '710' END AS species_code
    FROM lineitem""",
    "stat_areas": """
    SELECT s_suppkey AS stat_area,
      CASE WHEN n_name = 'NATION_7' THEN 9 ELSE s_suppkey % 2 END AS stat_area_type,
      r_name AS region, CASE WHEN s_acctbal >= 6500 THEN 'FED' WHEN s_acctbal >= 2500 THEN 'STATE' END AS waters,
      CASE WHEN s_suppkey % 4 < 2 THEN TIMESTAMP '1985-01-01' ELSE TIMESTAMP '1990-01-01' END AS start_date,
      CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '1999-12-31' END AS end_date,
      n_name AS g_mgt_area_district
    FROM region_of_supplier""",
    "waters_updates": """
    SELECT s_suppkey AS stat_area,
      CASE WHEN s_suppkey % 4 < 2 THEN TIMESTAMP '1985-01-01' ELSE TIMESTAMP '1990-01-01' END AS start_date,
      CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '1999-12-31' END AS end_date,
      CASE WHEN s_acctbal < 2500 THEN CASE WHEN s_suppkey % 4 < 2 THEN 'STATE' ELSE 'FED' END END AS updated_waters
    FROM supplier""",
    "landings_areas": """
    SELECT l.*, a.region, coalesce(u.updated_waters, a.waters) AS waters, a.start_date, a.end_date,
      a.g_mgt_area_district
    FROM landings l JOIN stat_areas a
      ON l.stat_area IS NOT DISTINCT FROM a.stat_area
     AND l.stat_area_type IS NOT DISTINCT FROM a.stat_area_type
    LEFT JOIN waters_updates u
      ON a.stat_area IS NOT DISTINCT FROM u.stat_area
     AND a.start_date IS NOT DISTINCT FROM u.start_date
     AND a.end_date IS NOT DISTINCT FROM u.end_date""",
    "catch": f"""
    SELECT year, Mgmt_area, gear,
      CASE WHEN count(*) = count(w) THEN CAST(sum(CAST(w AS DECIMAL(18, 4))) AS DOUBLE) END AS whole_pounds
    FROM (
      SELECT year, {sql_map("g_mgt_area_district", AREAS)} AS Mgmt_area, {sql_map("gear_code", GEARS)} AS gear,
        CASE WHEN whole_pounds = 0 THEN pounds ELSE whole_pounds END AS w
      FROM landings_areas
      WHERE species_code = '710' AND g_mgt_area_district IN ({sql_list([d for v in AREAS.values() for d in v])}) AND waters IN ('STATE')
    ) GROUP BY year, Mgmt_area, gear""",
    "catch_grid": f"""
    SELECT y.year, Mgmt_area, gear, coalesce(c.whole_pounds, 0) AS whole_pounds
    FROM (SELECT DISTINCT year FROM catch) y
    CROSS JOIN {sql_values(list(AREAS), "Mgmt_area")}
    CROSS JOIN {sql_values(list(GEARS), "gear")}
    LEFT JOIN catch c USING (year, Mgmt_area, gear)""",
    "catch_year_area": """
    SELECT year, Mgmt_area,
      CASE WHEN count(*) = count(whole_pounds)
        THEN CAST(sum(CAST(whole_pounds AS DECIMAL(18, 4))) AS DOUBLE) END AS whole_pounds
    FROM catch_grid GROUP BY year, Mgmt_area""",
    "tickets": """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {area} AS Mgmt_area, o_orderpriority AS gear,
      o_totalprice AS pounds, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS round_pounds
    FROM orders WHERE o_custkey % 7 <> 3""".format(area=sql_area("o_custkey")),
    "clean_tickets": """
    SELECT year, Mgmt_area, gear, pounds,
      CASE WHEN round_pounds = 0 THEN pounds ELSE round_pounds END AS round_pounds
    FROM tickets""",
    "ticket_year_area": """
    SELECT year, Mgmt_area,
      CASE WHEN count(*) = count(round_pounds)
        THEN CAST(sum(CAST(round_pounds AS DECIMAL(18, 4))) AS DOUBLE) END AS whole_pounds
    FROM clean_tickets GROUP BY year, Mgmt_area""",
    "specimens": f"""
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, ([{sql_list(PROJECTS)}])[l_linenumber] AS project_code,
      {sql_area("l_suppkey")} AS area, l_suppkey AS stat,
      CASE WHEN l_linenumber = 7 THEN '711' ELSE '710' END AS species_code,
      CASE WHEN l_partkey % 50 <> 13 THEN 180 + 21 * (l_partkey % 50) + l_orderkey % 7 END AS length_millimeters,
      CASE WHEN l_discount <> 0.05 THEN l_extendedprice / 10000 END AS weight_kilograms,
      CASE WHEN l_quantity <> 13 THEN CAST(l_quantity AS INTEGER) END AS age,
      CASE l_returnflag WHEN 'A' THEN 'Male' WHEN 'R' THEN 'Female' END AS sex,
      CASE WHEN round(l_tax * 100) <= 1 THEN 0 WHEN round(l_tax * 100) <= 6 THEN 1 END AS maturity
    FROM lineitem""",
    "fishery_bio": """
    SELECT year, CASE project_code WHEN '02' THEN 'Longline' ELSE 'Pot' END AS Gear, 'Fishery' AS Source,
      area AS Mgmt_area, species_code AS Spp_cde, length_millimeters / 10 AS length,
      weight_kilograms AS weight, age, sex AS Sex, maturity AS Maturity
    FROM specimens WHERE project_code IN ('02', '17') AND species_code = '710'
      AND length_millimeters IS NOT NULL AND NOT (length_millimeters < 200 OR length_millimeters > 1200)""",
    "pot_bio": """
    SELECT year, 'Pot' AS Gear, 'Survey' AS Source, area AS Mgmt_area, species_code AS Spp_cde,
      length_millimeters / 10 AS length, weight_kilograms AS weight, age, sex AS Sex, maturity AS Maturity
    FROM specimens WHERE project_code IN ('10', '11') AND species_code = '710'
      AND length_millimeters IS NOT NULL""",
    "stat_to_area": """
    SELECT CASE WHEN n_name = 'NATION_13' THEN -s_suppkey ELSE s_suppkey END AS stat, r_name AS g_management_area_code
    FROM region_of_supplier""",
    "longline_bio": """
    SELECT year, 'Longline' AS Gear, 'Survey' AS Source, g_management_area_code AS Mgmt_area,
      species_code AS Spp_cde, length_millimeters / 10 AS length, weight_kilograms AS weight, age,
      sex AS Sex, maturity AS Maturity
    FROM specimens JOIN stat_to_area USING (stat)
    WHERE project_code IN ('601', '603') AND species_code = '710' AND length_millimeters IS NOT NULL""",
    "bio": """
    SELECT year, CASE WHEN project_code IN ('02', '601', '603') THEN 'Longline' ELSE 'Pot' END AS Gear,
      CASE WHEN project_code IN ('02', '17') THEN 'Fishery' ELSE 'Survey' END AS Source, area AS Mgmt_area,
      species_code AS Spp_cde, length_millimeters / 10 AS length, weight_kilograms AS weight, age,
      sex AS Sex, maturity AS Maturity
    FROM specimens""",
    "survey_hooks": """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
      CASE WHEN l_linenumber = 7 THEN '999' WHEN l_linenumber % 4 = 0 THEN '603'
           WHEN l_linenumber % 4 = 1 THEN '03' WHEN l_linenumber % 4 = 2 THEN '601' ELSE '01' END AS project_code,
      CAST(l_orderkey AS VARCHAR) AS trip_no, CAST(l_partkey AS VARCHAR) AS station_no,
      CAST(l_suppkey AS VARCHAR) AS adfg_no, l_linestatus AS vessel_name,
      l_shipdate AS time_first_buoy_onboard, CAST(l_suppkey AS VARCHAR) AS stat,
      l_linenumber AS effort_no, l_discount AS start_lat, l_tax AS start_lon,
      l_discount + 1 AS end_lat, l_tax + 1 AS end_lon, l_quantity AS avg_depth_fathoms,
      CAST(floor(l_extendedprice / 1000) AS INTEGER) + l_linenumber AS number_hooks,
      CASE WHEN l_linenumber <> 2 THEN 1 END AS bare, CASE WHEN l_linenumber <> 4 THEN 2 END AS bait,
      CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS invalid,
      CASE WHEN l_quantity <> 13 THEN CAST(l_quantity AS INTEGER) END AS sablefish,
      CASE l_returnflag WHEN 'A' THEN '02' WHEN 'R' THEN '01' END AS subset_condition_code
    FROM lineitem""",
    "stat_sizes": """
    SELECT CASE WHEN n_name = 'NATION_13' THEN -s_suppkey ELSE s_suppkey END AS Stat, r_name AS Mgmt_area,
      CAST(10 + s_suppkey AS DOUBLE) AS stat_km2
    FROM region_of_supplier""",
    "survey_effort": """
    SELECT h.year, project_code AS Project_cde, station_no AS Station_no, trip_no, adfg_no AS Adfg,
      vessel_name AS Vessel, CAST(time_first_buoy_onboard AS DATE) AS date,
      CAST(dayofyear(time_first_buoy_onboard) AS INTEGER) AS julian_day, h.stat AS Stat, effort_no AS set,
      start_lat, start_lon, end_lat, end_lon, avg_depth_fathoms * 1.8288 AS depth,
      number_hooks AS no_hooks, bare AS hooks_bare, bait AS hooks_bait, invalid AS hook_invalid,
      sablefish AS hooks_sablefish, subset_condition_code AS subset_condition_cde,
      s.Mgmt_area, s.stat_km2
    FROM survey_hooks h LEFT JOIN stat_sizes s ON h.stat IS NOT DISTINCT FROM CAST(s.Stat AS VARCHAR)
    WHERE project_code IN ('603', '03', '601', '01')
      AND h.year < (SELECT max(year) FROM survey_hooks WHERE project_code IN ('603', '03', '601', '01'))""",
    "survey_rates": """
    SELECT *, CASE WHEN year <= 1996 THEN 1.43e0 * sablefish_retained ELSE sablefish_retained END
        / nullif(std_hooks, 0) AS std_cpue
    FROM (SELECT *, 2.2e0 * net_hooks * (1 - exp(-0.57e0 * (CASE WHEN year <= 1996 THEN 118 WHEN year = 1997 THEN 72
            WHEN year IN (1998, 1999) THEN 64 ELSE 78 END * 0.0254e0))) AS std_hooks,
          coalesce(hooks_sablefish, 0) AS sablefish_retained
      FROM (SELECT *, no_hooks - coalesce(hook_invalid, 0) AS net_hooks
            FROM survey_effort WHERE subset_condition_cde <> '02'))""",
    "logbook_sets": f"""
    SELECT year, Mgmt_area, trip_no, Adfg, Spp_cde, CAST(time_set AS DATE) AS date,
      CAST(dayofyear(time_set) AS INTEGER) AS julian_day,
      CAST(epoch_us(time_hauled) - epoch_us(time_set) AS DOUBLE) / 1000000 / 3600 AS soak, Gear, Hook_size,
      TRY_CAST(nullif(regexp_replace(Hook_size, '[^0-9]', '', 'g'), '') AS DOUBLE) AS Size, hook_space, Stat,
      no_hooks, depth, sets, sable_lbs_set, start_lat, start_lon
    FROM (
      SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {sql_area("l_suppkey")} AS Mgmt_area,
        CAST(l_orderkey AS VARCHAR) AS trip_no, CAST(l_suppkey AS VARCHAR) AS Adfg, l_returnflag AS Spp_cde,
        l_shipdate AS time_set,
        l_shipdate + to_hours(CAST(l_quantity AS INTEGER) - 10) + to_minutes(l_linenumber) AS time_hauled,
        l_linestatus AS Gear,
        CASE WHEN l_linenumber = 3 THEN 'mixed' ELSE 'No. ' || (l_linenumber + 10) || '/0' END AS Hook_size,
        CAST(30 + 3 * l_linenumber AS DOUBLE) AS hook_space, CAST(l_suppkey AS VARCHAR) AS Stat,
        CAST(floor(l_extendedprice / 1000) AS INTEGER) AS no_hooks, l_quantity AS depth, l_linenumber AS sets,
        CASE WHEN l_quantity <> 13 THEN l_quantity END AS sable_lbs_set, l_discount AS start_lat, l_tax AS start_lon
      FROM lineitem)""",
    "fishery_rates": """
    SELECT *, sable_lbs_set / nullif(std_hooks, 0) AS std_cpue
    FROM (SELECT *, 2.2e0 * no_hooks * (1 - exp(-0.57e0 * (hook_space / 39.37e0))) AS std_hooks FROM logbook_sets)""",
}
NEEDS = {
    "stat_areas": ["region_of_supplier"],
    "landings_areas": ["landings", "stat_areas", "waters_updates"],
    "catch": ["landings_areas"],
    "catch_grid": ["catch"],
    "catch_year_area": ["catch_grid"],
    "clean_tickets": ["tickets"],
    "ticket_year_area": ["clean_tickets"],
    "fishery_bio": ["specimens"],
    "pot_bio": ["specimens"],
    "stat_to_area": ["region_of_supplier"],
    "longline_bio": ["specimens", "stat_to_area"],
    "bio": ["specimens"],
    "stat_sizes": ["region_of_supplier"],
    "survey_effort": ["survey_hooks", "stat_sizes"],
    "survey_rates": ["survey_effort"],
    "fishery_rates": ["logbook_sets"],
}


def ctes(*names: str) -> str:
    """A WITH clause that defines the named roles and all they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
