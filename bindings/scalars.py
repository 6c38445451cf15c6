"""Scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.registry import query
from bindings.roles import GEARS, sql_map, table
from haulmark.functions.categories import map_codes
from haulmark.functions.dates import day_of_year, hours_between, utc_date
from haulmark.functions.measures import (
    clamp,
    depth_stratum,
    fathoms_to_meters,
    fishery_inches_to_meters,
    length_bin,
    millimeters_to_centimeters,
    plus_group,
    pounds_to_tonnes,
    ratio,
    round_even,
    soak_adjusted,
    spacing_by_year,
    standard_hooks,
    survey_inches_to_meters,
)
from haulmark.functions.nulls import null_to, zero_fallback
from haulmark.functions.text import digits_to_number, prefixed_label

S = SparkSession


@query(
    "map_codes_to_label",
    f"""SELECT l_orderkey, l_returnflag || l_linestatus AS gear_code,
      {sql_map("l_returnflag || l_linestatus", GEARS)} AS gear FROM lineitem""",
)
def map_codes_to_label(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("gear_code")
    )
    return rows.withColumn("gear", map_codes("gear_code", GEARS))


@query(
    "map_codes_default_null",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '0'
      WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN '1' END AS Maturity FROM orders""",
)
def map_codes_default_null(spark: S, sf: str) -> DataFrame:
    codes = {"0": ["1-URGENT", "2-HIGH"], "1": ["3-MEDIUM", "4-NOT SPECIFIED"]}
    return table(spark, sf, "orders").select(
        "o_orderkey", map_codes("o_orderpriority", codes).alias("Maturity")
    )


@query(
    "zero_fallback",
    """SELECT l_orderkey, CASE WHEN w = 0 THEN l_tax ELSE w END AS weight
      FROM (SELECT *, nullif(l_discount, 0.05) AS w FROM lineitem)""",
)
def zero_fallback_query(spark: S, sf: str) -> DataFrame:
    whole = F.nullif(F.col("l_discount"), F.lit(0.05))
    return table(spark, sf, "lineitem").select("l_orderkey", zero_fallback(whole, "l_tax").alias("weight"))


@query(
    "null_to_zero",
    "SELECT l_orderkey, coalesce(nullif(l_linenumber, 3), 0) AS hook_invalid FROM lineitem",
)
def null_to_zero(spark: S, sf: str) -> DataFrame:
    invalid = F.nullif(F.col("l_linenumber"), F.lit(3))
    return table(spark, sf, "lineitem").select("l_orderkey", null_to(invalid, 0).alias("hook_invalid"))


@query(
    "plus_group",
    """SELECT l_orderkey, CASE WHEN age >= 31 THEN 31 ELSE age END AS age
      FROM (SELECT l_orderkey, nullif(CAST(l_quantity AS INTEGER), 13) AS age FROM lineitem)""",
)
def plus_group_query(spark: S, sf: str) -> DataFrame:
    age = F.nullif(F.col("l_quantity").cast("int"), F.lit(13))
    return table(spark, sf, "lineitem").select("l_orderkey", plus_group(age, 31).alias("age"))


@query(
    "clamp",
    """SELECT p_partkey, CASE WHEN x < 41 THEN 41 WHEN x > 99 THEN 99 ELSE x END AS length2
      FROM (SELECT p_partkey, CASE WHEN p_size <> 13 THEN CAST(180 + 21 * p_size AS DOUBLE) / 10 END AS x FROM part)""",
)
def clamp_query(spark: S, sf: str) -> DataFrame:
    length = F.when(F.col("p_size") != 13, millimeters_to_centimeters(180 + 21 * F.col("p_size")))
    return table(spark, sf, "part").select("p_partkey", clamp(length, 41.0, 99.0).alias("length2"))


@query(
    "bin_right_closed",
    """SELECT p_partkey, length, CASE WHEN mm IS NOT NULL THEN
        CAST(CAST(41 + 2 * greatest(ceil((least(greatest(mm, 410), 990) - 419) / 20.0), 0) AS INTEGER) AS VARCHAR)
      END AS length_bin
      FROM (SELECT p_partkey, CASE WHEN p_size <> 13 THEN CAST(180 + 21 * p_size AS DOUBLE) / 10 END AS length,
        CASE WHEN p_size <> 13 THEN 180 + 21 * p_size END AS mm FROM part)""",
)
def bin_right_closed_query(spark: S, sf: str) -> DataFrame:
    length = F.when(F.col("p_size") != 13, millimeters_to_centimeters(180 + 21 * F.col("p_size")))
    return (
        table(spark, sf, "part")
        .select("p_partkey", length.alias("length"))
        .withColumn("length_bin", length_bin("length"))
    )


@query(
    "era_lookup",
    """SELECT l_orderkey, year, CASE WHEN year <= 1996 THEN 118 WHEN year = 1997 THEN 72
        WHEN year IN (1998, 1999) THEN 64 WHEN year IS NOT NULL THEN 78 END AS spacing_inches
      FROM (SELECT l_orderkey, nullif(CAST(year(l_shipdate) AS INTEGER), 1995) AS year FROM lineitem)""",
)
def era_lookup(spark: S, sf: str) -> DataFrame:
    year = F.nullif(F.year("l_shipdate"), F.lit(1995))
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", year.alias("year"))
        .withColumn("spacing_inches", spacing_by_year("year"))
    )


@query(
    "std_effort",
    """SELECT l_orderkey,
      round_even(2.2e0 * l_quantity * (1 - exp(-0.57e0 * (78 * 0.0254e0))), 6) AS survey_hooks,
      round_even(2.2e0 * l_quantity * (1 - exp(-0.57e0 * ((30 + 3 * l_linenumber) / 39.37e0))), 6) AS fishery_hooks
      FROM lineitem""",
)
def std_effort(spark: S, sf: str) -> DataFrame:
    survey = standard_hooks("l_quantity", survey_inches_to_meters(F.lit(78)))
    fishery = standard_hooks("l_quantity", fishery_inches_to_meters(30 + 3 * F.col("l_linenumber")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        round_even(survey, 6).alias("survey_hooks"),
        round_even(fishery, 6).alias("fishery_hooks"),
    )


@query(
    "std_cpue",
    """SELECT l_orderkey, CASE WHEN year <= 1996 THEN 1.43e0 * l_quantity WHEN year > 1996 THEN l_quantity END
        / nullif(l_tax, 0) AS std_cpue
      FROM (SELECT *, nullif(year(l_shipdate), 1999) AS year FROM lineitem)""",
)
def std_cpue(spark: S, sf: str) -> DataFrame:
    year = F.nullif(F.year("l_shipdate"), F.lit(1999))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", ratio(soak_adjusted("l_quantity", year), "l_tax").alias("std_cpue")
    )


@query(
    "unit_convert",
    """SELECT l_orderkey, l_extendedprice * 0.000453592e0 AS whole_mt, l_quantity / 10 AS cm,
      l_quantity * 1.8288e0 AS meters, l_quantity * 0.0254e0 AS survey_meters, l_quantity / 39.37e0 AS fishery_meters
      FROM lineitem""",
)
def unit_convert(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        pounds_to_tonnes("l_extendedprice").alias("whole_mt"),
        millimeters_to_centimeters("l_quantity").alias("cm"),
        fathoms_to_meters("l_quantity").alias("meters"),
        survey_inches_to_meters("l_quantity").alias("survey_meters"),
        fishery_inches_to_meters("l_quantity").alias("fishery_meters"),
    )


@query(
    "date_parts",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(dayofyear(ts) AS INTEGER) AS julian_day FROM events""",
)
def date_parts(spark: S, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    day = utc_date(events, "ts")
    date = day.cast("string").alias("date")
    return events.select("event_id", date, day_of_year(day).alias("julian_day"))


@query(
    "duration_hours",
    """SELECT event_id, CAST(epoch_us(ts) - epoch_us(time_set) AS DOUBLE) / 1000000 / 3600 AS soak,
      CAST(epoch_us(time_set) - epoch_us(ts) AS DOUBLE) / 1000000 / 3600 AS reversed
      FROM (SELECT event_id, ts, date_trunc('month', ts) AS time_set FROM events)""",
)
def duration_hours(spark: S, sf: str) -> DataFrame:
    sets = table(spark, sf, "events").select(
        "event_id", "ts", F.make_timestamp_ntz(F.year("ts"), F.month("ts"), *[F.lit(1)] + [F.lit(0)] * 3).alias("time_set")
    )
    return sets.select(
        "event_id", hours_between("time_set", "ts").alias("soak"), hours_between("ts", "time_set").alias("reversed")
    )


@query(
    "digits_to_number",
    """SELECT p_partkey, TRY_CAST(nullif(regexp_replace(t, '[^0-9]', '', 'g'), '') AS DOUBLE) AS Size
      FROM (SELECT p_partkey, CASE WHEN p_size = 13 THEN 'mixed' ELSE p_brand END AS t FROM part)""",
)
def digits_to_number_query(spark: S, sf: str) -> DataFrame:
    text = F.when(F.col("p_size") == 13, "mixed").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", digits_to_number(text).alias("Size"))


@query(
    "label_concat",
    """SELECT o_orderkey, 'NPUE_' || coalesce(nullif(o_orderstatus, 'P'), 'NA') AS description FROM orders""",
)
def label_concat(spark: S, sf: str) -> DataFrame:
    area = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, sf, "orders").select("o_orderkey", prefixed_label("NPUE_", area).alias("description"))


@query(
    "depth_strata",
    """SELECT p_partkey, p_size * 22 AS depth, CASE WHEN p_size * 22 BETWEEN 201 AND 300 THEN 3
      WHEN p_size * 22 BETWEEN 301 AND 400 THEN 4 WHEN p_size * 22 BETWEEN 401 AND 600 THEN 5
      WHEN p_size * 22 BETWEEN 601 AND 800 THEN 6 WHEN p_size * 22 BETWEEN 801 AND 1000 THEN 7 END AS stratum
      FROM part""",
)
def depth_strata(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") * 22).alias("depth"),
        depth_stratum(F.col("p_size") * 22).alias("stratum"),
    )
