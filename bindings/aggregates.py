"""Aggregates, windows, grids and series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import roles
from bindings.registry import query
from bindings.roles import AREAS, GEARS, area_of, ctes, sql_area, sql_values, table
from haulmark.functions.measures import ratio, round_even
from haulmark.functions.nulls import (
    distinct_with_null,
    row_count,
    strict_max,
    strict_min,
)
from haulmark.operators import totals
from haulmark.operators.grid import complete, complete_global
from haulmark.operators.levels import by_levels, count_rows, mean_sd_by_levels
from haulmark.operators.series import interpolate_gaps, tick_labels
from haulmark.operators.stats import rate_summary, share_of_total
from haulmark.plans.landings import SPECIES, catch_by_year_area, catch_by_year_area_gear

S = SparkSession


@query(
    "agg_sum_by",
    """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS gear, l_linenumber,
      CASE WHEN count(*) = count(q) THEN CAST(sum(CAST(q AS DECIMAL(18, 4))) AS DOUBLE) END AS strict_total,
      CAST(sum(CAST(q AS DECIMAL(18, 4))) AS DOUBLE) AS total
    FROM (SELECT *, CASE WHEN l_linenumber > 5 THEN l_quantity ELSE nullif(l_quantity, 13) END AS q FROM lineitem)
    GROUP BY ALL""",
)
def agg_sum_by(spark: S, sf: str) -> DataFrame:
    pounds = F.when(F.col("l_linenumber") > 5, F.col("l_quantity")).otherwise(
        F.nullif(F.col("l_quantity"), F.lit(13.0))
    )
    rows = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("gear"), "l_linenumber", pounds.alias("q")
    )
    by = ["year", "gear", "l_linenumber"]
    parts = totals.exact_parts(rows, by, "q")
    return totals.exact_totals(parts, by, strict_total=totals.total(strictly=True), total=totals.total())


@query(
    "agg_sum_fine",
    """
    SELECT l_returnflag AS gear, l_linestatus AS area,
      CAST(sum(CAST(l_quantity / 1000000 AS DECIMAL(38, 12))) AS DOUBLE) AS small,
      CAST(sum(CAST(l_partkey / 100000000 AS DECIMAL(38, 12))) AS DOUBLE) AS smaller
    FROM lineitem GROUP BY ALL""",
)
def agg_sum_fine(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumns({"gear": F.col("l_returnflag"), "area": F.col("l_linestatus")})
    small = {"small": F.col("l_quantity") / 1000000, "smaller": F.col("l_partkey") / 100000000}
    return totals.exact_sums(rows, ["gear", "area"], small)


# Powers of two, so that each value is a double: 1e-13 to 1e14, one magnitude a line number.
_POWER = "(l_linenumber * 14 - 57)"


def _magnitudes(spark: S, sf: str) -> DataFrame:
    power = F.pow(F.lit(2.0), F.col("l_linenumber") * 14 - 57)
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("gear"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") * power).alias("x")
    )


@query(
    "agg_any_magnitude",
    f"""
    SELECT l_returnflag AS gear, l_linenumber AS line, s * pow(2e0, {_POWER}) AS total, s * pow(2e0, {_POWER}) / n AS mean,
      sqrt(CAST(n * ss - s * s AS DOUBLE) / (n * (n - 1))) * pow(2e0, {_POWER}) AS sd, n
    FROM (SELECT l_returnflag, l_linenumber, sum(CAST(l_quantity AS BIGINT))::BIGINT AS s,
            sum(CAST(l_quantity * l_quantity AS BIGINT))::BIGINT AS ss, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def agg_any_magnitude(spark: S, sf: str) -> DataFrame:
    by = ["gear", "line"]
    parts = totals.exact_parts(_magnitudes(spark, sf), by, "x", spread=True)
    return totals.exact_totals(
        parts, by, total=totals.total(), mean=totals.mean(), sd=totals.sd(), n=totals.rows()
    )


@query(
    "agg_mixed_magnitudes",
    """
    SELECT l_returnflag AS gear,
      CAST(sum(CAST(l_quantity AS DECIMAL(38, 0)) * CAST(CAST(1 AS HUGEINT) << (l_linenumber * 14 - 14) AS DECIMAL(38, 0))) AS DOUBLE)
        * pow(2e0, -43) AS total FROM lineitem GROUP BY 1""",
)
def agg_mixed_magnitudes(spark: S, sf: str) -> DataFrame:
    return totals.exact_total(_magnitudes(spark, sf), ["gear"], "x", "total")


@query(
    "agg_count_by",
    """
    SELECT nullif(l_returnflag, 'N') AS Sex, l_linestatus AS Gear, CAST(year(l_shipdate) AS INTEGER) AS year,
      count(*) AS n FROM lineitem GROUP BY ALL""",
)
def agg_count_by(spark: S, sf: str) -> DataFrame:
    return count_rows(
        table(spark, sf, "lineitem").select(
            F.nullif(F.col("l_returnflag"), F.lit("N")).alias("Sex"),
            F.col("l_linestatus").alias("Gear"),
            F.year("l_shipdate").alias("year"),
        ),
        ["Sex", "Gear", "year"],
    )


@query(
    "agg_rowcount",
    """
    SELECT l_linestatus, count(*) AS n, count(q) AS n_known
    FROM (SELECT l_linestatus, nullif(l_quantity, 13) AS q FROM lineitem) GROUP BY 1""",
)
def agg_rowcount(spark: S, sf: str) -> DataFrame:
    known = F.nullif(F.col("l_quantity"), F.lit(13.0))
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_linestatus")
        .agg(row_count().alias("n"), F.count(known).alias("n_known"))
    )


@query(
    "agg_mean_sd",
    """
    SELECT l_suppkey, l_linenumber,
      CASE WHEN count(*) = count(q) THEN round_even(avg(q), 1) END AS mean_strict,
      CASE WHEN count(*) = count(q) THEN round_even(stddev_samp(q), 1) END AS sd_strict,
      round_even(avg(q), 2) AS mean_known, round_even(stddev_samp(q), 2) AS sd_known
    FROM (SELECT *, nullif(l_quantity, 13) AS q FROM lineitem) GROUP BY 1, 2""",
)
def agg_mean_sd(spark: S, sf: str) -> DataFrame:
    by = ["l_suppkey", "l_linenumber"]
    known = F.nullif(F.col("l_quantity"), F.lit(13.0))
    return totals.exact_totals(
        totals.exact_parts(table(spark, sf, "lineitem"), by, known, spread=True),
        by,
        mean_strict=totals.mean(1, strictly=True),
        sd_strict=totals.sd(1, strictly=True),
        mean_known=totals.mean(2),
        sd_known=totals.sd(2),
    )


@query(
    "agg_se_cv_rse",
    """
    SELECT *, round_even(sd / nullif(rate, 0), 2) AS CV, round_even(se / nullif(rate, 0), 2) AS RSE
    FROM (SELECT *, round_even(sd / sqrt(n), 4) AS se
      FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS Mgmt_area,
              round_even(avg(q), 2) AS rate, round_even(stddev_samp(q), 2) AS sd, count(*) AS n
            FROM (SELECT *, nullif(l_quantity, 13) AS q FROM lineitem) GROUP BY 1, 2))""",
)
def agg_se_cv_rse(spark: S, sf: str) -> DataFrame:
    rates = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.col("l_returnflag").alias("Mgmt_area"),
        F.nullif(F.col("l_quantity"), F.lit(13.0)).alias("q"),
    )
    return rate_summary(rates, "q", ["year", "Mgmt_area"], "rate")


@query(
    "agg_coverage",
    """
    SELECT l_returnflag AS Gear, l_linestatus AS Source,
      CASE WHEN count(*) = count(y) THEN min(y) END AS min_year, CASE WHEN count(*) = count(y) THEN max(y) END AS max_year,
      count(DISTINCT y) + max(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS no_of_years, count(*) AS n
    FROM (SELECT *, CASE WHEN l_returnflag = 'A' AND year(l_shipdate) = 1997 THEN NULL
                    ELSE CAST(year(l_shipdate) AS INTEGER) END AS y FROM lineitem) GROUP BY 1, 2""",
)
def agg_coverage(spark: S, sf: str) -> DataFrame:
    year = F.year("l_shipdate")
    known = F.when((F.col("l_returnflag") == "A") & (year == 1997), F.lit(None)).otherwise(year)
    return (
        table(spark, sf, "lineitem")
        .select(F.col("l_returnflag").alias("Gear"), F.col("l_linestatus").alias("Source"), known.alias("year"))
        .groupBy("Gear", "Source")
        .agg(
            strict_min("year").alias("min_year"),
            strict_max("year").alias("max_year"),
            distinct_with_null("year").alias("no_of_years"),
            row_count().alias("n"),
        )
    )


@query("agg_rollup_level", ctes("catch_year_area") + " SELECT * FROM catch_year_area")
def agg_rollup_level(spark: S, sf: str) -> DataFrame:
    landed = roles.landings(spark, sf)
    grid = catch_by_year_area_gear(
        landed.filter(F.col("species_code") == SPECIES),
        roles.stat_areas(spark, sf),
        roles.waters_updates(spark, sf),
        AREAS,
        GEARS,
    )
    return catch_by_year_area(grid)


_FISH = """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS Mgmt_area, nullif(l_returnflag, 'N') AS Sex,
      CAST(l_quantity AS INTEGER) AS age, l_extendedprice AS price FROM lineitem"""


def _fish(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.col("l_linestatus").alias("Mgmt_area"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("Sex"),
        F.col("l_quantity").cast("int").alias("age"),
    )


@query(
    "agg_grouping_sets_labels",
    f"""
    WITH fish AS ({_FISH})
    SELECT CASE grouping(Mgmt_area) * 2 + grouping(Sex) WHEN 0 THEN 'by_area_sex' WHEN 1 THEN 'by_area'
             WHEN 2 THEN 'by_sex' ELSE 'by_none' END AS description, year, age,
      CASE WHEN grouping(Mgmt_area) = 1 THEN 'combined' ELSE Mgmt_area END AS Mgmt_area,
      CASE WHEN grouping(Sex) = 1 THEN 'Sex_combined' ELSE Sex END AS Sex, count(*) AS n
    FROM fish GROUP BY GROUPING SETS
      ((year, age, Mgmt_area, Sex), (year, age, Mgmt_area), (year, age, Sex), (year, age))""",
)
def agg_grouping_sets_labels(spark: S, sf: str) -> DataFrame:
    fine = count_rows(_fish(spark, sf), ["year", "age", "Mgmt_area", "Sex"])
    levels = {"by_area_sex": ["Mgmt_area", "Sex"], "by_area": ["Mgmt_area"], "by_sex": ["Sex"], "by_none": []}
    combined = {"Mgmt_area": "combined", "Sex": "Sex_combined"}
    return by_levels(fine, ["year", "age"], combined, levels, {"n": F.sum("n")})


@query(
    "agg_two_level_stats",
    f"""
    SELECT CASE WHEN grouping(a) = 0 THEN 'by_area' ELSE 'combined' END AS description,
      CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN grouping(a) = 1 THEN 'all' ELSE a END AS Mgmt_area,
      round_even(sum(l_quantity) * 10 / count(*), 0) / 10 AS mean_l_quantity,
      round_even(stddev_samp(l_quantity), 1) AS sd_l_quantity, count(*) AS n
    FROM (SELECT *, {sql_area("l_suppkey")} AS a FROM lineitem)
    GROUP BY GROUPING SETS ((year(l_shipdate), a), (year(l_shipdate)))""",
)
def agg_two_level_stats(spark: S, sf: str) -> DataFrame:
    fish = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), area_of("l_suppkey").alias("Mgmt_area"), "l_quantity"
    )
    levels = {"by_area": ["Mgmt_area"], "combined": []}
    return mean_sd_by_levels(fish, "l_quantity", ["year"], {"Mgmt_area": "all"}, levels)


@query(
    "win_share_of_total",
    f"""
    WITH fish AS ({_FISH}), c AS (SELECT year, Mgmt_area, Sex, age, count(*) AS n FROM fish GROUP BY ALL)
    SELECT *, round_even(CAST(n * 10000 AS DOUBLE) / sum(n) OVER (PARTITION BY year, Mgmt_area, Sex), 0) / 10000 AS proportion FROM c""",
)
def win_share_of_total(spark: S, sf: str) -> DataFrame:
    counts = count_rows(_fish(spark, sf), ["year", "Mgmt_area", "Sex", "age"])
    return share_of_total(counts, "n", ["year", "Mgmt_area", "Sex"])


@query(
    "flt_after_agg",
    f"""
    WITH fish AS ({_FISH}), c AS (SELECT year, Mgmt_area, Sex, age, count(*) AS n FROM fish GROUP BY ALL)
    SELECT * FROM (SELECT *, round_even(CAST(n * 10000 AS DOUBLE) / sum(n) OVER (PARTITION BY year, Mgmt_area), 0) / 10000 AS share FROM c)
    WHERE Sex = 'A' AND year >= 1997""",
)
def flt_after_agg(spark: S, sf: str) -> DataFrame:
    counts = count_rows(_fish(spark, sf), ["year", "Mgmt_area", "Sex", "age"])
    shares = share_of_total(counts, "n", ["year", "Mgmt_area"], name="share")
    return shares.filter((F.col("Sex") == "A") & (F.col("year") >= 1997))


# Gears that land in some areas only, and one that stops after a year, leave cells to add.
_GRID_COUNTS = """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
      CASE WHEN year(l_shipdate) = 1998 AND l_returnflag = 'R' THEN 'N' ELSE l_returnflag END AS gear,
      CASE WHEN l_returnflag = 'A' THEN 'O' ELSE l_linestatus END AS area, count(*) AS n
    FROM lineitem GROUP BY ALL"""


def _grid_counts(spark: S, sf: str) -> DataFrame:
    year = F.year("l_shipdate")
    rows = table(spark, sf, "lineitem").select(
        year.alias("year"),
        F.when((year == 1998) & (F.col("l_returnflag") == "R"), "N").otherwise(F.col("l_returnflag")).alias("gear"),
        F.when(F.col("l_returnflag") == "A", "O").otherwise(F.col("l_linestatus")).alias("area"),
    )
    return count_rows(rows, ["year", "gear", "area"])


@query(
    "complete_global_levels",
    f"""
    WITH c AS ({_GRID_COUNTS})
    SELECT y.year, gear, area, coalesce(n, 0) AS n FROM (SELECT DISTINCT year FROM c) y
    CROSS JOIN {sql_values(["A", "R", "N", "X"], "gear")} CROSS JOIN {sql_values(["F", "O", "Q"], "area")}
    LEFT JOIN c USING (year, gear, area)""",
)
def complete_global_levels(spark: S, sf: str) -> DataFrame:
    levels = {"gear": ["A", "R", "N", "X"], "area": ["F", "O", "Q"]}
    return complete_global(_grid_counts(spark, sf), ["year", "gear", "area"], levels, {"n": 0})


@query(
    "complete_multi_fill",
    f"""
    WITH c AS (SELECT *, round_even(CAST(n * 10000 AS DOUBLE) / sum(n) OVER (PARTITION BY year), 0) / 10000 AS proportion
               FROM ({_GRID_COUNTS}))
    SELECT year, gear, area, coalesce(n, 0) AS n, coalesce(proportion, 0) AS proportion
    FROM (SELECT DISTINCT year FROM c) CROSS JOIN (SELECT DISTINCT gear FROM c) CROSS JOIN (SELECT DISTINCT area FROM c)
    LEFT JOIN c USING (year, gear, area)""",
)
def complete_multi_fill(spark: S, sf: str) -> DataFrame:
    shares = share_of_total(_grid_counts(spark, sf), "n", ["year"])
    return complete_global(shares, ["year", "gear", "area"], fill={"n": 0, "proportion": 0.0}, count="n")


@query(
    "complete_within_group",
    f"""
    WITH c AS ({_GRID_COUNTS})
    SELECT k.year, k.gear, area, coalesce(n, 0) AS n FROM (SELECT DISTINCT year, gear FROM c) k
    CROSS JOIN {sql_values(["F", "O", "Q"], "area")} LEFT JOIN c USING (year, gear, area)""",
)
def complete_within_group(spark: S, sf: str) -> DataFrame:
    return complete(_grid_counts(spark, sf), ["year", "gear"], {"area": ["F", "O", "Q"]}, {"n": 0})


@query(
    "interpolate_gaps",
    """
    WITH m AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS series,
                 CASE WHEN year(l_shipdate) NOT IN (1997, 1998, 2001)
                   THEN CAST(sum(CAST(l_quantity AS DECIMAL(18, 4))) AS DOUBLE) / count(*) END AS value
               FROM lineitem GROUP BY 1, 2, year(l_shipdate)),
    b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN year END IGNORE NULLS) OVER p AS x0,
            last_value(value IGNORE NULLS) OVER p AS y0,
            first_value(CASE WHEN value IS NOT NULL THEN year END IGNORE NULLS) OVER f AS x1,
            first_value(value IGNORE NULLS) OVER f AS y1
          FROM m WINDOW p AS (PARTITION BY series ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            f AS (PARTITION BY series ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT year, series, CASE WHEN value IS NOT NULL THEN value
      WHEN x1 > x0 THEN y0 + (year - x0) * ((y1 - y0) / (x1 - x0)) END AS value FROM b""",
)
def interpolate_gaps_query(spark: S, sf: str) -> DataFrame:
    dated = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("series"), "l_quantity"
    )
    by = ["year", "series"]
    yearly = totals.exact_totals(
        totals.exact_parts(dated, by, "l_quantity"), by, value=ratio(totals.total(), totals.rows())
    )
    gaps = yearly.withColumn("value", F.when(~F.col("year").isin(1997, 1998, 2001), F.col("value")))
    return interpolate_gaps(gaps, ["series"], "year", "value")


@query(
    "tick_labels",
    """
    WITH v AS (SELECT DISTINCT p_size AS breaks FROM part),
    s AS (SELECT CAST(5 * round_even(min(breaks) / 5, 0) AS BIGINT) AS start FROM v)
    SELECT breaks, CASE WHEN breaks >= start AND (breaks - start) % 5 = 0 THEN CAST(breaks AS VARCHAR) ELSE '' END AS labels
    FROM v, s""",
)
def tick_labels_query(spark: S, sf: str) -> DataFrame:
    return tick_labels(table(spark, sf, "part"), "p_size", 5)
