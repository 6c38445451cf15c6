"""Specimen pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bindings import roles
from bindings.registry import query
from bindings.roles import ctes
from haulmark.functions.measures import LENGTH_BINS
from haulmark.plans import biology as plans

S = SparkSession
COMBINED = {"Mgmt_area": "Areas_combined", "Sex": "Sex_combined"}
_AREA = "CASE WHEN grouping(Mgmt_area) = 1 THEN 'Areas_combined' ELSE Mgmt_area END AS Mgmt_area"
_SEX = "CASE WHEN grouping(Sex) = 1 THEN 'Sex_combined' ELSE Sex END AS Sex"


def _fishery(spark: S, sf: str) -> DataFrame:
    return plans.fishery_bio(roles.specimens(spark, sf), areas=roles.REGIONS)


def _pot(spark: S, sf: str) -> DataFrame:
    return plans.pot_survey_bio(roles.specimens(spark, sf), areas=roles.REGIONS)


def _longline(spark: S, sf: str) -> DataFrame:
    return plans.longline_survey_bio(roles.specimens(spark, sf), roles.stat_to_area(spark, sf))


@query(
    "bio_extract_clean",
    ctes("fishery_bio", "pot_bio") + " SELECT * FROM fishery_bio UNION ALL SELECT * FROM pot_bio",
)
def bio_extract_clean(spark: S, sf: str) -> DataFrame:
    return plans.stack_bio(_fishery(spark, sf), _pot(spark, sf))


@query("bio_extract_lookup", ctes("longline_bio") + " SELECT * FROM longline_bio")
def bio_extract_lookup(spark: S, sf: str) -> DataFrame:
    return _longline(spark, sf)


@query(
    "bio_sample_sizes",
    ctes("pot_bio") + " SELECT year, Mgmt_area, count(*) AS n FROM pot_bio GROUP BY 1, 2",
)
def bio_sample_sizes(spark: S, sf: str) -> DataFrame:
    return plans.sample_sizes(_pot(spark, sf))


@query(
    "bio_coverage",
    ctes("fishery_bio", "pot_bio", "longline_bio")
    + """
    SELECT Gear, Source, Mgmt_area, min(year) AS min_year, max(year) AS max_year, count(DISTINCT year) AS no_of_years
    FROM (SELECT * FROM fishery_bio UNION ALL SELECT * FROM pot_bio UNION ALL SELECT * FROM longline_bio)
    GROUP BY 1, 2, 3""",
)
def bio_coverage(spark: S, sf: str) -> DataFrame:
    return plans.bio_coverage(plans.stack_bio(_longline(spark, sf), _pot(spark, sf), _fishery(spark, sf)))


def _composition_sql(prefix: str, fish: str, inner: str, levels: str) -> str:
    stem = f"{prefix}by_gear_source"
    keys = "Source, Gear, year"
    group = "description, Source, Gear, Mgmt_area, Sex, year"
    return f"""{ctes("bio")},
    fish AS ({fish}),
    counted AS (
      SELECT CASE grouping(Mgmt_area) * 2 + grouping(Sex) WHEN 0 THEN '{stem}_area_sex' WHEN 1 THEN '{stem}_area'
               WHEN 2 THEN '{stem}_sex' ELSE '{stem}' END AS description, {keys}, {inner}, {_AREA}, {_SEX}, count(*) AS n
      FROM fish GROUP BY GROUPING SETS (({keys}, {inner}, Mgmt_area, Sex), ({keys}, {inner}, Mgmt_area),
        ({keys}, {inner}, Sex), ({keys}, {inner}))),
    shares AS (SELECT *, round_even(CAST(n * 10000 AS DOUBLE) / sum(n) OVER (PARTITION BY {group}), 0) / 10000 AS proportion FROM counted),
    cells AS (SELECT * FROM (SELECT DISTINCT {group} FROM shares) CROSS JOIN ({levels}))
    SELECT c.description, c.Source, c.Gear, c.Mgmt_area, c.Sex, c.year, c.{inner}, coalesce(s.n, 0) AS n,
      coalesce(s.proportion, 0) AS proportion
    FROM cells c LEFT JOIN shares s ON c.description = s.description AND c.Source = s.Source AND c.Gear = s.Gear
      AND c.Mgmt_area = s.Mgmt_area AND c.Sex IS NOT DISTINCT FROM s.Sex AND c.year = s.year AND c.{inner} = s.{inner}"""


@query(
    "age_composition",
    _composition_sql(
        "agecomp",
        """SELECT year, Gear, Source, Mgmt_area, Sex, CASE WHEN age >= 31 THEN 31 ELSE age END AS age FROM bio
           WHERE Sex IN ('Female', 'Male') AND age IS NOT NULL""",
        "age",
        "SELECT DISTINCT age FROM fish",
    ),
)
def age_composition(spark: S, sf: str) -> DataFrame:
    return plans.age_composition(roles.bio(spark, sf), combined=COMBINED)


@query(
    "length_composition",
    _composition_sql(
        "lengthcomp",
        """SELECT year, Gear, Source, Mgmt_area, Sex, CAST(CAST(41 + 2 * greatest(ceil(
             (least(greatest(round(length * 10), 410), 990) - 419) / 20.0), 0) AS INTEGER) AS VARCHAR) AS length_bin
           FROM bio WHERE length >= 40""",
        "length_bin",
        "SELECT * FROM (VALUES " + ", ".join(f"('{b}')" for b in LENGTH_BINS) + ") b(length_bin)",
    ),
)
def length_composition(spark: S, sf: str) -> DataFrame:
    return plans.length_composition(roles.bio(spark, sf), combined=COMBINED)


_GROUP = "description, Source, Gear, Mgmt_area, Sex, year"


@query(
    "proportion_mature",
    ctes("bio")
    + f""",
    staged AS (SELECT * FROM bio WHERE Maturity IS NOT NULL),
    counted AS (
      SELECT CASE WHEN grouping(Mgmt_area) = 0 THEN 'propmatureby_gear_source_area_sex_age'
               ELSE 'propmatureby_gear_source_sex_age' END AS description, Source, Gear, Sex, year, Maturity, age, {_AREA},
        count(*) AS n
      FROM staged GROUP BY GROUPING SETS ((Source, Gear, Sex, year, Maturity, age, Mgmt_area),
        (Source, Gear, Sex, year, Maturity, age))),
    shares AS (SELECT *, round_even(CAST(n * 10000 AS DOUBLE) / sum(n) OVER (PARTITION BY {_GROUP}), 0) / 10000 AS proportion FROM counted),
    mature AS (SELECT * FROM shares WHERE Maturity = 1),
    cells AS (SELECT * FROM (SELECT DISTINCT {_GROUP} FROM mature)
              CROSS JOIN (SELECT DISTINCT age FROM staged WHERE Maturity = 1))
    SELECT c.*, coalesce(m.n, 0) AS n, coalesce(m.proportion, 0) AS proportion
    FROM cells c LEFT JOIN mature m ON c.description = m.description AND c.Source = m.Source AND c.Gear = m.Gear
      AND c.Mgmt_area = m.Mgmt_area AND c.Sex IS NOT DISTINCT FROM m.Sex AND c.year = m.year
      AND c.age IS NOT DISTINCT FROM m.age""",
)
def proportion_mature(spark: S, sf: str) -> DataFrame:
    return plans.proportion_mature(roles.bio(spark, sf), COMBINED)


def _size_sql(measure: str, where: str) -> str:
    keys = "Gear, Source, Sex, year, age"
    known = f"CASE WHEN count(*) = count({measure}) THEN"
    unit = f"CAST(round({measure} * 1000000) AS BIGINT)"
    mean = f"CAST(sum({unit}) AS BIGINT) / (count(*) * 100000e0)"
    spread = f"CAST(count(*) * sum({unit} * {unit}) - sum({unit}) * sum({unit}) AS DOUBLE)"
    sd = f"sqrt({spread} / nullif(CAST(count(*) AS DOUBLE) * (count(*) - 1), 0)) / 100000"
    return f"""{ctes("bio")}
    SELECT CASE WHEN grouping(Mgmt_area) = 0 THEN '{measure}ageby_gear_source_area_year_sex'
             ELSE '{measure}ageby_gear_source_year_sex' END AS description, {keys}, {_AREA},
      {known} round_even({mean}, 0) / 10 END AS mean_{measure},
      {known} round_even({sd}, 0) / 10 END AS sd_{measure}, count(*) AS n
    FROM bio WHERE {where} GROUP BY GROUPING SETS (({keys}, Mgmt_area), ({keys}))"""


@query("length_at_age", _size_sql("length", "age IS NOT NULL"))
def length_at_age(spark: S, sf: str) -> DataFrame:
    return plans.length_at_age(roles.bio(spark, sf), COMBINED)


@query("weight_at_age", _size_sql("weight", "weight IS NOT NULL AND age IS NOT NULL"))
def weight_at_age(spark: S, sf: str) -> DataFrame:
    return plans.weight_at_age(roles.bio(spark, sf), COMBINED)
