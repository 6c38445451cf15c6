"""Effort pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import roles
from bindings.registry import query
from bindings.roles import ctes
from haulmark.operators.stats import effort_span
from haulmark.plans import effort as plans

S = SparkSession
LEGACY = {
    "AFRICA": (1991, [0.719, 0.98, 1.24, 1.521]),
    "ASIA": (1993, [0.232, 0.28]),
}


_DATED = " SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM {} WHERE {}"


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text, which every client compares alike."""
    return df.withColumn("date", F.col("date").cast("string"))


def _survey(spark: S, sf: str) -> DataFrame:
    return plans.survey_effort(roles.survey_hooks(spark, sf), roles.stat_sizes(spark, sf))


def _index_sql(rates: str, value: str, label: str, where: str = "TRUE") -> str:
    return f"""
    SELECT year AS Year, rate AS Value, round_even(se / nullif(rate, 0), 2) AS CV,
      '{label}' || coalesce(Mgmt_area, 'NA') AS description
    FROM (SELECT *, round_even(sd / sqrt(n), 4) AS se FROM (
      SELECT year, Mgmt_area, round_even(avg({value}), 2) AS rate, round_even(stddev_samp({value}), 2) AS sd,
        count(*) AS n FROM {rates} WHERE {where} GROUP BY 1, 2))"""


_SURVEY_INDEX = _index_sql("survey_rates", "std_cpue", "SRV_", "year >= 1997")
_FISHERY_INDEX = (
    _index_sql("fishery_rates", "std_cpue", "FSH_")
    + " UNION ALL SELECT CAST(y AS INTEGER), CAST(v AS DOUBLE), NULL, 'FSH_' || a FROM (VALUES "
    + ", ".join(
        f"('{a}', {first + i}, {v}e0)" for a, (first, vs) in LEGACY.items() for i, v in enumerate(vs)
    )
    + ") l(a, y, v)"
)


@query("effort_extract", ctes("survey_effort") + _DATED.format("survey_effort", "TRUE"))
def effort_extract(spark: S, sf: str) -> DataFrame:
    return _dated(_survey(spark, sf))


@query(
    "effort_span",
    ctes("survey_effort")
    + """
    SELECT Project_cde, count(*) AS n, min(year) AS min_yr, max(year) AS max_yr FROM survey_effort GROUP BY 1""",
)
def effort_span_query(spark: S, sf: str) -> DataFrame:
    return effort_span(_survey(spark, sf), ["Project_cde"])


@query(
    "logbook_extract",
    ctes("logbook_sets") + _DATED.format("logbook_sets", "Mgmt_area IN ('AFRICA', 'ASIA')"),
)
def logbook_extract(spark: S, sf: str) -> DataFrame:
    return _dated(plans.logbook_effort(roles.logbook_sets(spark, sf), ["AFRICA", "ASIA"]))


@query("survey_npue_index", ctes("survey_rates") + _SURVEY_INDEX)
def survey_npue_index(spark: S, sf: str) -> DataFrame:
    return plans.survey_npue_of_hooks(roles.survey_hooks(spark, sf), roles.stat_sizes(spark, sf), label="SRV_")


@query("fishery_wpue_index", ctes("fishery_rates") + _FISHERY_INDEX)
def fishery_wpue_index(spark: S, sf: str) -> DataFrame:
    legacy = plans.legacy_wpue(spark, LEGACY)
    sets = plans.logbook_effort(roles.logbook_sets(spark, sf), roles.REGIONS)
    return plans.fishery_wpue_index(sets, legacy, "FSH_")


@query("cpue_index", ctes("survey_rates", "fishery_rates") + _SURVEY_INDEX + " UNION ALL " + _FISHERY_INDEX)
def cpue_index(spark: S, sf: str) -> DataFrame:
    return plans.cpue_indices(survey_npue_index(spark, sf), fishery_wpue_index(spark, sf))


@query(
    "rpn_index",
    ctes("survey_rates", "stat_sizes")
    + """,
    per_stat AS (SELECT year, Mgmt_area, Stat, sum(std_cpue) AS s, count(std_cpue) AS n,
                   round_even(sum(std_cpue) / count(std_cpue), 2) AS npue FROM survey_rates GROUP BY 1, 2, 3)
    SELECT year, p.Mgmt_area, CASE WHEN count(*) = count(npue * z.stat_km2)
        THEN round_even(CAST(sum(CAST(npue * z.stat_km2 AS DECIMAL(18, 4))) AS DOUBLE), 2) END AS RPN,
      round_even(sum(s) / sum(n), 2) AS NPUE
    FROM per_stat p LEFT JOIN stat_sizes z ON p.Stat = CAST(z.Stat AS VARCHAR) GROUP BY 1, 2""",
)
def rpn_index(spark: S, sf: str) -> DataFrame:
    return plans.rpn_of_hooks(roles.survey_hooks(spark, sf), roles.stat_sizes(spark, sf))
