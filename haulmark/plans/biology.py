"""Specimen pipelines: extracts, compositions, maturity and size at age."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.categories import map_codes
from haulmark.functions.measures import (
    LENGTH_BINS,
    length_bin,
    millimeters_to_centimeters,
    plus_group,
)
from haulmark.functions.nulls import row_count
from haulmark.operators.grid import complete, present_levels
from haulmark.operators.joins import lookup_join
from haulmark.operators.levels import by_levels, count_rows, mean_sd_by_levels
from haulmark.operators.rows import outside, stack
from haulmark.operators.stats import coverage, share_of_total
from haulmark.sources.readers import scan

# Codes and labels of the published specimen tables.
SPECIES = "710"
SEX_CODES = {"Male": ["01"], "Female": ["02"]}
MATURITY_CODES = {"0": ["01", "02"], "1": ["03", "04", "05", "06", "07"]}
FISHERY_GEARS = {"Pot": ["17"], "Longline": ["02"]}
FISHERY_PROJECTS = ["02", "17"]
POT_SURVEY_PROJECTS = ["10", "11"]
LONGLINE_SURVEY_PROJECTS = ["601", "603"]
LENGTH_RANGE = (20, 120)
PLUS_AGE = 31
SHORTEST_BINNED = 40
COMBINED = {"Mgmt_area": "NSEI_SSEI_combined", "Sex": "Sex_combined"}
COLUMNS = [
    "year", "Gear", "Source", "Mgmt_area", "Spp_cde", "length", "weight", "age", "Sex", "Maturity",
]


def bio_scan(specimens: DataFrame, area: str, projects: Sequence[str], species: str = SPECIES,
             areas: Sequence[str] | None = None) -> DataFrame:
    """Specimens of a species and set of projects, lengths in centimeters."""
    keep = (F.col("species_code") == species) & F.col("project_code").isin(list(projects))
    if areas is not None:
        keep = keep & F.col(area).isin(list(areas))
    return specimens.filter(keep).select(
        "year",
        "project_code",
        F.col(area),
        "species_code",
        millimeters_to_centimeters("length_millimeters").alias("length"),
        F.col("weight_kilograms").alias("weight"),
        "age",
        "sex_code",
        "maturity_code",
    )


def stat_to_area_scan(store: DataFrame) -> DataFrame:
    """Management area of each stat area."""
    return scan(store, {"stat": "g_stat_area", "g_management_area_code": "g_management_area_code"})


def bio_clean(scanned: DataFrame, gear: Column, source: str, area: str) -> DataFrame:
    """Measured fish with sex and maturity decoded, under the common column names."""
    return scanned.filter(F.col("length").isNotNull()).select(
        "year",
        gear.alias("Gear"),
        F.lit(source).alias("Source"),
        F.col(area).alias("Mgmt_area"),
        F.col("species_code").alias("Spp_cde"),
        "length",
        "weight",
        "age",
        map_codes("sex_code", SEX_CODES).alias("Sex"),
        map_codes("maturity_code", MATURITY_CODES).cast("int").alias("Maturity"),
    )


def fishery_bio(specimens: DataFrame, area: str = "g_management_area_code",
                areas: Sequence[str] | None = ("NSEI", "SSEI")) -> DataFrame:
    """Fishery specimens; lengths outside 20 to 120 cm are errors and dropped."""
    scanned = bio_scan(specimens, area, FISHERY_PROJECTS, areas=areas)
    clean = bio_clean(scanned, map_codes("project_code", FISHERY_GEARS), "Fishery", area)
    return clean.filter(~outside(F.col("length"), *LENGTH_RANGE))


def pot_survey_bio(specimens: DataFrame, area: str = "management_area",
                   areas: Sequence[str] | None = ("NSEI", "SSEI")) -> DataFrame:
    scanned = bio_scan(specimens, area, POT_SURVEY_PROJECTS, areas=areas)
    return bio_clean(scanned, F.lit("Pot"), "Survey", area)


def longline_survey_bio(specimens: DataFrame, stat_to_area: DataFrame) -> DataFrame:
    """Longline survey specimens; the area comes from the stat-area lookup."""
    scanned = bio_scan(specimens, "stat", LONGLINE_SURVEY_PROJECTS)
    placed = lookup_join(scanned, stat_to_area, ["stat"], "inner")
    return bio_clean(placed, F.lit("Longline"), "Survey", "g_management_area_code")


def sample_sizes(bio: DataFrame) -> DataFrame:
    return bio.groupBy("year", "Mgmt_area").agg(row_count().alias("n"))


def stack_bio(*extracts: DataFrame) -> DataFrame:
    return stack(extracts)


def bio_coverage(bio: DataFrame) -> DataFrame:
    return coverage(bio, ["Gear", "Source", "Mgmt_area"])


def _composition(
    fish: DataFrame, prefix: str, inner: str, levels: Sequence | None, combined: Mapping[str, str]
) -> DataFrame:
    """Counts and shares of ``inner`` at four levels, absent values filled with 0."""
    stem = f"{prefix}by_gear_source"
    detail = {
        f"{stem}_area_sex": ["Mgmt_area", "Sex"],
        f"{stem}_area": ["Mgmt_area"],
        f"{stem}_sex": ["Sex"],
        stem: [],
    }
    group = ["description", "Source", "Gear", "Mgmt_area", "Sex", "year"]
    keys = ["Source", "Gear", "year", inner]
    fine = count_rows(fish, [*keys, *combined])
    counted = by_levels(fine, keys, combined, detail, {"n": F.sum("n")})
    shares = share_of_total(counted, "n", group)
    values = present_levels(fine, inner, "n") if levels is None else list(levels)
    filled = complete(shares, group, {inner: values}, {"n": 0, "proportion": 0.0})
    return filled.select(*group, inner, "n", "proportion")


def age_composition(
    bio: DataFrame,
    sexes: Sequence[str] = ("Female", "Male"),
    plus_age: int = PLUS_AGE,
    combined: Mapping[str, str] = COMBINED,
    ages: Sequence[int] | None = None,
) -> DataFrame:
    """Age shares by gear, source, area and sex, and with areas or sexes combined.

    Ages from ``plus_age`` on form one group. Every key tuple gets all ages that
    occur, or the given ``ages``.
    """
    fish = bio.filter(F.col("Sex").isin(list(sexes)) & F.col("age").isNotNull()).select(
        "year", "Gear", "Source", "Mgmt_area", "Sex", plus_group("age", plus_age).alias("age")
    )
    return _composition(fish, "agecomp", "age", ages, combined)


def length_composition(bio: DataFrame, combined: Mapping[str, str] = COMBINED) -> DataFrame:
    """Shares of the declared length bins, fish under 40 cm left out."""
    fish = bio.filter(F.col("length") >= SHORTEST_BINNED).select(
        "year", "Gear", "Source", "Mgmt_area", "Sex", length_bin("length").alias("length_bin")
    )
    return _composition(fish, "lengthcomp", "length_bin", LENGTH_BINS, combined)


def proportion_mature(
    bio: DataFrame,
    combined: Mapping[str, str] = COMBINED,
    ages: Sequence[int] | None = None,
) -> DataFrame:
    """Mature fish of an age as a share of all staged fish of the group.

    The denominator covers every age and both stages, so the shares of a group add
    up to its overall mature share; they are not maturity rates per age.
    """
    area = {"Mgmt_area": combined["Mgmt_area"]}
    detail = {
        "propmatureby_gear_source_area_sex_age": ["Mgmt_area"],
        "propmatureby_gear_source_sex_age": [],
    }
    group = ["description", "Source", "Gear", "Mgmt_area", "Sex", "year"]
    staged = bio.filter(F.col("Maturity").isNotNull())
    keys = ["Source", "Gear", "Sex", "year", "Maturity", "age"]
    fine = count_rows(staged, [*keys, "Mgmt_area"])
    counted = by_levels(fine, keys, area, detail, {"n": F.sum("n")})
    mature = share_of_total(counted, "n", group).filter(F.col("Maturity") == 1).drop("Maturity")
    mature_n = F.when(F.col("Maturity") == 1, F.col("n")).otherwise(0)
    values = present_levels(fine.withColumn("_mature", mature_n), "age", "_mature") if ages is None else list(ages)
    filled = complete(mature, group, {"age": values}, {"n": 0, "proportion": 0.0})
    return filled.select(*group, "age", "n", "proportion")


def _size_at_age(fish: DataFrame, measure: str, combined: Mapping[str, str]) -> DataFrame:
    stem = f"{measure}ageby_gear_source"
    detail = {f"{stem}_area_year_sex": ["Mgmt_area"], f"{stem}_year_sex": []}
    summary = mean_sd_by_levels(
        fish,
        measure,
        ["Gear", "Source", "Sex", "year", "age"],
        {"Mgmt_area": combined["Mgmt_area"]},
        detail,
    )
    return summary.select(
        "description", "Gear", "Source", "Mgmt_area", "Sex", "year", "age",
        f"mean_{measure}", f"sd_{measure}", "n",
    )


def length_at_age(bio: DataFrame, combined: Mapping[str, str] = COMBINED) -> DataFrame:
    """Mean and sd of length per age, by area and with areas combined."""
    return _size_at_age(bio.filter(F.col("age").isNotNull()), "length", combined)


def weight_at_age(bio: DataFrame, combined: Mapping[str, str] = COMBINED) -> DataFrame:
    """Mean and sd of weight per age of the weighed fish."""
    weighed = bio.filter(F.col("weight").isNotNull() & F.col("age").isNotNull())
    return _size_at_age(weighed, "weight", combined)
