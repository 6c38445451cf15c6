"""Declared input schemas. Nothing is inferred: inference loses leading zeros."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES: dict[str, DataType] = {
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "date": DateType(),
    "timestamp": TimestampType(),
}


def schema(ddl: str) -> StructType:
    """Schema from ``name type`` pairs, for example ``schema("year int, gear string")``.

    Parsed here, since Spark's own parser needs a session and this module is imported first.
    """
    pairs = [pair.split() for pair in ddl.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


# Rows fetched from the landing, specimen and effort stores.
TICKET_LANDINGS = schema(
    "year int, adfg_no string, trip_no string, vessel_name string, port_code string, gear string, "
    "catch_date timestamp, sell_date timestamp, "
    "harvest_code string, harvest string, g_stat_area string, g_management_area_code string, "
    "species_code string, pounds double, round_pounds double, "
    "delivery_code string, g_cfec_fishery_group string, g_cfec_fishery string"
)
EARNINGS_LANDINGS = schema(
    "year string, date_landed timestamp, gear_code string, port_code string, "
    "cfec_harvest_area string, cfec_permit string, delivery_code string, "
    "harvest_code string, mgt_program_code string, species_code string, "
    "stat_area string, stat_area_type string, landing_status string, "
    "pounds double, whole_pounds double"
)
STAT_AREA_LOOKUP = schema(
    "stat_area string, stat_area_type string, region string, waters string, "
    "start_date timestamp, end_date timestamp, "
    "g_mgt_area_district string, g_nmfs_area string"
)
BIO_FISHERY = schema(
    "year int, project_code string, g_management_area_code string, species_code string, "
    "length_millimeters int, weight_kilograms double, age int, "
    "sex_code string, maturity_code string, maturity string"
)
BIO_POT_SURVEY = schema(
    "year int, project_code string, management_area string, species_code string, "
    "length_millimeters int, weight_kilograms double, age int, "
    "sex_code string, maturity_code string"
)
BIO_LONGLINE_SURVEY = schema(
    "year int, project_code string, stat string, species_code string, "
    "length_millimeters int, weight_kilograms double, age int, "
    "sex_code string, maturity_code string"
)
STAT_TO_AREA = schema("stat string, g_management_area_code string")
SURVEY_HOOKS = schema(
    "year int, project_code string, trip_no string, target_species_code string, "
    "adfg_no string, vessel_name string, time_first_buoy_onboard timestamp, "
    "number_of_stations int, hooks_per_set int, hook_size string, hook_spacing_inches double, "
    "sample_freq string, last_skate_sampled string, effort_no int, station_no string, "
    "stat string, start_lat double, start_lon double, end_lat double, end_lon double, "
    "avg_depth_fathoms double, number_hooks int, bare int, bait int, invalid int, "
    "sablefish int, subset_condition_code string"
)
LOGBOOK_SETS = schema(
    "year int, project_code string, trip_no string, adfg_no string, "
    "longline_system_code string, sell_date timestamp, hook_size string, hook_spacing double, "
    "number_of_skates int, number_of_hooks int, average_depth_meters double, "
    "g_management_area_code string, g_stat_area string, "
    "trip_target string, set_target string, effort_no int, sable_lbs_per_set double, "
    "time_set timestamp, time_hauled timestamp, "
    "start_latitude_decimal_degrees double, start_longitude_decimal_degree double"
)

# Cleaned tables passed from one pipeline to the next.
BIO = schema(
    "year int, Gear string, Source string, Mgmt_area string, Spp_cde string, "
    "length double, weight double, age int, Sex string, Maturity int"
)
SURVEY_EFFORT = schema(
    "year int, Project_cde string, Station_no string, trip_no string, Adfg string, "
    "Vessel string, date date, julian_day int, Stat string, set int, "
    "start_lat double, start_lon double, end_lat double, end_lon double, depth double, "
    "no_hooks int, hooks_bare int, hooks_bait int, hook_invalid int, hooks_sablefish int, "
    "subset_condition_cde string, Mgmt_area string, stat_km2 double"
)
FISHERY_EFFORT = schema(
    "year int, Mgmt_area string, trip_no string, Adfg string, Spp_cde string, "
    "date date, julian_day int, soak double, Gear string, Hook_size string, Size double, "
    "hook_space double, Stat string, no_hooks int, depth double, sets int, "
    "sable_lbs_set double, start_lat double, start_lon double"
)

# Published CSV files.
WATERS_OVERRIDE = schema(
    "STAT_AREA1 string, STAT_AREA string, WATERS string, "
    "START_DATE timestamp, END_DATE timestamp, "
    "G_MGT_AREA_DISTRICT string, SJL_WATERS string, UPDATED_WATERS string, SJL_AREA_NOTES string"
)
# The columns used of a wide file; read them by name.
STAT_AREA_SIZES = schema("SUBDISTRICT_CODE string, STAT_AREA string, Area_Kilometers double")
HISTORICAL_CATCH = schema("YEAR int, WHOLE_POUNDS double")
CATCH_GRID = schema("YEAR int, Mgmt_area string, GEAR_CODE string, WHOLE_POUNDS double")
CATCH_SERIES = schema("year int, Mgmt_area string, whole_mt double, data_source string")
EFFORT_INDEX = schema("Year int, Value double, CV double, description string")
GROWTH_PARAMETERS = schema(
    "Survey string, Years string, Region string, Function string, Sex string, Parameter string, "
    "Estimate double, SE double, n int, Source string"
)
# Positional: the file repeats header names, so they are replaced. Counts carry
# thousands separators and stay text until ``grouped_number`` reads them.
ABUNDANCE_INDEX = schema(
    "year int, abundance_age2plus string, abc_round_lbs string, biomass_round_lbs_age4plus string, "
    "harvest_policy string, adjusted_number_marks string, number_fish_observed string, "
    "recovered_number_marks string, notes string, source string, "
    + ", ".join(f"spare{i} string" for i in range(1, 16))
)
