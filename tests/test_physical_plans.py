"""What the physical plans must and must not hold."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from bindings import QUERIES, roles
from haulmark.plans import biology

SF = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas", "ExistingRDD"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python_and_only_real_tables(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not [word for word in FORBIDDEN if word in plan]
    assert "FileScan parquet" in plan


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("flt_eq", "EqualTo(l_returnflag,A)"),
        ("flt_in", "In(o_orderpriority, [1-URGENT,2-HIGH])"),
        ("flt_year_range", "LessThan(o_orderdate,1999-01-01T00:00)"),
        ("src_scan_project_filter", "EqualTo(l_returnflag,R)"),
        ("proj_computed_scan", "In(p_type, [ECONOMY,PROMO])"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    df = QUERIES[name](spark, SF)
    assert pushed in df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("landings_by_year_area", {"o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"}),
        ("agg_rowcount", {"l_quantity", "l_linestatus"}),
        ("tick_labels", {"p_size"}),
    ],
)
def test_only_used_columns_are_read(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SF))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {field.split(":")[0] for field in schema.split(",")} == columns


@pytest.mark.parametrize("plan", [biology.age_composition, biology.proportion_mature])
def test_present_ages_reuse_the_counted_rows(spark, plan):
    df = plan(roles.bio(spark, SF))
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


@pytest.mark.parametrize("plan", [biology.length_at_age, biology.weight_at_age, biology.length_composition])
def test_rows_are_aggregated_before_levels_multiply_them(spark, plan):
    text = plan_of(plan(roles.bio(spark, SF)))
    assert text.count("FileScan parquet") == 1
    below_expand = text[text.index("Expand") :]
    assert "HashAggregate" in below_expand


#: Scans of the rows: the survey indices and the grid read them once, both indices together twice.
READS = {
    "complete_multi_fill": 1, "survey_npue_index": 1, "rpn_index": 1, "cpue_index": 2, "age_composition": 1,
    "proportion_mature": 1, "flt_below_global_max": 2,
}


@pytest.mark.parametrize("name", sorted(READS))
def test_rows_are_read_as_often_as_needed(spark, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = QUERIES[name](spark, SF)
        plan = plan_of(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem.parquet" in line]
    assert len(scans) == READS[name]


def test_no_query_starts_a_job_while_it_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "queries")
    try:
        for build in QUERIES.values():
            build(spark, SF)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup("building")


def formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_years_and_areas_go_through_the_grid(spark):
    plan = formatted(spark, QUERIES["discrepancy_by_gear"](spark, SF))
    items = [part for part in plan.split("\n\n") if "lineitem.parquet" in part and "PushedFilters" in part]
    assert items
    for part in items:
        assert "GreaterThanOrEqual(l_shipdate,1996-01-01" in part and "LessThan(l_shipdate,1999-01-01" in part
    # blank rows are made for the one area only
    assert "THEN [AFRICA] ELSE" in plan


def test_splicing_reads_no_source_without_a_rule(spark):
    assert "orders.parquet" not in plan_of(QUERIES["splice_sources"](spark, SF))
