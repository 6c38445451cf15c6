"""Every registered query against its reference SQL on the smallest tables."""

from __future__ import annotations

import os
from datetime import datetime

import pytest

import __spark_entry__ as contract
from bindings import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
# Queries whose plan takes another route once Spark may not broadcast.
JOINING = [
    "catch_by_year_area_gear", "splice_sources", "landings_by_year_area", "bio_coverage", "age_composition",
    "proportion_mature", "length_at_age", "rpn_index", "fishery_wpue_index", "set_distinct",
]
ORDERED = {"sort_multi_key": ["Mgmt_area", "year", "data_source"], "sort_by_levels": ["gear", "area"]}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    return 0.0 if isinstance(value, float) and value == 0 else value


def compare(df, duck, sql):
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in cursor.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    rows = compare(QUERIES[name](spark, SF), duck, ORACLE[name])
    assert rows
    assert contract.queries()[name] is QUERIES[name]


@pytest.mark.parametrize("name", JOINING)
def test_query_matches_sql_without_broadcast(spark, duck, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        compare(contract.queries()[name](spark, SF), duck, contract.oracle_sql()[name])
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_sorted_queries_keep_the_order_of_the_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).select(*ORDERED[name]).collect()
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(r[names.index(c)] for c in ORDERED[name]) for r in cursor.fetchall()]
    assert [tuple(r) for r in got] == want


def test_entry_is_lazy_and_stable(spark):
    df = contract.entry(spark)
    assert df.dtypes == [("year", "int"), ("Mgmt_area", "string"), ("gear", "string"), ("whole_pounds", "double")]
    assert df.count() == 7 * 5 * 6


def test_results_do_not_depend_on_the_session_time_zone(spark, duck):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        for name in ("date_parts", "duration_hours", "flt_year_range", "logbook_extract"):
            rows = contract.queries()[name](spark, SF)
            plain_rows = [tuple(r) for r in rows.collect()]
            assert len(plain_rows) == len(duck.execute(contract.oracle_sql()[name]).fetchall())
            if not any(isinstance(v, datetime) for v in plain_rows[0]):
                compare(rows, duck, contract.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
