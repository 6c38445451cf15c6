"""The jobs end to end, read back from what they wrote."""

from __future__ import annotations

import random

import pytest

from haulmark.plans import biology, effort, landings, publish
from haulmark.sources import readers, schemas
from test_plans import UPDATES, STAT_AREAS, hooks, landing, make, random_bio, series


def test_publish_catch(spark, tmp_path, rows):
    earnings = make(spark, schemas.EARNINGS_LANDINGS, [
        *(landing("01", y, "61", float(y)) | {"species_code": "710"} for y in (1984, 1985, 1986)),
        landing("01", 1984, "61", 1e6) | {"species_code": "711"},
    ])
    tickets = make(
        spark,
        schemas.TICKET_LANDINGS,
        [
            {"year": 1985, "g_management_area_code": a, "species_code": s, "pounds": 5.0, "round_pounds": 0.0}
            for a, s in (("NSEI", "710"), ("NSEI", "711"), ("PWS", "710"), ("EYKT", "710"))
        ],
    )
    updates = spark.createDataFrame(
        UPDATES, "stat_area string, start_date timestamp, end_date timestamp, updated_waters string"
    )
    history = series(spark, [(y, "NSEI", 100.0) for y in (1907, 1984, 1985)])
    lookup = make(spark, schemas.STAT_AREA_LOOKUP, STAT_AREAS)
    out = publish.publish_catch(tickets, earnings, lookup, updates, history, str(tmp_path), 2018, str(tmp_path / "work"))
    assert out["grid"].endswith("catch_by_year_area_gear_1984_1986")
    assert out["comparison"].endswith("catch_comparison_1907_1986")
    grid = readers.read_csv(spark, out["grid"], schemas.CATCH_GRID, renames={"GEAR_CODE": "gear"})
    assert grid.count() == 3 * 4 * 6 and grid.first()[:] == (1984, "PWS", "HAL", 0.0)
    assert grid.filter("YEAR = 1984").groupBy().sum("WHOLE_POUNDS").first()[0] == 1984.0
    compared = readers.read_csv(spark, out["comparison"], schemas.CATCH_SERIES)
    tickets_only = compared.filter(compared.data_source == landings.TICKETS)
    assert [r[:] for r in tickets_only.select("year", "Mgmt_area", "whole_mt").collect()] == [(1985, "NSEI", 5 * 0.000453592)]
    best = readers.read_csv(spark, out["best"], schemas.CATCH_SERIES)
    got = [(r.year, r.data_source) for r in best.collect() if r.Mgmt_area == "NSEI"]
    assert got == [(1907, landings.HISTORICAL), (1984, landings.HISTORICAL), (1985, landings.EARNINGS), (1986, landings.EARNINGS)]


def test_a_doubled_stat_area_fails(spark, tmp_path):
    earnings = make(spark, schemas.EARNINGS_LANDINGS, [landing("01", 1985, "61", 5.0) | {"species_code": "710"}])
    tickets = make(spark, schemas.TICKET_LANDINGS, [])
    updates = spark.createDataFrame(
        UPDATES, "stat_area string, start_date timestamp, end_date timestamp, updated_waters string"
    )
    doubled = make(spark, schemas.STAT_AREA_LOOKUP, [*STAT_AREAS, STAT_AREAS[0] | {"start_date": None}])
    with pytest.raises(Exception, match="several rows for stat_area, stat_area_type"):
        publish.publish_catch(tickets, earnings, doubled, updates, series(spark, []), str(tmp_path), 2018, str(tmp_path / "work"))
    twice = updates.union(updates.limit(1))
    with pytest.raises(Exception, match="several rows for stat_area, start_date, end_date"):
        landings.resolved_stat_areas(make(spark, schemas.STAT_AREA_LOOKUP, STAT_AREAS), twice, unique=True).collect()


def test_refresh_reads_the_changed_years_only(spark, tmp_path, rows):
    rng = random.Random(3)
    landed = [
        landing("01", y, rng.choice(["61", "91", "99"]), rng.random() * 10.0 ** rng.randrange(-8, 9)) | {"species_code": "710"}
        for y in (1984, 1985, 1986) for _ in range(20)
    ]
    stored = str(tmp_path / "earnings")
    make(spark, schemas.EARNINGS_LANDINGS, landed).write.parquet(stored)
    updates = spark.createDataFrame(
        UPDATES, "stat_area string, start_date timestamp, end_date timestamp, updated_waters string"
    )
    lookup, store = make(spark, schemas.STAT_AREA_LOOKUP, STAT_AREAS), str(tmp_path / "sums")
    earnings = spark.read.parquet(stored)
    full = rows(landings.catch_by_year_area_gear(landings.earnings_scan(earnings), lookup, updates))
    publish.refresh_catch(earnings, lookup, updates, store, [1984, 1985])
    untouched = {p.name for p in (tmp_path / "sums" / "year=1984").iterdir()}
    grid = publish.refresh_catch(earnings, lookup, updates, store, [1985, 1986])
    assert rows(grid) == full
    assert {p.name for p in (tmp_path / "sums" / "year=1984").iterdir()} == untouched
    # a landing more, in a year that is there
    more = [landing("01", 1986, "61", 0.1) | {"species_code": "710"}]
    make(spark, schemas.EARNINGS_LANDINGS, more).write.mode("append").parquet(stored)
    grown = spark.read.parquet(stored)
    again = rows(publish.refresh_catch(grown, lookup, updates, store, [1986]))
    assert again == rows(landings.catch_by_year_area_gear(landings.earnings_scan(grown), lookup, updates)) != full


def test_publish_biology(spark, tmp_path, rows):
    data = random_bio(3, 200)
    extracts = {
        "a": spark.createDataFrame(data[:120], schemas.BIO),
        "b": spark.createDataFrame(data[120:], schemas.BIO),
    }
    out = publish.publish_biology(extracts, str(tmp_path), str(tmp_path / "work"))
    kind = schemas.schema(
        "description string, Source string, Gear string, Mgmt_area string, Sex string, year int, age int, n int, proportion double"
    )
    written = readers.read_csv(spark, out["agecomps"], kind)
    direct = biology.age_composition(spark.createDataFrame(data, schemas.BIO))
    assert rows(written) == rows(direct)
    assert {"a", "b", "coverage", "lengthcomps", "proportionmature", "lengthage", "weightage"} <= out.keys()


def test_publish_effort(spark, tmp_path, rows):
    sizes = spark.createDataFrame([(1, "NSEI", 2.5)], "Stat int, Mgmt_area string, stat_km2 double")
    data = make(spark, schemas.SURVEY_HOOKS, [hooks(1997), hooks(1998), hooks(2050)])
    logbook = make(
        spark,
        schemas.LOGBOOK_SETS,
        [{"year": 1999, "g_management_area_code": "SSEI", "hook_spacing": 40.0, "number_of_hooks": 10, "sable_lbs_per_set": 5.0}],
    )
    out = publish.publish_effort(data, sizes, logbook, str(tmp_path), str(tmp_path / "work"))
    assert out["survey"].endswith("survey_effort_1997_1998")
    index = readers.read_csv(spark, out["indices"], schemas.EFFORT_INDEX)
    assert index.count() == 29 + 1 + 2
    assert index.filter(index.description == effort.SURVEY_LABEL + "NSEI").count() == 2
