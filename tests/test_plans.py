"""Pipelines on invented rows, checked by hand or brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haulmark.functions import measures
from haulmark.operators.series import SpliceRule
from haulmark.plans import biology, effort, landings
from haulmark.sources import schemas


def make(spark, kind, data):
    """Rows given as dicts; columns left out are NULL."""
    names = kind.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], kind)


DAY = datetime(1987, 1, 1)
END = datetime(1999, 12, 31)
STAT_AREAS = [
    {"stat_area": "01", "stat_area_type": "G", "waters": "STATE", "start_date": DAY, "end_date": None, "g_mgt_area_district": "NSEI"},
    {"stat_area": "02", "stat_area_type": "G", "waters": None, "start_date": DAY, "end_date": None, "g_mgt_area_district": "PWSE"},
    {"stat_area": "03", "stat_area_type": "G", "waters": "STATE", "start_date": DAY, "end_date": END, "g_mgt_area_district": "PWS"},
    {"stat_area": "04", "stat_area_type": "G", "waters": "FED", "start_date": DAY, "end_date": None, "g_mgt_area_district": "SSEI"},
    {"stat_area": "05", "stat_area_type": "G", "waters": "STATE", "start_date": DAY, "end_date": None, "g_mgt_area_district": "OTHER"},
    {"stat_area": "06", "stat_area_type": "G", "waters": "STATE", "start_date": DAY, "end_date": None, "g_mgt_area_district": "SSEI"},
    {"stat_area": "06", "stat_area_type": "G", "waters": "STATE", "start_date": END, "end_date": None, "g_mgt_area_district": "SSEI"},
]
UPDATES = [("02", DAY, None, "STATE"), ("03", DAY, None, "FED"), ("01", DAY, END, "FED")]


def landing(area, year, gear, whole, pounds=1.0, kind="G"):
    return {"stat_area": area, "stat_area_type": kind, "year": str(year), "gear_code": gear, "whole_pounds": whole, "pounds": pounds}


@pytest.fixture
def catch(spark):
    data = [
        landing("01", 2000, "61", 10.5),
        landing("01", 2000, "06", 0.0, 7.25),
        landing("01", 2000, "91", 3.0),
        landing("02", 2000, "61", 4.0),
        landing("03", 2000, "61", 5.0),
        landing("04", 2000, "61", 100.0),
        landing("05", 2000, "61", 100.0),
        landing("06", 2001, "99", 6.0),
        landing("01", 2001, "61", 8.0),
        landing("01", 2001, "61", None, 9.0),
        landing("01", 2001, "zz", 2.0),
        landing("01", 2000, "61", 50.0, kind="F"),
    ]
    updates = spark.createDataFrame(UPDATES, "stat_area string, start_date timestamp, end_date timestamp, updated_waters string")
    return (
        make(spark, schemas.EARNINGS_LANDINGS, data),
        make(spark, schemas.STAT_AREA_LOOKUP, STAT_AREAS),
        updates,
    )


def test_catch_grid(catch, rows):
    out = landings.catch_by_year_area_gear(*catch)
    got = {(r.year, r.Mgmt_area, r.gear): r.whole_pounds for r in out.collect()}
    filled = {k: v for k, v in got.items() if v != 0.0}
    assert filled == {
        (2000, "NSEI", "HAL"): 17.75,  # zero falls back to the landed weight
        (2000, "NSEI", "POT"): 3.0,
        (2000, "PWS", "HAL"): 9.0,  # 02 through its update, 03 keeps STATE: the update has another end date
        (2001, "SSEI", "UNK"): 12.0,  # two validity rows double the landing, as the join does
        (2001, "NSEI", None): 2.0,  # an unmapped gear keeps its row
    }
    # A missing weight makes the strict total missing; the grid fills it with 0.
    assert got[(2001, "NSEI", "HAL")] == 0.0
    assert len(got) == 2 * 4 * 6 + 1
    assert dict(out.dtypes)["year"] == "int"


def test_store_scans(spark, rows):
    names = landings.EARNINGS_COLUMNS
    store = spark.createDataFrame(
        [tuple("710" if k == "species_code" else k for k in names), tuple("711" for _ in names)],
        ", ".join(f"{source} string" for source in names.values()),
    )
    got = landings.earnings_scan(store)
    assert got.columns == schemas.EARNINGS_LANDINGS.fieldNames()
    assert rows(got) == [tuple("710" if k == "species_code" else k for k in names)]

    data = [{"species_code": s, "g_management_area_code": a} for s, a in (("710", "NSEI"), ("710", "EYKT"), ("711", "NSEI"))]
    tickets = landings.ticket_scan(make(spark, schemas.TICKET_LANDINGS, data))
    assert tickets.columns == schemas.TICKET_LANDINGS.fieldNames() and tickets.count() == 1

    lookup = make(spark, schemas.STAT_AREA_LOOKUP, STAT_AREAS).withColumnRenamed("stat_area_type", "database_type")
    assert landings.stat_area_scan(lookup).columns == schemas.STAT_AREA_LOOKUP.fieldNames()
    raw = make(spark, schemas.STAT_TO_AREA, [{"stat": "1"}]).withColumnRenamed("stat", "g_stat_area")
    assert biology.stat_to_area_scan(raw).columns == schemas.STAT_TO_AREA.fieldNames()

    hooked = make(spark, schemas.SURVEY_HOOKS, [hooks(2000), hooks(2000, project="77")])
    survey_store = hooked.withColumnsRenamed(effort.SURVEY_COLUMNS)
    scanned = effort.survey_scan(survey_store)
    assert set(scanned.columns) == set(hooked.columns) and scanned.count() == 1


def test_unknown_waters(catch, rows):
    landed, areas, updates = catch
    got = landings.unknown_waters(landed, landings.resolved_stat_areas(areas, updates), ["PWS", "PWSE"])
    assert rows(got, "g_mgt_area_district", "stat_area", "waters") == [("PWS", "03", "STATE"), ("PWSE", "02", "STATE")]


def test_preaggregated_catch_equals_the_row_level_chain(catch, rows):
    joined = landings.landings_with_areas(*catch)
    kept = joined.filter(F.col("waters").isin("STATE") & F.col("g_mgt_area_district").isin("NSEI", "SSEI", "PWS", "PWSE"))
    weight = F.when(F.col("whole_pounds") == 0, F.col("pounds")).otherwise(F.col("whole_pounds"))
    by_hand = kept.groupBy(F.col("year").cast("int").alias("year")).agg(F.sum(weight).alias("w"))
    grid = landings.catch_by_year_area_gear(*catch)
    total = grid.groupBy("year").agg(F.sum("whole_pounds"))
    # 2001 has a missing weight in one cell, which empties that cell in the strict grid.
    assert rows(by_hand) == [(2000, 29.75), (2001, 22.0)]
    assert rows(total) == [(2000, 29.75), (2001, 14.0)]


def test_ticket_catch_is_strict(spark, rows):
    data = [
        {"year": 2000, "g_management_area_code": "NSEI", "pounds": 5.0, "round_pounds": 0.0},
        {"year": 2000, "g_management_area_code": "NSEI", "pounds": 5.0, "round_pounds": 6.5},
        {"year": 2001, "g_management_area_code": "NSEI", "pounds": 5.0, "round_pounds": None},
    ]
    cleaned = landings.clean_tickets(make(spark, schemas.TICKET_LANDINGS, data))
    assert rows(landings.ticket_catch(cleaned)) == [(2000, "NSEI", 11.5), (2001, "NSEI", None)]


def series(spark, data):
    return spark.createDataFrame(data, "year int, Mgmt_area string, whole_pounds double")


def test_compare_and_best_series(spark, rows):
    sources = {
        landings.HISTORICAL: series(spark, [(1984, "NSEI", 100.0), (1985, "NSEI", 100.0)]),
        landings.EARNINGS: series(spark, [(1984, "NSEI", 1.0), (1985, "NSEI", 2.0), (1980, "SSEI", 3.0), (1990, "PWS", 4.0), (1990, "LOWCI", 5.0)]),
        landings.TICKETS: series(spark, [(1985, "NSEI", 9.0), (1980, "SSEI", 9.0)]),
    }
    assert landings.compare_sources(sources).count() == 9
    best = landings.best_series(sources)
    assert rows(best, "Mgmt_area", "year", "whole_mt") == [
        ("NSEI", 1984, 100.0 * 0.000453592),
        ("NSEI", 1985, 2.0 * 0.000453592),
        ("PWS", 1990, 4.0 * 0.000453592),
        ("SSEI", 1980, 3.0 * 0.000453592),
    ]


def test_two_rows_for_an_area_and_year_are_an_error(spark):
    twice = {landings.EARNINGS: series(spark, [(1990, "PWS", 4.0), (1990, "PWS", 5.0)])}
    with pytest.raises(Exception, match="two rows for PWS 1990"):
        landings.best_series(twice).collect()


def test_a_source_no_rule_names_is_not_read(spark, tmp_path):
    paths = {}
    for name in ("a", "b"):
        paths[name] = str(tmp_path / name)
        series(spark, [(2000, "NSEI", 1.0)]).write.parquet(paths[name])
    sources = {n: spark.read.parquet(p) for n, p in paths.items()}
    best = landings.best_series(sources, [SpliceRule("NSEI", "a")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_discrepancy(spark, rows):
    grid = spark.createDataFrame(
        [(1975, "NSEI", "HAL", 10.0), (1986, "NSEI", "HAL", 1.0), (1975, "SSEI", "HAL", 1.0)],
        "year int, Mgmt_area string, gear string, whole_pounds double",
    )
    data = [
        {"year": 1975, "g_management_area_code": "NSEI", "gear": "Longline", "round_pounds": 4.0},
        {"year": 1975, "g_management_area_code": "NSEI", "gear": "Seine", "round_pounds": 5.0},
    ]
    cleaned = landings.clean_tickets(make(spark, schemas.TICKET_LANDINGS, data))
    out = landings.discrepancy_by_gear(grid, cleaned, "NSEI", 1975, 1985)
    assert rows(out, "data_source", "gear", "whole_mt") == [
        (landings.EARNINGS, "HAL", 10.0 * 0.000453592),
        (landings.TICKETS, "HAL", 4.0 * 0.000453592),
        (landings.TICKETS, None, 5.0 * 0.000453592),
    ]


def fish_code(length, sex="01", maturity="02", project="02", area="NSEI", species="710"):
    return {
        "year": 2000, "project_code": project, "g_management_area_code": area, "management_area": area,
        "species_code": species, "length_millimeters": length, "age": 5, "sex_code": sex, "maturity_code": maturity,
    }


def test_fishery_extract(spark, rows):
    data = [
        fish_code(199), fish_code(200), fish_code(1200, "02", "03", "17"), fish_code(1201), fish_code(None),
        fish_code(500, "03", "08"), fish_code(500, None, None), fish_code(500, species="711"),
        fish_code(500, project="10"), fish_code(500, area="EYKT"),
    ]
    out = biology.fishery_bio(make(spark, schemas.BIO_FISHERY, data))
    assert out.columns == schemas.BIO.fieldNames()
    assert rows(out, "length", "Gear", "Sex", "Maturity", "Source") == [
        (20.0, "Longline", "Male", 0, "Fishery"),
        (50.0, "Longline", None, None, "Fishery"),
        (50.0, "Longline", None, None, "Fishery"),
        (120.0, "Pot", "Female", 1, "Fishery"),
    ]


def test_survey_extracts(spark, rows):
    pot = make(spark, schemas.BIO_POT_SURVEY, [fish_code(500, project="10"), fish_code(150, project="11"), fish_code(500)])
    out = biology.pot_survey_bio(pot)
    assert rows(out, "length", "Gear", "Source") == [(15.0, "Pot", "Survey"), (50.0, "Pot", "Survey")]
    assert rows(biology.sample_sizes(out)) == [(2000, "NSEI", 2)]
    data = [{**fish_code(500, project="601"), "stat": "1"}, {**fish_code(500, project="603"), "stat": "9"}]
    line = make(spark, schemas.BIO_LONGLINE_SURVEY, data)
    areas = spark.createDataFrame([("1", "SSEI")], schemas.STAT_TO_AREA)
    assert rows(biology.longline_survey_bio(line, areas), "Mgmt_area", "Gear") == [("SSEI", "Longline")]


def random_bio(seed=7, n=900):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        # A third of all fish share one key.
        hot = rng.random() < 0.34
        out.append(
            (
                2000 if hot else rng.choice([2000, 2001]),
                "Pot" if hot else rng.choice(["Pot", "Longline"]),
                rng.choice(["Survey"] if hot else ["Survey", "Fishery"]),
                "NSEI" if hot else rng.choice(["NSEI", "SSEI"]),
                "710",
                rng.choice([39.9, 40.0, 41.0, 41.9, 42.0, 43.9, 57.3, 99.0, 99.1, 120.0]),
                rng.choice([None, 1.25, 2.5, 3.1]),
                rng.choice([None, 3, 4, 30, 31, 45]),
                rng.choice(["Male", "Female", None]),
                rng.choice([0, 1, None]),
            )
        )
    return out


def composition_by_hand(fish, prefix, inner_values):
    """fish: (year, gear, source, area, sex, inner)."""
    stem = f"{prefix}by_gear_source"
    detail = {f"{stem}_area_sex": (1, 1), f"{stem}_area": (1, 0), f"{stem}_sex": (0, 1), stem: (0, 0)}
    n = defaultdict(int)
    for (name, (keep_area, keep_sex)), (year, gear, source, area, sex, inner) in itertools.product(detail.items(), fish):
        key = (name, source, gear, area if keep_area else "NSEI_SSEI_combined", sex if keep_sex else "Sex_combined", year)
        n[key, inner] += 1
    totals = defaultdict(int)
    for (key, _), count in n.items():
        totals[key] += count
    return {
        (*key, inner): (n.get((key, inner), 0), round(n.get((key, inner), 0) / totals[key], 4))
        for key in totals
        for inner in inner_values
    }


@pytest.fixture(scope="module")
def bio_rows():
    return random_bio()


@pytest.fixture(scope="module")
def bio(spark, bio_rows):
    return spark.createDataFrame(bio_rows, schemas.BIO).repartition(5).cache()


def as_map(df, value_cols):
    keys = [c for c in df.columns if c not in value_cols]
    out = {tuple(r[c] for c in keys): tuple(r[c] for c in value_cols) for r in df.collect()}
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1.01e-4), key


def test_age_composition(bio, bio_rows):
    fish = [(r[0], r[1], r[2], r[3], r[8], min(r[7], 31)) for r in bio_rows if r[8] and r[7] is not None]
    out = biology.age_composition(bio)
    same(as_map(out, ["n", "proportion"]), composition_by_hand(fish, "agecomp", [3, 4, 30, 31]))
    declared = biology.age_composition(bio, ages=[2, 3, 4, 30, 31])
    assert declared.count() == out.count() / 4 * 5


def test_length_composition(bio, bio_rows):
    bins = {40.0: "41", 41.0: "41", 41.9: "41", 42.0: "43", 43.9: "43", 57.3: "57", 99.0: "99", 99.1: "99", 120.0: "99"}
    fish = [(r[0], r[1], r[2], r[3], r[8], bins[r[5]]) for r in bio_rows if r[5] >= 40]
    labels = [str(b) for b in range(41, 100, 2)]
    same(as_map(biology.length_composition(bio), ["n", "proportion"]), composition_by_hand(fish, "lengthcomp", labels))


def test_proportion_mature(bio, bio_rows):
    staged = [r for r in bio_rows if r[9] is not None]
    n, totals = defaultdict(int), defaultdict(int)
    for r in staged:
        for name, area in (("area_sex_age", r[3]), ("sex_age", "NSEI_SSEI_combined")):
            key = (f"propmatureby_gear_source_{name}", r[2], r[1], area, r[8], r[0])
            totals[key] += 1
            if r[9] == 1:
                n[key, r[7]] += 1
    ages = {r[7] for r in staged if r[9] == 1}
    mature = {key for key, _ in n}
    want = {(*k, a): (n.get((k, a), 0), round(n.get((k, a), 0) / totals[k], 4)) for k in mature for a in ages}
    same(as_map(biology.proportion_mature(bio), ["n", "proportion"]), want)


@pytest.mark.parametrize("measure", ["length", "weight"])
def test_size_at_age(bio, bio_rows, measure):
    at = {"length": 5, "weight": 6}[measure]
    groups = defaultdict(list)
    for r in bio_rows:
        if r[7] is None or r[at] is None:
            continue
        for name, area in (("area_year_sex", r[3]), ("year_sex", "NSEI_SSEI_combined")):
            groups[f"{measure}ageby_gear_source_{name}", r[1], r[2], area, r[8], r[0], r[7]].append(r[at])
    plan = biology.length_at_age if measure == "length" else biology.weight_at_age
    got = as_map(plan(bio), [f"mean_{measure}", f"sd_{measure}", "n"])
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        mean, sd, n = got[key]
        exact = sum(values) / len(values)
        assert n == len(values) and abs(mean - exact) <= 0.0500001 and round(mean, 1) == mean
        if n == 1:
            assert sd is None
        else:
            spread = math.sqrt(sum((v - exact) ** 2 for v in values) / (n - 1))
            assert abs(sd - spread) <= 0.0500001


def test_missing_length_makes_the_mean_missing_but_counts(spark, rows):
    data = [(2000, "Pot", "Survey", "NSEI", "710", x, 1.0, 5, "Male", 0) for x in (50.0, None)]
    out = biology.length_at_age(spark.createDataFrame(data, schemas.BIO))
    assert rows(out, "mean_length", "sd_length", "n") == [(None, None, 2)] * 2


def test_bio_coverage(spark, rows, bio):
    a = bio.filter("Gear = 'Pot' AND Source = 'Survey' AND Mgmt_area = 'NSEI'")
    b = spark.createDataFrame([(1979, "Pot", "Survey", "NSEI")], "year int, Gear string, Source string, Mgmt_area string")
    assert rows(biology.bio_coverage(biology.stack_bio(a, b))) == [("Pot", "Survey", "NSEI", 1979, 2001, 3)]


def hooks(year, condition="01", sablefish=10, invalid=None, hooks=100, stat="1", project="603"):
    return {
        "year": year, "project_code": project, "trip_no": "t", "stat": stat, "avg_depth_fathoms": 100.0,
        "number_hooks": hooks, "invalid": invalid, "sablefish": sablefish, "subset_condition_code": condition,
        "time_first_buoy_onboard": datetime(year, 12, 31, 23, 30),
    }


def survey(spark, data):
    sizes = spark.createDataFrame([(1, "NSEI", 2.5), (2, "SSEI", 4.0)], "Stat int, Mgmt_area string, stat_km2 double")
    return effort.survey_effort(make(spark, schemas.SURVEY_HOOKS, data), sizes)


def test_survey_effort_drops_the_dummy_year_and_keeps_unknown_stat_areas(spark, rows):
    out = survey(spark, [hooks(2000), hooks(2000, stat="7"), hooks(2000, project="99"), hooks(2001), hooks(2019, project="99")])
    assert set(out.columns) == set(schemas.SURVEY_EFFORT.fieldNames())
    assert rows(out, "year", "Stat", "Mgmt_area", "stat_km2", "julian_day", "depth") == [
        (2000, "1", "NSEI", 2.5, 366, 182.88),
        (2000, "7", None, None, 366, 182.88),
    ]


def std(n, inches):
    return 2.2 * n * (1 - math.exp(-0.57 * inches * 0.0254))


def test_survey_rates_by_era(spark):
    data = [hooks(y) for y in (1996, 1997, 1998, 1999, 2000)] + [
        hooks(2001, "02"), hooks(2001, None), hooks(2001, sablefish=None, invalid=20), hooks(2001, hooks=0), hooks(2050),
    ]
    out = effort.survey_rates(survey(spark, data)).collect()
    got = sorted((r.year, r.no_hooks, r.std_cpue) for r in out if r.no_hooks)
    want = [
        (1996, 100, 14.3 / std(100, 118)), (1997, 100, 10 / std(100, 72)), (1998, 100, 10 / std(100, 64)),
        (1999, 100, 10 / std(100, 64)), (2000, 100, 10 / std(100, 78)), (2001, 80, 0.0),
    ]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-12)
    assert [r.std_cpue for r in out if not r.no_hooks] == [None]


def test_survey_index(spark, rows):
    data = [hooks(1996), hooks(1997, sablefish=30), hooks(1997, sablefish=60), hooks(1998, stat="7"), hooks(2050)]
    out = effort.survey_npue_index(survey(spark, data))
    a, b = 30 / std(100, 72), 60 / std(100, 72)
    mean, sd = round((a + b) / 2, 2), round(abs(a - b) / math.sqrt(2), 2)
    assert rows(out, "Year", "Value", "CV", "description") == [
        (1997, mean, round(round(sd / math.sqrt(2), 4) / mean, 2), "ADFG_LLsrv_NPUE_NSEI"),
        (1998, round(10 / std(100, 64), 2), None, "ADFG_LLsrv_NPUE_NA"),
    ]


def test_logbook_extract(spark, rows):
    data = [
        {"year": 2000, "g_management_area_code": a, "hook_size": h, "time_set": datetime(2000, 3, 1, 6), "time_hauled": t}
        for a, h, t in (
            ("NSEI", "13/0", datetime(2000, 3, 1, 18, 30)), ("SSEI", "circle", datetime(2000, 3, 1)),
            ("NSEI", None, None), ("EYKT", "13", None),
        )
    ]
    out = effort.logbook_effort(make(spark, schemas.LOGBOOK_SETS, data))
    assert set(out.columns) == set(schemas.FISHERY_EFFORT.fieldNames())
    assert rows(out, "Mgmt_area", "soak", "Size", "julian_day") == [
        ("NSEI", 12.5, 130.0, 61), ("NSEI", None, None, 61), ("SSEI", -6.0, None, 61),
    ]


def test_fishery_index_puts_legacy_rows_without_cv_first(spark, rows):
    data = [
        {"year": 1997, "Mgmt_area": "NSEI", "hook_space": 39.37, "no_hooks": 100, "sable_lbs_set": p} for p in (80.0, None, 120.0)
    ]
    out = effort.fishery_wpue_index(make(spark, schemas.FISHERY_EFFORT, data))
    legacy = [r for r in out.collect() if r.Year < 1997]
    assert len(legacy) == 29 and all(r.CV is None for r in legacy)
    assert {r.description for r in legacy} == {"ADFG_LLfishery_WPUE_NSEI", "ADFG_LLfishery_WPUE_SSEI"}
    hook = 2.2 * 100 * (1 - math.exp(-0.57))
    mean, sd = round(100 / hook, 2), round(40 / hook / math.sqrt(2), 2)
    modern = rows(out.filter("Year >= 1997"), "Year", "Value", "CV")
    assert modern == [(1997, mean, round(round(sd / math.sqrt(3), 4) / mean, 2))]
    both = effort.cpue_indices(effort.survey_npue_index(survey(spark, [hooks(1997), hooks(2050)])), out)
    assert both.count() == 31


def test_rpn(spark, rows):
    data = [hooks(2000, stat="1", sablefish=s) for s in (10, 30)] + [hooks(2000, stat="2", sablefish=5), hooks(2050)]
    effort_rows = survey(spark, data)
    sizes = spark.createDataFrame([(1, 3.0)], "Stat int, stat_km2 double")
    out = effort.rpn_index(effort.survey_rates(effort_rows), sizes)
    npue = round(20 / std(100, 78), 2)
    assert rows(out) == [(2000, "NSEI", round(npue * 3.0, 2), npue), (2000, "SSEI", None, round(5 / std(100, 78), 2))]


def test_rpn_over_depth_strata(spark, rows):
    depth = measures.depth_stratum("depth")
    data = [(2000, "NSEI", 250.0, 1.0), (2000, "NSEI", 290.0, 2.0), (2000, "NSEI", 350.0, 4.0)]
    rates = spark.createDataFrame(data, "year int, Mgmt_area string, depth double, std_cpue double")
    sizes = spark.createDataFrame([(3, 10.0), (4, 100.0)], "stratum int, km2 double")
    out = effort.rpn_index(rates.withColumn("stratum", depth), sizes, "stratum", "km2", ("RPW", "WPUE"))
    assert rows(out, "RPW", "WPUE") == [(415.0, 2.33)]


def test_areas_and_years_go_through_the_grid(spark, rows):
    """Restricted before the work, the rows are those of the whole grid."""
    data = [landing("01", y, "61", 5.0) for y in (1999, 2000)] + [landing("06", y, "91", 7.0) for y in (2000, 2001, 2002)]
    lookup = make(spark, schemas.STAT_AREA_LOOKUP, STAT_AREAS)
    landed = make(spark, schemas.EARNINGS_LANDINGS, data)
    full = landings.catch_by_year_area_gear(landed, lookup)
    part = landings.catch_by_year_area_gear(landed, lookup, shown=["NSEI", "PWS"], years=(2000, 2001))
    want = full.filter(F.col("Mgmt_area").isin("NSEI", "PWS") & F.col("year").between(2000, 2001))
    # in 2001 only another area has catch
    assert rows(part) == rows(want) and part.count() == 2 * 2 * 6
