"""Readers and writers on files written by the test."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haulmark.sources import readers, schemas, writers


def test_csv_type_traps(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_text(
        "YEAR,STAT_AREA,WATERS,START_DATE,NAME\n"
        "2e3,000051,NA,1987-01-01T09:00:00Z,<Null>\n"
        '1999, 000052 , NA ,NA,""\n'
        "2001,,STATE,,x\n"
    )
    kind = schemas.schema("YEAR int, STAT_AREA string, WATERS string, START_DATE timestamp, NAME string")
    got = [tuple(r) for r in readers.read_csv(spark, str(path), kind, ["<Null>"]).collect()]
    assert got == [
        (2000, "000051", None, datetime(1987, 1, 1, 9), None),
        (1999, "000052", None, None, None),
        (2001, None, "STATE", None, "x"),
    ]


def test_csv_breaks_inside_quotes_and_repeated_headers(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('year, count ,notes,,notes\n1980,"7,817,236","two\nlines",,b\n1981, NA ,c,,\n')
    kind = schemas.schema("year int, count string, notes string, spare string, notes2 string")
    df = readers.read_csv(spark, str(path), kind, multi_line=True, by_position=True)
    got = [tuple(r) for r in df.withColumn("count", readers.grouped_number("count")).collect()]
    assert got == [(1980, 7817236.0, "two\nlines", None, "b"), (1981, None, "c", None, None)]


def test_csv_errors_are_not_hidden(spark, tmp_path):
    kind = schemas.schema("YEAR int, WHOLE_POUNDS double")
    for name, text in {"text": "YEAR,WHOLE_POUNDS\n1999,many\n", "moved": "WHOLE_POUNDS,YEAR\n1.5,1999\n"}.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        with pytest.raises(Exception, match="MALFORMED|CSV header|does not conform|FAILED_READ"):
            readers.read_csv(spark, str(path), kind).collect()


def test_csv_of_another_vintage(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text("YEAR,Mgt_area,GEAR_CODE,WHOLE_POUNDS\n2e3,NSEI,JIG,1.5\n")
    got = readers.read_csv(spark, str(path), schemas.CATCH_GRID, renames={"Mgmt_area": "Mgt_area"})
    assert got.columns == schemas.CATCH_GRID.names and got.first()[:] == (2000, "NSEI", "JIG", 1.5)


def test_csv_columns_by_name(spark, tmp_path, rows):
    path = tmp_path / "wide.csv"
    path.write_text("ID,STAT_AREA,NAME,Area_Kilometers,SUBDISTRICT_CODE,N\n1,000051,<Null>,2.5,SSEI,2e3\n2,000052,a,NA,,7\n")
    kind = schemas.schema("SUBDISTRICT_CODE string, STAT_AREA string, Area_Kilometers double, N int, NAME string")
    got = rows(readers.read_csv_columns(spark, str(path), kind, ["<Null>"]), "STAT_AREA", "SUBDISTRICT_CODE", "Area_Kilometers", "N", "NAME")
    assert got == [("000051", "SSEI", 2.5, 2000, None), ("000052", None, None, 7, "a")]


def test_scan_projects_and_filters(spark, rows):
    df = spark.createDataFrame([("710", 1.0, 5), ("711", 2.0, 6)], "species string, pounds double, x int")
    out = readers.scan(df, {"p": "pounds", "q": F.col("x") * 2}, F.col("species") == "710")
    assert out.columns == ["p", "q"] and rows(out) == [(1.0, 10)]
    assert readers.scan(df, ["x"]).columns == ["x"]


def test_scan_filter_and_columns_reach_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("710", 1.0, 5)], "species string, pounds double, x int").write.parquet(path)
    out = readers.scan(spark.read.parquet(path), {"p": "pounds"}, F.col("species").isin("710", "711"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "In(species, [710,711])" in plan
    assert "ReadSchema: struct<species:string,pounds:double>" in plan


def test_inline_series(spark, rows):
    df = readers.inline_series(spark, {"Mgmt_area": "NSEI"}, 1980, [0.719, 0.98], "WPUE")
    assert rows(df) == [("NSEI", 1980, 0.719), ("NSEI", 1981, 0.98)]
    assert dict(df.dtypes) == {"Mgmt_area": "string", "year": "int", "WPUE": "double"}


def test_csv_round_trip_writes_missing_as_na(spark, tmp_path, rows):
    kind = schemas.schema("year int, area string, w double")
    df = spark.createDataFrame([(2000, "N", 1.5), (2001, None, None)], kind)
    path = writers.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "2001,NA,NA" in text and "year,area,w" in text
    assert rows(readers.read_csv(spark, path, kind)) == rows(df)


def test_spanned_name_and_tee(spark, tmp_path, rows):
    df = spark.createDataFrame([(1999.0, 1), (1975.0, 2)], "year double, v int")
    path = writers.spanned_path(df, str(tmp_path / "catch"), suffix=".csv")
    assert path.endswith("catch_1975_1999.csv")
    kept = writers.write_and_keep(df, str(tmp_path / "kept"))
    assert kept.schema == df.schema and rows(kept) == rows(df)
    assert "Parquet" in kept._jdf.queryExecution().executedPlan().toString() or kept.inputFiles()


def test_name_by_span_in_one_job(spark, tmp_path, rows):
    df = spark.createDataFrame([(1999.0, 1), (1975.0, 2), (None, 3)], "year double, v int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("naming", "one write")
    try:
        for _ in range(2):  # the second replaces the first
            path = writers.write_spanned_csv(df, str(tmp_path / "catch"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("naming")) == 2
    assert path.endswith("catch_1975_1999") and [p.name for p in tmp_path.iterdir()] == ["catch_1975_1999"]
    assert rows(readers.read_csv(spark, path, df.schema)) == rows(df)


@pytest.mark.parametrize("name", [n for n in dir(schemas) if n.isupper() and not n.startswith("_")])
def test_declared_schemas_have_distinct_names(name):
    names = getattr(schemas, name).fieldNames()
    assert names and len(names) == len(set(names))
