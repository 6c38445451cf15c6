"""Operators on hand-made frames, checked against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from haulmark.operators import grid, joins, levels, rows as row_ops, series, stats


def test_lookup_join_matches_missing_to_missing(spark, rows):
    left = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", None, 3)], "k string, d string, v int")
    lookup = spark.createDataFrame([("a", None, "N"), ("b", "x", "S")], "k string, d string, w string")
    out = joins.lookup_join(left, lookup, ["k", "d"], "left")
    assert out.columns == ["k", "d", "v", "w"]
    assert rows(out, "v", "w") == [(1, "N"), (2, None), (3, None)]
    assert joins.lookup_join(left, lookup, ["k", "d"], "inner").count() == 1
    assert joins.lookup_join(left, lookup, ["k", "d"], "inner", null_matches_null=False).count() == 0


def test_duplicate_lookup_rows_fan_out_and_are_reported(spark, rows):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    lookup = spark.createDataFrame([("a", 10), ("a", 11), ("b", 12)], "k string, w int")
    assert joins.lookup_join(left, lookup, ["k"]).count() == 3
    assert rows(joins.duplicate_keys(lookup, ["k"])) == [("a", 2)]


def test_override_takes_the_update_only_where_present(spark, rows):
    df = spark.createDataFrame([("a", "FED"), ("b", None), ("c", "FED")], "k string, waters string")
    updates = spark.createDataFrame([("a", "STATE"), ("b", "STATE"), ("c", None)], "k string, new string")
    out = joins.override_from(df, updates, ["k"], "waters", "new")
    assert out.columns == ["k", "waters"]
    assert rows(out) == [("a", "STATE"), ("b", "STATE"), ("c", "FED")]


def test_below_global_max(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "year int")
    assert rows(row_ops.below_global_max(df, "year")) == [(1,), (2,)]


def test_not_outside_drops_missing(spark, rows):
    df = spark.createDataFrame([(19.9,), (20.0,), (120.0,), (120.1,), (None,)], "x double")
    assert rows(df.filter(~row_ops.outside(F.col("x"), 20, 120))) == [(20.0,), (120.0,)]


def test_stack_fills_absent_columns_and_keeps_duplicates(spark, rows):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1,), (1,)], "x int")
    assert rows(row_ops.stack([a, b])) == [(1, 2), (1, None), (1, None)]


def test_sorts_put_missing_and_undeclared_last(spark):
    df = spark.createDataFrame([("SSEI", 1), ("??", 2), ("PWS", 3), (None, 4), ("NSEI", 5)], "a string, v int")
    got = [r.v for r in row_ops.order_by_levels(df, {"a": ["PWS", "NSEI", "SSEI"]}, ["a", "v"]).collect()]
    assert got == [3, 5, 1, 2, 4]
    assert [r.v for r in row_ops.order_nulls_last(df, "a").collect()][-1] == 4


FISH = [
    (area, sex, year, age)
    for i, (area, sex, year, age) in enumerate(
        itertools.product(["N", "S", None], ["F", "M", None], [2000, 2001], [3, 4, 5])
    )
    for _ in range(i % 4)
]


def test_levels_match_brute_force_and_tell_missing_from_rolled_up(spark, rows):
    df = spark.createDataFrame(FISH, "area string, sex string, year int, age int")
    fine = levels.count_rows(df, ["year", "age", "area", "sex"])
    detail = {"both": ["area", "sex"], "area": ["area"], "sex": ["sex"], "none": []}
    combined = {"area": "ALL", "sex": "ANY"}
    out = levels.by_levels(fine, ["year", "age"], combined, detail, {"n": F.sum("n")})
    want = {}
    for name, kept in detail.items():
        for area, sex, year, age in FISH:
            key = (name, year, age, area if "area" in kept else "ALL", sex if "sex" in kept else "ANY")
            want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:5]: r.n for r in out.collect()} == want


def test_every_level_counts_every_row(spark):
    df = spark.createDataFrame(FISH, "area string, sex string, year int, age int")
    fine = levels.count_rows(df, ["year", "area", "sex"])
    detail = {"both": ["area", "sex"], "area": ["area"], "none": []}
    out = levels.by_levels(fine, ["year"], {"area": "A", "sex": "S"}, detail, {"n": F.sum("n")})
    totals = {r.description: r.t for r in out.groupBy("description").agg(F.sum("n").alias("t")).collect()}
    assert totals == dict.fromkeys(detail, len(FISH))


def test_shares_add_up(spark):
    df = spark.createDataFrame(FISH, "area string, sex string, year int, age int")
    counts = levels.count_rows(df, ["area", "sex", "year", "age"])
    out = stats.share_of_total(counts, "n", ["area", "sex", "year"])
    sums = out.groupBy("area", "sex", "year").agg(F.sum("proportion").alias("s")).collect()
    assert all(abs(r.s - 1) <= 0.00015 for r in sums)


def test_rate_summary_chains_rounded_values(spark, rows):
    df = spark.createDataFrame([("a", 1.234), ("a", 2.345), ("a", None), ("b", 1.0), ("c", None)], "k string, x double")
    out = {r.k: r for r in stats.rate_summary(df, "x", ["k"]).collect()}
    a = out["a"]
    assert (a["mean"], a.sd, a.n) == (1.79, 0.79, 3)
    assert a.se == round(0.79 / 3**0.5, 4)
    assert (a.CV, a.RSE) == (round(0.79 / 1.79, 2), round(a.se / 1.79, 2))
    assert (out["b"]["mean"], out["b"].sd, out["b"].n, out["b"].RSE) == (1.0, None, 1, None)
    assert (out["c"]["mean"], out["c"].n) == (None, 1)


def test_coverage(spark, rows):
    df = spark.createDataFrame([("a", 2000), ("a", 2002), ("a", 2002), ("b", None), ("b", 2001)], "g string, year int")
    assert rows(stats.coverage(df, ["g"])) == [("a", 2000, 2002, 2), ("b", None, None, 2)]
    assert rows(stats.effort_span(df.filter("g = 'a'"), ["g"])) == [("a", 3, 2000, 2002)]


def complete_by_hand(data, cols, combos, fill):
    """Full outer join of the wanted cells with the data; rows are dicts."""
    have = {}
    for row in data:
        have.setdefault(tuple(row[c] for c in cols), []).append(row)
    out = [dict(r) for r in data]
    for combo in combos:
        if combo not in have:
            out.append({**dict.fromkeys(data[0]), **dict(zip(cols, combo))})
    return sorted(
        (tuple(fill.get(c) if r[c] is None and c in fill else r[c] for c in data[0]) for r in out), key=repr
    )


CELLS = [
    {"year": 2000, "area": "N", "gear": "H", "w": 1.0, "note": "x"},
    {"year": 2000, "area": "S", "gear": "P", "w": 2.0, "note": "y"},
    {"year": 2001, "area": None, "gear": "H", "w": None, "note": "z"},
    {"year": 2003, "area": "N", "gear": "Q", "w": 4.0, "note": None},
    {"year": None, "area": "S", "gear": "H", "w": 5.0, "note": None},
]
KIND = "year int, area string, gear string, w double, note string"


def frame(spark, data):
    return spark.createDataFrame([tuple(r.values()) for r in data], KIND)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_complete_global_with_declared_levels(spark):
    declared = {"area": ["N", "S", "L"], "gear": ["H", "P"]}
    out = grid.complete_global(frame(spark, CELLS), ["year", "area", "gear"], declared, {"w": 0.0})
    combos = itertools.product([2000, 2001, 2003, None], declared["area"], declared["gear"])
    assert got(out) == complete_by_hand(CELLS, ["year", "area", "gear"], list(combos), {"w": 0.0})


def test_complete_global_with_present_levels(spark):
    out = grid.complete_global(frame(spark, CELLS), ["year", "area", "gear"], fill={"w": 0.0, "note": "-"})
    combos = itertools.product([2000, 2001, 2003, None], ["N", "S", None], ["H", "P", "Q"])
    want = complete_by_hand(CELLS, ["year", "area", "gear"], list(combos), {"w": 0.0, "note": "-"})
    assert got(out) == want


def test_complete_with_all_levels_declared(spark):
    declared = {"year": [2000, 2001], "area": ["N"], "gear": ["H", "P"]}
    out = grid.complete_global(frame(spark, CELLS), ["year", "area", "gear"], declared, {"w": 0.0})
    combos = itertools.product(declared["year"], declared["area"], declared["gear"])
    assert got(out) == complete_by_hand(CELLS, ["year", "area", "gear"], list(combos), {"w": 0.0})


def test_complete_within_group(spark):
    out = grid.complete(frame(spark, CELLS), ["year", "area"], {"gear": ["H", "P"]}, {"w": 0.0})
    keys = [(r["year"], r["area"]) for r in CELLS]
    combos = [(*k, g) for k in keys for g in ("H", "P")]
    assert got(out) == complete_by_hand(CELLS, ["year", "area", "gear"], combos, {"w": 0.0})


def test_complete_keeps_duplicate_rows(spark):
    data = [*CELLS[:2], CELLS[0]]
    out = grid.complete(frame(spark, data), ["year", "area"], {"gear": ["H", "P"]}, {"w": 0.0})
    combos = [(2000, a, g) for a in ("N", "S") for g in ("H", "P")]
    assert got(out) == complete_by_hand(data, ["year", "area", "gear"], combos, {"w": 0.0})


def test_a_level_named_twice_is_one_level(spark):
    once = grid.complete(frame(spark, CELLS), ["year", "area"], {"gear": ["H", "P"]})
    assert got(grid.complete(frame(spark, CELLS), ["year", "area"], {"gear": ["H", "P", "H"]})) == got(once)


def test_complete_is_idempotent(spark):
    once = grid.complete(frame(spark, CELLS), ["year", "area"], {"gear": ["H", "P"]}, {"w": 0.0})
    twice = grid.complete(once, ["year", "area"], {"gear": ["H", "P"]}, {"w": 0.0})
    assert got(once) == got(twice)


def test_levels_have_no_limit(spark):
    df = spark.range(20_001).select(F.lit(1).alias("a"), F.col("id").alias("b"), F.lit(2.0).alias("w"))
    more = df.union(spark.createDataFrame([(2, 5, 3.0), (None, None, 4.0)], "a int, b long, w double"))
    out = grid.complete_global(more, ["a", "b"], fill={"w": 0.0})
    assert out.count() == 3 * 20_002
    assert out.agg(F.sum("w")).first()[0] == 20_001 * 2.0 + 7.0
    assert grid.complete(more, ["a"], {"b": range(3000)}).count() == 20_001 + 3000 + 3001


def test_complete_has_no_cross_join_and_reads_its_input_once(spark):
    df = frame(spark, CELLS).groupBy("year", "area", "gear").agg(F.sum("w").alias("w"))
    out = grid.complete_global(df, ["year", "area", "gear"], {"area": ["N"], "gear": ["H"]}, {"w": 0.0})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join" not in plan
    assert plan.count("Scan") == 1


def test_splice_rules(spark, rows):
    data = [
        ("N", 1984, "old"), ("N", 1985, "old"), ("N", 1984, "new"), ("N", 1985, "new"), ("S", 1980, "new"),
        ("S", 1980, "old"), ("P", 1970, "new"), ("P", 1970, "old"), ("L", 1990, "new"), (None, 1990, "new"),
    ]
    df = spark.createDataFrame(data, "Mgmt_area string, year int, data_source string")
    rules = [
        series.SpliceRule("N", "old", last_year=1984),
        series.SpliceRule("N", "new", first_year=1985),
        series.SpliceRule("S", "new"),
        series.SpliceRule("P", "new"),
    ]
    assert rows(series.splice(df, rules)) == [
        ("N", 1984, "old"), ("N", 1985, "new"), ("P", 1970, "new"), ("S", 1980, "new"),
    ]


def test_interpolation_fills_inner_gaps_only(spark, rows):
    data = [("a", 2005, None), ("a", 2006, 10.0), ("a", 2007, None), ("a", 2008, None), ("a", 2010, 30.0), ("a", 2011, None)]
    df = spark.createDataFrame([*data, ("b", 2007, None)], "s string, year int, v double")
    assert rows(series.interpolate_gaps(df, ["s"], "year", "v")) == [
        ("a", 2005, None), ("a", 2006, 10.0), ("a", 2007, 15.0), ("a", 2008, 20.0), ("a", 2010, 30.0),
        ("a", 2011, None), ("b", 2007, None),
    ]


def test_interpolation_is_linear_in_the_length_of_a_series(spark):
    import time

    df = spark.range(80_000).select(F.lit(1).alias("s"), "id", F.when(F.col("id") % 10 == 0, F.col("id") * 2.0).alias("v"))
    start = time.perf_counter()
    out = series.interpolate_gaps(df, ["s"], "id", "v")
    assert out.filter(F.abs(F.col("v") - 2 * F.col("id")) > 1e-6).count() == 0
    assert out.filter("v IS NULL").count() == 9
    assert time.perf_counter() - start < 20


def test_interpolation_equals_one_sweep(spark, rows, monkeypatch):
    """Whatever the stretches are, and where known points and rows without ``x`` lie."""
    rng = random.Random(7)
    data = []
    for s in ["a", "b", None]:
        for x in rng.sample(range(-50, 400), 120):
            data.append((s, float(x) ** 3, rng.random() if rng.random() < 0.2 else None))
    data += [("c", 1.0, None), ("d", 2.0, 5.0), ("a", None, 3.0), ("e", None, None)]

    def by_hand(s, x, y):
        if y is not None or x is None:
            return y
        left = max(((a, b) for t, a, b in data if t == s and b is not None and a is not None and a < x), default=None)
        right = min(((a, b) for t, a, b in data if t == s and b is not None and a is not None and a > x), default=None)
        if left is None or right is None:
            return None
        return left[1] + (x - left[0]) * ((right[1] - left[1]) / (right[0] - left[0]))

    want = sorted([(s, x, by_hand(s, x, y)) for s, x, y in data], key=repr)
    for stretches in (1, 7, 256):
        monkeypatch.setattr(series, "STRETCHES", stretches)
        out = series.interpolate_gaps(spark.createDataFrame(data, "s string, x double, v double"), ["s"], "x", "v")
        assert sorted(map(tuple, out.collect()), key=repr) == want


def test_a_long_series_is_spread_over_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("s"), "id", F.when(F.col("id") % 1000 == 0, F.col("id") * 2.0).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = series.interpolate_gaps(df, ["s"], "id", "v").withColumn("_task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("_task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == tasks and max(sizes) < 1.5 * 200_000 / tasks
    assert out.filter(F.abs(F.col("v") - 2 * F.col("id")) > 1e-6).count() == 0


def test_buckets_follow_the_levels(spark):
    """Many levels and few keys: the cells are spread over all tasks."""
    df = spark.range(300_000).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = df.withColumn("_blank", F.lit(False)).unionByName(
            spark.range(4).select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"), F.lit(True).alias("_blank"))
        )
        met = grid._met(rows, "b", df.select(F.col("b").alias("_level"))).filter("_blank")
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4 * 300_000
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == tasks and max(sizes) < 1.5 * min(sizes)


def test_lookups_with_doubled_keys_fail(spark, rows):
    lookup = [(1, "a", 2.0), (1, None, 3.0), (None, "a", 4.0), (7, "x", 1.0), (7, "x", 1.0)]
    kind = "k int, l string, v double"
    left = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, l string")
    good = spark.createDataFrame(lookup, kind)
    for how in ("left", "inner"):
        # 7, x is doubled, but nothing matches it
        plain, checked = (joins.lookup_join(left, good, ["k", "l"], how, unique=u) for u in (False, True))
        assert rows(plain) == rows(checked) and plain.columns == checked.columns
        bad = spark.createDataFrame([*lookup, (1, None, 9.0)], kind)
        with pytest.raises(Exception, match="several rows for k, l = 1, NULL"):
            joins.lookup_join(left, bad, ["k", "l"], how, unique=True).select("v").count()


def test_the_lowest_tick_is_no_window_over_all_rows(spark):
    plan = series.tick_labels(spark.range(100).toDF("y"), "y", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan


def test_newest_goes_from_the_groups(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "c")], "year int, k string")
    assert rows(row_ops.without_newest(df, "year")) == [(1, "a")]


@pytest.mark.parametrize(
    ("values", "step", "labelled"),
    [
        ([1975, 1980, 1982, 1985], 5, ["1975", "1980", "1985"]),
        ([1907, 1910, 1920, 1923], 10, ["1910", "1920"]),
        ([1974, 1975, 1976, 1978], 2, ["1974", "1976", "1978"]),
        ([1, 5, 10], 5, ["5", "10"]),
    ],
)
def test_tick_labels(spark, values, step, labelled):
    df = spark.createDataFrame([(v,) for v in values * 2], "year int")
    out = {r.breaks: r.labels for r in series.tick_labels(df, "year", step).collect()}
    assert sorted(out) == sorted(values)
    assert sorted((v for v in out.values() if v), key=int) == labelled
