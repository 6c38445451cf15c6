"""Column rules on hand-made rows."""

from __future__ import annotations

import math
import random
import statistics
from datetime import date, datetime
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulmark.functions.text import whole_number
from haulmark.functions import categories, dates, measures, nulls, text
from haulmark.operators import totals


def summed(df, **outputs):
    """The outputs over all of ``x``."""
    return totals.exact_totals(totals.exact_parts(df, [], "x", spread=True), [], **outputs).first()


def one(spark, value, kind, expression):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression.alias("y")).first().y


def test_strict_aggregates_turn_null_on_any_missing_value(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    plain = df.groupBy("k").agg(
        nulls.strict_min("x").alias("lo"), nulls.strict_max("x").alias("hi"), nulls.row_count().alias("n")
    )
    sums = totals.exact_totals(
        totals.exact_parts(df, ["k"], "x", spread=True),
        ["k"],
        s=totals.total(strictly=True),
        known=totals.total(),
        m=totals.mean(strictly=True),
        sd=totals.sd(strictly=True),
    )
    got = rows(sums.join(plain, "k"))
    assert got[0] == ("a", None, 1.0, None, None, None, None, 2)
    assert got[1] == ("b", 6.0, 6.0, 3.0, pytest.approx(math.sqrt(2)), 2.0, 4.0, 2)


def test_exact_sum_ignores_row_order_and_keeps_sign(spark):
    values = [0.1] * 1000 + [-3.37, 1e9 + 0.25, -1e9]
    for order in (values, values[::-1], sorted(values)):
        df = spark.createDataFrame([(v,) for v in order], "x double").repartition(7)
        assert summed(df, t=totals.total())[0] == 96.88


def test_exact_sum_keeps_small_digits(spark):
    tiny = spark.range(100_000).select(F.lit(0.00004).alias("x"), (F.col("id") * 1e-9).alias("y"))
    both = totals.exact_sums(tiny, [], {"x": F.col("x"), "y": F.col("y")}).first()
    assert both[:] == (4.0, 4.99995)
    mixed = spark.createDataFrame([(1e12 + 0.25,), (-1e12,), (1e-12,), (-0.3,), (123456.789012,)], "x double")
    assert summed(mixed, t=totals.total())[0] == pytest.approx(123456.739012, abs=1e-9)


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
def test_no_number_makes_strict_totals_missing(spark, odd):
    df = spark.createDataFrame([(1.0,), (odd,)], "x double")
    strict = {"t": totals.total(strictly=True), "m": totals.mean(strictly=True), "r": totals.mean(1, strictly=True)}
    got = summed(df, **strict, known=totals.total())
    assert got[:] == (None, None, None, 1.0)


def test_whole_number_of_what_is_none(spark):
    for text in ("NaN", "3e9", "x", "inf"):
        assert one(spark, text, "string", whole_number("x")) is None


def test_moments_have_room(spark):
    df = spark.range(1_100_000).select((F.lit(300_000.0) + F.col("id") % 2).alias("x"))
    assert summed(df, m=totals.mean(1), sd=totals.sd(3))[:] == (300_000.5, 0.5)


def test_exact_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert summed(df, t=totals.total(), m=totals.mean(1), sd=totals.sd(1))[:] == (None, None, None)


def test_sd_needs_two_rows(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert summed(df, sd=totals.sd(), r=totals.sd(1), m=totals.mean(1))[:] == (None, None, 3.0)


@pytest.mark.parametrize(
    ("values", "mean", "sd"),
    [([85.2, 120.9], 103.0, 25.2), ([85.3, 120.8, 103.05], 103.0, 17.8), ([1.0, 1.0, 1.0], 1.0, 0.0)],
)
def test_rounded_statistics_round_true_ties_to_even(spark, values, mean, sd):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert summed(df, m=totals.mean(1), sd=totals.sd(1))[:] == (mean, sd)


@pytest.mark.parametrize("value", [123.00005, 0.00015, -7.33335, 57.3, 1 / 3])
def test_equal_values_have_no_spread(spark, value):
    df = spark.createDataFrame([(value,)] * 7, "x double")
    assert summed(df, r=totals.sd(4), sd=totals.sd())[:] == (0.0, 0.0)


def test_moments_add_up_over_groups(spark):
    rng = random.Random(5)
    data = [(rng.choice("abc"), round(rng.gauss(60, 9), 1)) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, x double")
    fine = totals.exact_parts(df, ["k"], "x", spread=True)
    got = totals.exact_totals(totals.add_parts(fine, []), [], m=totals.mean(3), sd=totals.sd(3)).first()
    values = [x for _, x in data]
    assert got[:] == (
        pytest.approx(statistics.mean(values), abs=6e-4),
        pytest.approx(statistics.stdev(values), abs=6e-4),
    )


def test_rounded_sd_matches_plain_sd_for_large_values(spark):
    values = [123456.7, 98765.4, 150000.1, 222222.2]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got, plain = summed(df, sd=totals.sd(3))[0], df.agg(F.stddev_samp("x")).first()[0]
    assert got == pytest.approx(plain, abs=1e-3)


MAGNITUDES = {
    "far apart": [100000.0, 200000.0, 1.0, 2.0],
    "large": [1e8, 2e8],
    "beyond a long": [9.3e18, -1.0, 4e25],
    "tiny": [4e-13, 5e-13, 1.7e-13],
    "subject to cancellation": [1e12 + 0.25, -1e12, 1e-12, -0.3],
    "edges of classes": [2.0**24, 2.0**24 - 2.0**-29, 1 - 2.0**-53, -(2.0**48), 2.0**-24, 1.0],
    "widest": [1e300, -1e300, 1.0, 1e-250],
    "near each other": [1e9 + 1.25, 1e9 + 3.5, 1e9],
}


@pytest.mark.parametrize("name", MAGNITUDES)
def test_numbers_of_any_magnitude(spark, name):
    values = MAGNITUDES[name]
    exact = [Fraction(v) for v in values]
    mean = sum(exact) / len(exact)
    variance = sum((v - mean) ** 2 for v in exact) / (len(exact) - 1)
    root = Fraction(math.isqrt(int(variance * 4**1200))) / 2**1200
    df = spark.createDataFrame([(v,) for v in values], "x double")
    outputs = {"t": totals.total(), "m": totals.mean(), "sd": totals.sd()}
    got = {summed(df.repartition(n), **outputs)[:] for n in (1, 2, 4)}
    assert len(got) == 1
    for value, want in zip(got.pop(), (sum(exact), mean, root), strict=True):
        assert value == pytest.approx(float(want), rel=1e-13)


def test_no_digit_is_lost(spark):
    same = spark.range(100_000).select(F.lit(4e-13).alias("x"))
    assert summed(same, t=totals.total())[0] == 4e-8
    for values in ([1e9 + 3e-7], [1e9, 3e-7], [3e-7, 0.0, 1e9]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert summed(df, t=totals.total())[0] == 1e9 + 3e-7


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e100, 1e100, allow_subnormal=False).filter(lambda x: x == 0 or abs(x) > 1e-200), min_size=1, max_size=12))
def test_totals_are_the_double_nearest_to_the_true_one(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = float(sum(map(Fraction, values)))
    assert summed(df, t=totals.total())[0] == pytest.approx(want, rel=2.0**-52, abs=0)


def test_distinct_counts_missing_once(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", None), ("b", 2)], "k string, y int")
    assert rows(df.groupBy("k").agg(nulls.distinct_with_null("y"))) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize(("x", "want"), [(1, "yes"), (9, "no"), (None, None)])
def test_if_else_is_null_for_an_unknown_condition(spark, x, want):
    assert one(spark, x, "int", nulls.if_else(F.col("x") < 5, F.lit("yes"), F.lit("no"))) == want


@pytest.mark.parametrize(("x", "want"), [("a", False), ("b", True), (None, True)])
def test_negated_membership_keeps_missing(spark, x, want):
    assert one(spark, x, "string", ~nulls.is_in("x", ["a"])) is want


@pytest.mark.parametrize(("x", "want"), [(0.0, 7.0), (3.0, 3.0), (None, None)])
def test_zero_fallback_fires_on_zero_only(spark, x, want):
    assert one(spark, x, "double", nulls.zero_fallback("x", F.lit(7.0))) == want


def test_null_to(spark):
    assert one(spark, None, "int", nulls.null_to("x", 0)) == 0


@pytest.mark.parametrize(("x", "want"), [("61", "HAL"), ("06", "HAL"), ("91", "POT"), ("zz", None), (None, None)])
def test_map_codes(spark, x, want):
    assert one(spark, x, "string", categories.map_codes("x", {"HAL": ["61", "06"], "POT": ["91"]})) == want


def test_category_default(spark):
    conditions = {"small": F.col("x") < 10, "tiny": F.col("x") < 3}
    assert one(spark, 20, "int", categories.derive_category(conditions, "big")) == "big"


@pytest.mark.parametrize(("x", "want"), [(30, 30), (31, 31), (45, 31), (None, None)])
def test_plus_group(spark, x, want):
    assert one(spark, x, "int", measures.plus_group("x", 31)) == want


@pytest.mark.parametrize(("x", "want"), [(12.0, 41.0), (50.5, 50.5), (120.0, 99.0), (None, None)])
def test_clamp(spark, x, want):
    assert one(spark, x, "double", measures.clamp("x", 41.0, 99.0)) == want


@pytest.mark.parametrize(
    ("x", "want"),
    [
        (40.0, "41"), (41.0, "41"), (41.9, "41"), (42.0, "43"), (43.9, "43"), (44.0, "45"), (97.9, "97"),
        (98.0, "99"), (99.0, "99"), (99.1, "99"), (120.0, "99"), (None, None),
    ],
)
def test_length_bins_close_on_the_right(spark, x, want):
    assert one(spark, x, "double", measures.length_bin("x")) == want


def test_every_tenth_lands_in_the_bin_of_its_decimal_text(spark):
    df = spark.range(400, 1000).select((F.col("id") / 10).alias("x"), F.col("id").alias("t"))
    got = {r.t: r.b for r in df.select("t", measures.length_bin("x").alias("b")).collect()}
    for t, label in got.items():
        clamped = min(max(t, 410), 990)
        assert label == str(41 + 2 * max(-((419 - clamped) // 20) if clamped > 419 else 0, 0)), t


@pytest.mark.parametrize(("x", "want"), [(39.9, None), (39.95, "41"), (99.95, None)])
def test_values_outside_every_bin_are_null(spark, x, want):
    expression = measures.bin_right_closed("x", "39.9", "2", measures.LENGTH_BINS)
    assert one(spark, x, "double", expression) == want


@pytest.mark.parametrize(
    ("year", "want"),
    [(1985, 118), (1996, 118), (1997, 72), (1998, 64), (1999, 64), (2000, 78), (2018, 78), (None, None)],
)
def test_spacing_by_year(spark, year, want):
    assert one(spark, year, "int", measures.spacing_by_year("x")) == want


def test_standard_hooks(spark):
    meters = measures.survey_inches_to_meters(F.lit(78))
    want = 2.2 * 100 * (1 - math.exp(-0.57 * 78 * 0.0254))
    assert one(spark, 100, "int", measures.standard_hooks("x", meters)) == pytest.approx(want, rel=1e-14)


@pytest.mark.parametrize(("year", "want"), [(1996, 1.43 * 10.0), (1997, 10.0), (None, None)])
def test_soak_factor(spark, year, want):
    assert one(spark, year, "int", measures.soak_adjusted(F.lit(10.0), "x")) == want


def test_the_two_inch_factors_differ(spark):
    survey = one(spark, 100.0, "double", measures.survey_inches_to_meters("x"))
    fishery = one(spark, 100.0, "double", measures.fishery_inches_to_meters("x"))
    assert survey == 2.54 and fishery == 100 / 39.37 and survey != fishery


def test_ratio_by_zero_is_null(spark):
    assert one(spark, 0.0, "double", measures.ratio(F.lit(1.0), "x")) is None


@pytest.mark.parametrize(("x", "want"), [(2.5, 2.0), (3.5, 4.0), (-2.5, -2.0)])
def test_rounding_is_half_to_even(spark, x, want):
    assert one(spark, x, "double", measures.round_even("x", 0)) == want


@pytest.mark.parametrize(
    ("x", "want"), [(200, None), (201, 3), (300, 3), (301, 4), (600, 5), (800, 6), (1000, 7), (1001, None)]
)
def test_depth_stratum(spark, x, want):
    assert one(spark, x, "int", measures.depth_stratum("x")) == want


@pytest.mark.parametrize(("x", "want"), [("Brand#19", 19.0), ("13/0 or 14", 13014.0), ("mixed", None), (None, None)])
def test_digits_to_number(spark, x, want):
    assert one(spark, x, "string", text.digits_to_number("x")) == want


@pytest.mark.parametrize(("x", "want"), [("1999", 1999), ("2e3", 2000), ("n/a", None), (None, None)])
def test_whole_number(spark, x, want):
    assert one(spark, x, "string", text.whole_number("x")) == want


@pytest.mark.parametrize(("x", "want"), [("NSEI", "p_NSEI"), (None, "p_NA")])
def test_prefixed_label(spark, x, want):
    assert one(spark, x, "string", text.prefixed_label("p_", "x")) == want


def test_hours_keep_sign_and_fraction(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(
            [(datetime(2018, 6, 1, 6), datetime(2018, 6, 2, 7, 30)), (datetime(2018, 6, 2), datetime(2018, 6, 1))],
            f"a {kind}, b {kind}",
        )
        got = [r[0] for r in df.select(dates.hours_between("a", "b")).collect()]
        assert got == [25.5, -24.0]


def test_dates_are_taken_in_utc_whatever_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Juneau")
        df = spark.sql("SELECT timestamp'2018-06-01T23:30:00-08:00' AS t, timestamp_ntz'2018-06-01 23:30:00' AS w")
        day = dates.utc_date(df, "t")
        got = df.select(day, dates.day_of_year(day), dates.utc_date(df, "w")).first()
        assert got[:] == (date(2018, 6, 2), 153, date(2018, 6, 1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_in_years_is_a_closed_range(spark, rows):
    stamps = [(datetime(1995, 12, 31, 23, 59),), (datetime(1996, 1, 1),), (datetime(1998, 12, 31, 23, 59),), (datetime(1999, 1, 1),)]
    df = spark.createDataFrame(stamps, "t timestamp_ntz")
    assert [r[0].year for r in rows(df.filter(dates.in_years("t", 1996, 1998)))] == [1996, 1998]
