"""Results must not depend on how rows are spread, nor on one key holding most of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from haulmark.operators import totals
from haulmark.operators.joins import lookup_join
from haulmark.operators.stats import rate_summary
from haulmark.plans import effort, landings

KEYS = ["stat_area", "stat_area_type"]


@pytest.fixture
def skewed(spark):
    """A third of the landings come from one stat area, year and gear."""
    i = F.col("id")
    hot = i % 3 == 0
    rows = spark.range(6000).select(
        F.when(hot, 1).otherwise(i % 40).cast("string").alias("stat_area"),
        F.lit("G").alias("stat_area_type"),
        F.when(hot, 2000).otherwise(1995 + i % 9).cast("string").alias("year"),
        F.when(hot, "61").otherwise(F.element_at(F.array(*map(F.lit, ["06", "91", "07", "26"])), (1 + i % 4).cast("int"))).alias("gear_code"),
        (i % 1000 / 7).alias("pounds"),
        F.when(i % 5 == 0, 0.0).otherwise(i % 977 / 3).alias("whole_pounds"),
    )
    areas = spark.range(40).select(
        F.col("id").cast("string").alias("stat_area"),
        F.lit("G").alias("stat_area_type"),
        F.lit("STATE").alias("waters"),
        F.lit(None).cast("timestamp").alias("start_date"),
        F.lit(None).cast("timestamp").alias("end_date"),
        F.element_at(F.array(*map(F.lit, ["NSEI", "SSEI", "PWSE"])), (1 + F.col("id") % 3).cast("int")).alias("g_mgt_area_district"),
    )
    updates = areas.filter("stat_area = '5'").select(
        "stat_area", "start_date", "end_date", F.lit("FED").alias("updated_waters")
    )
    return rows, areas, updates


def test_catch_is_bit_equal_for_any_partitioning(spark, skewed, rows):
    landed, areas, updates = skewed
    results = [
        rows(landings.catch_by_year_area_gear(landed.repartition(n, *by), areas, updates))
        for n, by in ((1, []), (13, []), (5, ["stat_area"]))
    ]
    assert results[0] == results[1] == results[2]


def test_catch_shuffles_sums_not_rows(spark, skewed):
    plan = landings.catch_by_year_area_gear(*skewed)._jdf.queryExecution().executedPlan().toString()
    # The first exchange on the landings side sits above a partial aggregate.
    landed = plan[plan.index("Exchange hashpartitioning(stat_area") :]
    assert "partial_sum" in landed.splitlines()[1]
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_statistics_are_bit_equal_for_any_partitioning(spark, skewed):
    landed = skewed[0]
    stats = {"t": totals.total(), "m": totals.mean(), "sd": totals.sd(), "r": totals.sd(1)}
    parts = [totals.exact_parts(landed.repartition(n), [], "pounds", spread=True) for n in (1, 3, 17)]
    results = {tuple(totals.exact_totals(p, [], **stats).first()) for p in parts}
    assert len(results) == 1


def test_row_level_join_splits_a_hot_key(spark, skewed):
    """With the lookup too large to broadcast, the adaptive join splits the hot area."""
    landed, areas, _ = skewed
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lookup = areas.select(*KEYS, "waters")
        out = lookup_join(landed.select(*KEYS, "pounds").repartition(16), lookup, KEYS, "inner")
        assert len(out.collect()) == 6000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rates_are_bit_equal_for_any_partitioning(spark, rows):
    i = F.col("id")
    sets = spark.range(200_000).select(
        (1990 + i % 100).alias("year"),
        (i % 200).cast("string").alias("Mgmt_area"),
        (i % 7).cast("string").alias("Stat"),
        ((i * 7919 % 10_007) / 977 / (1 + i % 13)).alias("std_cpue"),
    )
    sizes = spark.range(7).select(F.col("id").cast("string").alias("Stat"), (F.col("id") / 3).alias("stat_km2"))
    summaries = [rows(rate_summary(sets.repartition(n), "std_cpue", ["year", "Mgmt_area"])) for n in (1, 3, 17)]
    assert summaries[0] == summaries[1] == summaries[2]
    indices = [rows(effort.rpn_index(sets.repartition(n), sizes)) for n in (1, 3, 17)]
    assert indices[0] == indices[1] == indices[2]
