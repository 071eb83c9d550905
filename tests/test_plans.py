"""Plan shape: the optimisations the design relies on are really there."""

from __future__ import annotations

from tests.conftest import SF_CHECK
from waterbook import catalog as C
from waterbook.params import Filters
from waterbook.operators import intervals
from waterbook.plans import arrears, consumption, fleet, readings
from waterbook.sources.tables import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_uses_window_group_limit(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    p = plan(consumption.region_top_customers(t, C.MONTH))
    assert "WindowGroupLimit" in p


def test_latest_two_readings_use_window_group_limit(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    assert "WindowGroupLimit" in plan(readings.reading_delta(t, C.READING))


def test_month_report_never_touches_street(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    p = optimized(consumption.region_month_growth_filtered(t, C.MONTH, Filters(class_code="VIP")))
    assert "n_nationkey" not in p


def test_comparisons_scan_the_fact_once(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    for df in (
        consumption.region_ytd_growth(t, C.YTD),
        consumption.purpose_growth(t, C.MONTH, C.REGION),
        consumption.class_period_growth(t, C.CLASS_PERIOD),
        consumption.region_month_growth(t, C.MONTH),
    ):
        assert optimized(df).count("Relation [o_orderkey") == 1, optimized(df)


def test_sectioned_report_is_one_pipeline(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    p = optimized(consumption.region_sectioned_report(t, C.MONTH))
    assert p.count("Relation [o_orderkey") == 1
    assert p.count("Relation [c_custkey") == 1
    assert p.count("Join ") == 1


def test_counts_and_sums_come_before_join_exchanges(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    for df, part in (
        (arrears.arrears_cumulative(t, C.CUMULATIVE), "partial_count"),
        (consumption.region_growth_rollup(t, C.MONTH), "partial_sum"),
    ):
        lines = plan(df).splitlines()
        moved = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(customer_id" in line)
        assert part in lines[moved + 1]
        # Expand, if any, stands above a finished aggregate
        for i, line in enumerate(lines):
            if "Expand" in line:
                assert any("HashAggregate" in x or "Union" in x for x in lines[i + 1 : i + 4])


def test_replacement_makes_no_pair_rows(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    p = optimized(fleet.trips_after_replacement(t.trip, C.FLEET))
    assert "Join LeftSemi" in p and "Join Inner" not in p


def test_endless_order_touches_few_buckets(spark):
    rows = [(1, 7, "2024-01-01 08:00", "9999-12-31 00:00"), (2, 7, "2024-03-01 08:00", "2024-03-01 09:00")]
    trips = spark.createDataFrame(rows, "id long, car long, s string, e string").selectExpr(
        "id", "car", "cast(s as timestamp_ntz) as start_at", "cast(e as timestamp_ntz) as end_at"
    )
    assert intervals.meetings(trips, "car", "id", "start_at", "end_at").count() < 10
    pairs = intervals.overlapping_pairs(trips, "car", "id", "start_at", "end_at")
    assert [tuple(r) for r in pairs.collect()] == [(7, 1, 2)]


def test_reading_year_pushed_as_range(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    p = plan(readings.reading_delta(t, C.READING))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in p and "LessThan(ts,2025-01-01T00:00)" in p
