"""A key holding a third of the rows: results stay exact and work spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tests.test_properties import _brute_pairs
from waterbook import catalog as C
from waterbook.operators import intervals
from waterbook.plans import consumption, fleet
from waterbook.sources.tables import Tables


def test_hot_car_overlaps_exact_and_spread(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    hot = t.trip.withColumn("car", F.when(F.col("id") % 3 == 0, F.lit("-7")).otherwise(F.col("car")))
    rows = [(r.id, r.car, r.start_at, r.end_at) for r in hot.select("id", "car", "start_at", "end_at").collect()]
    got = {tuple(r) for r in fleet.trip_overlaps(hot, C.FLEET).collect()}
    assert got == _brute_pairs(rows)

    # what the join really compares, before times are looked at
    columns = "car", "id", "start_at", "end_at", C.FLEET.overlap_bucket_minutes
    for trips in (t.trip, hot):
        n, pairs = trips.count(), fleet.trip_overlaps(trips, C.FLEET).count()
        met = intervals.meetings(trips, *columns)
        assert met.count() <= 5 * pairs + n
    per_key = met.groupBy("a.k", "a.level", "a.b").count().agg(F.max("count")).first()[0]
    hot_rows = hot.where(F.col("car") == "-7").count()
    assert per_key * 20 < hot_rows**2  # the hot car is spread over many join keys


def test_hot_customer_is_combined_before_the_shuffle(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    hot = t.with_table(
        "consumption",
        t.consumption.withColumn(
            "customer_id", F.when(F.col("bill_id") % 3 == 0, F.lit(1)).otherwise(F.col("customer_id"))
        ),
    )
    df = consumption.region_month_growth(hot, C.MONTH)
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    first_exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(customer_id" in line)
    assert "partial_sum" in lines[first_exchange + 1]  # map-side combine feeds the shuffle
    # totals still equal a plain per-region sum over the bills
    bills = consumption.period_bills(hot, C.MONTH).join(
        hot.customer.select("customer_id", "region_code"), "customer_id", "left"
    )
    plain = bills.agg(
        F.sum(F.when(F.col("year") == C.MONTH.cmp_year, F.coalesce("volume", F.lit(0)))).alias("cmp")
    ).first()[0]
    total = [r for r in df.collect() if r.is_total][0]
    assert total.cmp == plain


def test_replacement_sweep_equals_pairs(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    hot = t.trip.withColumn("car", F.when(F.col("id") % 3 == 0, F.lit("-7")).otherwise(F.col("car")))
    for trips in (t.trip, hot):
        pairs = {r.id for r in fleet.trips_after_replacement(trips, C.FLEET).select("id").collect()}
        sweep = {r.id for r in fleet.trips_after_replacement(trips, C.FLEET, method="sweep").select("id").collect()}
        assert pairs == sweep
