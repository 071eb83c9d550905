"""Properties of the reports on the generated tables."""

from __future__ import annotations

import datetime as dt
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from waterbook import catalog as C
from waterbook.operators.intervals import overlapping_pairs
from waterbook.plans import arrears, consumption, fleet
from waterbook.sources.tables import Tables


def _tables(spark):
    return Tables.from_generated(spark, SF_CHECK)


def _total_equals_detail(df, measures=("base", "cmp", "diff")):
    rows = df.collect()
    detail = [r for r in rows if not r.is_total]
    (total,) = [r for r in rows if r.is_total]
    for m in measures:
        assert sum(getattr(r, m) for r in detail) == getattr(total, m), m


def test_totals_add_up(spark):
    t = _tables(spark)
    _total_equals_detail(consumption.region_month_growth(t, C.MONTH))
    _total_equals_detail(consumption.region_month_growth_filtered(t, C.MONTH))
    _total_equals_detail(consumption.region_ytd_growth(t, C.YTD))
    _total_equals_detail(consumption.purpose_growth(t, C.MONTH, C.REGION))
    _total_equals_detail(consumption.purpose_growth(t, C.YTD, C.REGION))
    _total_equals_detail(consumption.class_period_growth(t, C.CLASS_PERIOD))
    _total_equals_detail(arrears.arrears_snapshot(t, C.ARREARS), ("cur_total", "prev_total", "diff"))
    _total_equals_detail(arrears.arrears_cumulative(t, C.CUMULATIVE), ("open_total", "open_cash", "open_transfer"))


def test_doubling_volume_keeps_growth(spark):
    t = _tables(spark)
    doubled = t.with_table("consumption", t.consumption.withColumn("volume", F.col("volume") * 2))
    a = {r.region: r.growth_pct for r in consumption.region_month_growth_filtered(t, C.MONTH).collect()}
    b = {r.region: r.growth_pct for r in consumption.region_month_growth_filtered(doubled, C.MONTH).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k] - b[k]) < 1e-9


def test_kpi_equals_region_total(spark):
    t = _tables(spark)
    kpi = consumption.kpi_status(t, C.MONTH).collect()[0]
    total = [r for r in consumption.region_month_growth(t, C.MONTH).collect() if r.is_total][0]
    assert (kpi.base, kpi.cmp, kpi.diff) == (total.base, total.cmp, total.diff)


def test_available_plus_on_road_is_fleet(spark):
    t = _tables(spark)
    avail = {r.car for r in fleet.vehicles_available(t.fleet, t.trip, t.vehicle_profile, C.FLEET).collect()}
    road = {r.car for r in fleet.on_road_cars(t.trip, C.FLEET).collect()}
    fleet_cars = {r.car for r in t.fleet.collect()}
    assert avail | road == fleet_cars and not (avail & road)


def _brute_pairs(rows):
    out = set()
    for a, b in itertools.combinations(rows, 2):
        if a[1] != b[1]:
            continue
        x, y = (a, b) if a[0] < b[0] else (b, a)
        if x[2] is None or x[3] is None or y[2] is None or y[3] is None:
            continue
        if x[2] < y[3] and x[3] > y[2]:
            out.add((x[1], x[0], y[0]))
    return out


T0 = dt.datetime(2024, 1, 1)
interval = st.tuples(
    st.integers(0, 3),
    st.one_of(st.none(), st.integers(0, 3 * 1440)),
    st.one_of(st.none(), st.integers(-600, 2000)),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, min_size=0, max_size=25), st.sampled_from([60, 240, 1440]))
def test_bucketed_overlap_equals_brute_force(spark, items, bucket):
    rows = []
    for i, (car, start, length) in enumerate(items):
        s = None if start is None else T0 + dt.timedelta(minutes=start)
        e = None if (start is None or length is None) else s + dt.timedelta(minutes=length)
        rows.append((i, car, s, e))
    df = spark.createDataFrame(rows, "id long, car long, s timestamp_ntz, e timestamp_ntz")
    got = {tuple(r) for r in overlapping_pairs(df, "car", "id", "s", "e", bucket).collect()}
    assert got == _brute_pairs(rows)


def test_overlap_is_symmetric_and_replacement_matches_sequential(spark):
    t = _tables(spark)
    trips = t.trip.select("id", "car", "start_at", "end_at").collect()
    pairs = {(r.first_id, r.second_id) for r in fleet.trip_overlaps(t.trip, C.FLEET).collect()}
    by_car = {}
    for r in trips:
        by_car.setdefault(r.car, []).append(r)
    # sequential replay of the "replace" policy, in id order
    kept = {}
    for r in sorted(trips, key=lambda r: r.id):
        log = kept.setdefault(r.car, [])
        log[:] = [x for x in log if not (r.start_at < x.end_at and r.end_at > x.start_at)]
        log.append(r)
    survivors = {x.id for log in kept.values() for x in log}
    got = {r.id for r in fleet.trips_after_replacement(t.trip, C.FLEET).collect()}
    assert got == survivors
    for a, b in pairs:
        assert a < b


def _replay_refuse(rows):
    kept = {}
    for r in sorted(rows, key=lambda r: r.id):
        if r.start_at is None or r.end_at is None:
            kept.setdefault("__none", []).append(r)
            continue
        log = kept.setdefault(r.car, [])
        if not any(r.start_at < x.end_at and r.end_at > x.start_at for x in log):
            log.append(r)
    return {x.id for log in kept.values() for x in log}


def test_refuse_policy_matches_sequential_replay(spark):
    t = _tables(spark)
    trips = t.trip.select("id", "car", "start_at", "end_at").collect()
    got = {r.id for r in fleet.trips_after_refusal(t.trip, C.FLEET).collect()}
    assert got == _replay_refuse(trips)
    assert len(got) < len(trips)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(interval, min_size=0, max_size=30))
def test_refuse_policy_random(spark, items):
    from collections import namedtuple

    Row = namedtuple("Row", "id car start_at end_at")
    rows = []
    for i, (car, start, length) in enumerate(items):
        s = None if start is None else T0 + dt.timedelta(minutes=start)
        e = None if (start is None or length is None) else s + dt.timedelta(minutes=length)
        rows.append(Row(i, car, s, e))
    df = spark.createDataFrame(rows, "id long, car long, start_at timestamp_ntz, end_at timestamp_ntz")
    got = {r.id for r in fleet.trips_after_refusal(df, C.FLEET).collect()}
    assert got == _replay_refuse(rows)


def test_back_to_back_trips_are_separate_components(spark):
    from waterbook.operators.intervals import overlap_components

    rows = [(i, 1, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + 1)) for i in range(48)]
    rows.append((100, 1, T0 + dt.timedelta(minutes=30), T0 + dt.timedelta(minutes=90)))  # overlaps 0 and 1
    df = spark.createDataFrame(rows, "id long, car long, s timestamp_ntz, e timestamp_ntz")
    comps = {r.id: (r.component_lo, r.component_id) for r in overlap_components(df, "car", "id", "s", "e").collect()}
    assert comps[0] == comps[1] == comps[100]
    assert len(set(comps.values())) == 47  # {0, 1, 100} together, the other 46 trips alone
