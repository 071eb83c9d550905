"""Hand-made frames for the semantic traps of the reports."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from tests.conftest import make_tables
from waterbook.functions.codes import concat_nullsafe, norm, region_name, region_ordinal, region_upper_name
from waterbook.functions.dates import clock_seconds
from waterbook.functions.formatting import blank_zero_grouped, grouped, money_text, pct_trimmed, right_align
from waterbook.functions.growth import growth_hundredths, growth_pct
from waterbook.operators.compare import full_join_periods
from waterbook.params import ArrearsParams, CumulativeArrearsParams, Filters, FleetParams, PeriodCompare, ReadingParams, add_months
from waterbook.plans import arrears, consumption, fleet, readings

P = PeriodCompare.month(5, 2025, 2026)


def cust(cid, street="001", meter="0000001", sub=0, name="A", region="VT", cls="1"):
    return (cid, street, meter, sub, name, region, cls)


def bill(bid, cid, year, month=5, volume=10, cancelled=0, purpose="H", channel="AB", cashier="BAOCQ",
         posted=None, paid=None, is_paid=0, mode=1, a1=0, a=100):
    from decimal import Decimal
    return (bid, cid, year, month, volume, cancelled, purpose, channel, cashier, posted, paid, is_paid, mode,
            Decimal(a1), Decimal(a))


def test_growth_zero_base_policies(spark):
    df = spark.createDataFrame([(0, 5), (0, 0), (0, -3), (10, 15)], "b long, c long")
    got = df.select(
        growth_pct(F.col("b"), F.col("c"), "zero").alias("z"),
        growth_pct(F.col("b"), F.col("c"), "null").alias("n"),
        growth_pct(F.col("b"), F.col("c"), "inf", "ratio").alias("i"),
    ).collect()
    assert [r.z for r in got] == [0.0, 0.0, 0.0, 50.0]
    assert [r.n for r in got] == [None, None, None, 50.0]
    assert got[0].i == math.inf and got[1].i == 0.0 and got[2].i == -math.inf and got[3].i == 50.0


def test_region_codes_dirty_and_null(spark):
    df = spark.createDataFrame([(" bria ",), ("vngtau",), ("ZZ",), (None,), ("xm",)], "c string")
    n = norm(F.col("c"))
    got = df.select(region_name(n).alias("a"), region_ordinal(n).alias("o"), region_upper_name(n).alias("u")).collect()
    assert [r.a for r in got] == ["Bà Rịa", "Vũng Tàu", "Khu vực khác", "Khu vực khác", "Xuyên Mộc"]
    assert [r.o for r in got] == [2, 1, 6, 6, 4]
    assert [r.u for r in got] == ["BÀ RỊA", "VŨNG TÀU", "KHU VỰC KHÁC (ZZ)", "KHU VỰC KHÁC ()", "XUYÊN MỘC"]


def test_concat_null_parts_are_empty(spark):
    df = spark.createDataFrame([("001", None), (None, None)], "a string, b string")
    got = df.select(concat_nullsafe(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == ["001", ""]


def test_full_join_null_key_stays_separate(spark):
    b = spark.createDataFrame([("VT", 5), (None, 7)], "k string, v long")
    c = spark.createDataFrame([("VT", 6), (None, 1), ("LD", 2)], "k string, v long")
    got = sorted(full_join_periods(b, c, "k", "v").collect(), key=lambda r: (r.k is None, r.k or "", r.base))
    assert [(r.k, r.base, r.cmp) for r in got] == [("LD", 0, 2), ("VT", 5, 6), (None, 0, 1), (None, 7, 0)]


def test_purpose_missing_from_base_year_disappears(spark):
    t = make_tables(
        spark,
        customer=[cust(1, region="BR")],
        consumption=[bill(1, 1, 2025, purpose="H", volume=10), bill(2, 1, 2026, purpose="H", volume=20),
                     bill(3, 1, 2026, purpose="k ", volume=99)],
    )
    got = {r.purpose_code: (r.base, r.cmp, r.is_total) for r in consumption.purpose_growth(t, P, "br").collect()}
    assert got == {"H": (10, 20, False), "": (10, 20, True)}


def test_purpose_with_zero_base_volume_is_kept(spark):
    t = make_tables(
        spark,
        customer=[cust(1, region="BR")],
        consumption=[bill(1, 1, 2025, purpose="Q", volume=None), bill(2, 1, 2026, purpose="Q", volume=4)],
    )
    got = [(r.purpose_code, r.base, r.cmp, r.growth_pct) for r in consumption.purpose_growth(t, P, "BR").collect()]
    assert ("Q", 0, 4, 0.0) in got


def test_class_taken_from_comparison_year_then_base(spark):
    # two customer ids share code 001+0000009; each year sees a different id
    t = make_tables(
        spark,
        customer=[cust(1, meter="0000009", cls="CQ"), cust(2, meter="0000009", cls="VIP"), cust(3, meter="0000003", cls=None)],
        street=[("001", 0)],
        consumption=[bill(1, 1, 2025, volume=5), bill(2, 2, 2026, volume=7), bill(3, 3, 2025, volume=1, cancelled=1)],
    )
    got = {r.class_code: (r.base, r.cmp) for r in consumption.class_period_growth(t, P).collect() if not r.is_total}
    # cancelled bills count in this report; a NULL class becomes "unclassified"
    assert got == {"VIP": (5, 7), "CHƯA PHÂN LOẠI": (1, 0)}


def test_cancelled_bills_excluded_from_ytd(spark):
    t = make_tables(
        spark,
        customer=[cust(1, region="VT")],
        street=[("001", 0)],
        consumption=[bill(1, 1, 2025, volume=5), bill(2, 1, 2025, volume=50, cancelled=1), bill(3, 1, 2026, volume=8,
                     cancelled=None)],
    )
    got = {r.region_code: (r.base, r.cmp) for r in consumption.region_ytd_growth(t, PeriodCompare.year_to_date(5, 2025, 2026)).collect()}
    assert got["VT"] == (5, 8)


def test_ytd_null_region_one_row_per_year(spark):
    t = make_tables(
        spark,
        customer=[cust(1, region=None), cust(2, region=None, meter="0000002")],
        street=[("001", 0)],
        consumption=[bill(1, 1, 2025, volume=5), bill(2, 2, 2026, volume=8)],
    )
    rows = [(r.region_code, r.base, r.cmp, r.growth_pct) for r in consumption.region_ytd_growth(t, P).collect()
            if not r.is_total]
    assert sorted(rows, key=lambda x: x[1]) == [(None, 0, 8, None), (None, 5, 0, -100.0)]


def test_paid_flag_without_date_is_not_open(spark):
    d = dt.date(2026, 6, 18)
    t = make_tables(
        spark,
        customer=[cust(1)],
        consumption=[
            bill(1, 1, 2026, posted=dt.date(2026, 6, 1), paid=None, is_paid=1),  # unknown OR false -> not open
            bill(2, 1, 2026, posted=dt.date(2026, 6, 1), paid=None, is_paid=None),  # open
            bill(3, 1, 2026, posted=dt.date(2026, 6, 1), paid=dt.date(2026, 6, 19), is_paid=1),  # paid after
            bill(4, 1, 2026, posted=dt.date(2026, 6, 19), paid=None, is_paid=0),  # posted after cut-off
        ],
    )
    r = {x.cashier: x for x in arrears.arrears_snapshot(t, ArrearsParams(2026, 5, d, None)).collect()}
    assert r["BAOCQ"].cur_total == 2 and r["TỔNG"].cur_total == 2


def test_null_bill_mode_takes_else_arm(spark):
    t = make_tables(
        spark,
        consumption=[bill(1, 1, 2026, mode=None, a1=500, a=0), bill(2, 1, 2026, mode=0, a1=500, a=0),
                     bill(3, 1, 2026, mode=1, a1=500, a=0)],
    )
    assert sorted(r.bill_id for r in arrears.positive_invoices(t).collect()) == [2]


def test_empty_list_include_keeps_nothing_exclude_keeps_all(spark):
    t = make_tables(spark, customer=[cust(1)], consumption=[bill(1, 1, 2025), bill(2, 1, 2026)])
    inc = consumption.region_month_growth_filtered(t, P, Filters(include_customers=""))
    exc = consumption.region_month_growth_filtered(t, P, Filters(exclude_customers=" \r\n, "))
    assert [(r.base, r.cmp) for r in inc.collect()] == [(None, None)]
    assert {(r.region, r.base, r.cmp) for r in exc.collect()} >= {("Vũng Tàu", 10, 10)}


def test_exclude_list_keeps_unmatched_bills(spark):
    t = make_tables(spark, customer=[cust(1)], consumption=[bill(1, 1, 2025), bill(2, 99, 2026, volume=4)])
    exc = consumption.region_month_growth_filtered(t, P, Filters(exclude_customers="0010000001"))
    got = {r.region: (r.base, r.cmp) for r in exc.collect() if not r.is_total}
    assert got == {"Khu vực khác": (0, 4)}


def test_customer_with_one_reading(spark):
    ts = dt.datetime(2026, 3, 1, 8, 0)
    t = make_tables(
        spark,
        customer=[cust(1, street="012", meter="0000034", cls=None)],
        large_reading=[("0120000034", "X", "BR", ts, 40)],
    )
    r = readings.reading_delta(t, ReadingParams("BR", 2026)).collect()
    assert len(r) == 1 and r[0].prev_read_at is None and r[0].prev_volume == 0 and r[0].delta == 40
    assert r[0].class_code == "1"


def test_catalogue_total_covers_classes_outside_catalogue(spark):
    ts = dt.datetime(2026, 3, 1)
    t = make_tables(
        spark,
        customer=[cust(1, meter="0000001", cls="CQ"), cust(2, meter="0000002", cls="VIP")],
        large_reading=[("0010000001", "A", "BR", ts, 10), ("0010000002", "B", "BR", ts, 5)],
    )
    rows = {r.class_code: r for r in readings.reading_class_summary(t, ReadingParams("BR", 2026)).collect()}
    assert rows["CQ"].last_volume == 10 and rows["XD"].last_volume == 0
    assert rows[None].is_total and rows[None].last_volume == 15  # VIP is not in the catalogue
    assert len(rows) == 11


def test_cashier_without_invoices_shows_zero(spark):
    d = dt.date(2026, 6, 18)
    t = make_tables(spark, customer=[cust(1)], consumption=[bill(1, 1, 2026, month=3, posted=dt.date(2026, 3, 5),
                                                                   cashier="bayhv ", channel=None)])
    r = {x.cashier: x for x in arrears.arrears_cumulative(t, CumulativeArrearsParams(2026, 1, 2026, 5, d)).collect()}
    assert r["BAYHV"].open_cash == 1 and r["BAYHV"].open_transfer == 0
    assert r["YENDT"].open_total == 0 and r["TỔNG"].open_total == 1 and len(r) == 7


def test_month_end_clamp():
    assert add_months(dt.date(2026, 3, 31), -1) == dt.date(2026, 2, 28)
    p = ArrearsParams(2026, 1, dt.date(2026, 3, 31))
    assert p.previous_period == (2025, 12) and p.previous_cutoff == dt.date(2026, 2, 28)


def test_touching_trips_do_not_overlap_and_end_equal_now_is_on_road(spark):
    base = dt.datetime(2024, 1, 15, 8, 0)
    trips = spark.createDataFrame(
        [
            (1, 7, "D", "L", "P1", base, base + dt.timedelta(hours=4), 240, 0, None),
            (2, 7, "D", "L", "P2", base + dt.timedelta(hours=4), base + dt.timedelta(hours=5), 60, 0, None),
        ],
        "id long, car long, driver string, leader string, dest string, start_at timestamp_ntz, end_at timestamp_ntz, "
        "duration_min int, km_start long, km_end long",
    )
    p = FleetParams(base + dt.timedelta(hours=4))
    assert fleet.trip_overlaps(trips, p).count() == 0
    status = {r.id: r.on_road for r in fleet.trip_status(trips, p).collect()}
    assert status == {1: True, 2: True}


def test_clock_wraps_midnight_and_equal_times(spark):
    df = spark.createDataFrame([(1380, 60), (540, 565), (600, 600)], "s int, e int")
    got = [r.x for r in df.select(clock_seconds(F.col("s"), F.col("e")).alias("x")).collect()]
    assert got == [7200, 1500, 0]


def test_number_text(spark):
    df = spark.createDataFrame([(0,), (1234567,), (-2500,)], "x long")
    got = df.select(
        blank_zero_grouped(F.col("x")).alias("b"), grouped(F.col("x")).alias("g"), money_text(F.col("x")).alias("m")
    ).collect()
    assert [r.b for r in got] == ["", "1.234.567", "-2.500"]
    assert [r.g for r in got] == ["0", "1.234.567", "-2.500"]
    assert [r.m for r in got] == ["0", "1,234,567", "-2,500"]


def test_half_rounding_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1234.5,)], "x double")
    assert [r.g for r in df.select(grouped(F.col("x")).alias("g")).collect()] == ["3", "-3", "1.235"]
    # 100 * 1 / 8 = 12.5 exactly; 100 * 1 / 3 = 33.33..; 100 * -1 / 8 = -12.5
    g = spark.createDataFrame([(8, 1), (3, 1), (8, -1), (200000, 246913)], "b long, d long")
    got = g.select(pct_trimmed(growth_hundredths(F.col("b"), F.col("d"))).alias("t")).collect()
    assert [r.t for r in got] == ["12,5", "33,33", "-12,5", "123,46"]


def test_right_align_keeps_right_end_and_null(spark):
    df = spark.createDataFrame([("12,5 %",), ("123456789012",), (None,)], "s string")
    got = [r.x for r in df.select(right_align(F.col("s"), 10).alias("x")).collect()]
    assert got == ["    12,5 %", "3456789012", None]


def test_impossible_month_is_not_next_january(spark):
    d = dt.date(2026, 6, 18)
    t = make_tables(
        spark,
        customer=[cust(1)],
        consumption=[bill(1, 1, 2025, month=13, posted=dt.date(2026, 1, 5)), bill(2, 1, 2026, month=1,
                     posted=dt.date(2026, 1, 5))],
    )
    r = {x.cashier: x for x in arrears.arrears_cumulative(t, CumulativeArrearsParams(2026, 1, 2026, 5, d)).collect()}
    assert r["TỔNG"].open_total == 1


def test_growth_hundredths_is_exact_on_large_volumes(spark):
    from fractions import Fraction
    from random import Random

    from pyspark.sql import functions as F

    from waterbook.functions.growth import growth_hundredths

    rnd = Random(5)
    rows = [(7858357388210, 18740855235886)] + [(rnd.randint(1, 10**13), rnd.randint(-(10**13), 10**13)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "b long, d long").select("b", "d", growth_hundredths(F.col("b"), F.col("d")).alias("h"))
    for r in df.collect():
        exact = Fraction(10000 * abs(r.d), r.b)
        want = int(exact + Fraction(1, 2))
        assert r.h == (want if r.d >= 0 else -want)


def test_two_updates_of_one_id_leave_one_row(spark):
    from waterbook.operators.upsert import update_by_key

    rows = spark.createDataFrame([(1, None), (2, 5)], "id long, km long")
    updates = spark.createDataFrame([(1, 7), (1, 9), (3, 1)], "id long, km long")
    got = sorted(tuple(r) for r in update_by_key(rows, updates, "id", ["km"]).collect())
    assert got == [(1, 9), (2, 5)]


def test_json_times_are_wall_clock_in_any_zone(spark):
    from waterbook import schemas
    from waterbook.sources.tables import rejected_trips, typed_trips

    names = [f.name for f in schemas.TRIP_JSON.fields]
    base = dict.fromkeys(names)
    rows = [
        {**base, "id": 1, "start": "2024-03-10T02:30", "end": "2024-03-10T02:30:15", "kmStart": "10.5", "kmEnd": ""},
        {**base, "id": 2, "start": "soon", "end": "2024-03-10T02:30", "kmStart": "x", "kmEnd": None},
    ]
    raw = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.TRIP_JSON)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        first = typed_trips(raw).where("id = 1").collect()[0]
        assert str(first.start_at) == "2024-03-10 02:30:00" and str(first.end_at) == "2024-03-10 02:30:15"
        assert float(first.km_start) == 10.5
        assert [(r.id, r.bad_fields) for r in rejected_trips(raw).collect()] == [(2, ["start", "kmStart"])]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
