"""Row numbers of a whole ordering and arrears at many cut-offs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from waterbook import catalog as C
from waterbook.operators.ordering import numbered
from waterbook.params import CumulativeArrearsParams
from waterbook.plans import arrears, consumption, present
from waterbook.sources.tables import Tables


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    df = df.repartition(7)
    got = numbered(df, F.col("g").desc_nulls_last(), F.col("k").asc()).collect()
    want = sorted(got, key=lambda r: (r.g is None, -(r.g or 0), r.k))
    assert [r.row_no for r in want] == list(range(1, 5001))


def test_one_value_and_no_rows(spark):
    same = spark.range(100).select(F.lit(1).alias("k"))
    assert sorted(r.row_no for r in numbered(same, F.col("k")).collect()) == list(range(1, 101))
    assert numbered(same.limit(0), F.col("k")).collect() == []


def test_numbers_are_the_printed_order(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    report = arrears.arrears_cumulative(t, C.CUMULATIVE)
    printed = [r.cashier for r in report.orderBy(*present.printed_order("cashier")).collect()]
    rows = sorted(present.numbered_rows(report, "cashier").collect(), key=lambda r: r.row_no)
    assert [r.cashier for r in rows] == printed and rows[-1].is_total


def test_regions_of_one_ordinal_are_printed_by_code(spark):
    rows = [("TOTAL", 6, True, 60, 66), ("ZZ", 6, False, 5, 5), ("AA", 6, False, 9, 1), (None, 6, False, 7, 0), (None, 6, False, 0, 8), ("VT", 1, False, 1, 1)]
    df = spark.createDataFrame(rows, "region_code string, region_ordinal int, is_total boolean, base int, cmp int")
    got = sorted(present.numbered_rows(df, "ordinal").collect(), key=lambda r: r.row_no)
    assert [(r.region_code, r.base) for r in got] == [("VT", 1), (None, 0), (None, 7), ("AA", 9), ("ZZ", 5), ("TOTAL", 60)]
    assert [r.row_no for r in got] == [1, 2, 3, 4, 5, 6]


def test_year_to_date_report_is_numbered(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    report = consumption.region_ytd_growth(t, C.YTD)
    got = sorted(present.numbered_rows(report, "ordinal").collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in got] == list(range(1, report.count() + 1)) and got[-1].is_total


def test_daily_arrears_equal_each_cut_off(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    p = C.CUMULATIVE
    first, last = dt.date(1998, 6, 16), dt.date(1998, 6, 20)
    daily = {(r.day, r.cashier): (r.open_transfer, r.open_cash, r.open_total) for r in arrears.arrears_daily(t, p, first, last).collect()}
    for k in range(5):
        day = first + dt.timedelta(days=k)
        at = CumulativeArrearsParams(p.from_year, p.from_month, p.to_year, p.to_month, day, p.regions)
        for r in arrears.arrears_cumulative(t, at).collect():
            assert daily[day, r.cashier] == (r.open_transfer, r.open_cash, r.open_total)
