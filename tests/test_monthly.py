"""Stored monthly sums: reports as from the bills, and which periods a refresh writes."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from waterbook import catalog
from waterbook.plans import consumption, monthly
from waterbook.sources.tables import Tables

from tests.conftest import SF_SMALL, make_tables, rows_of


def files(root):
    return {d: sorted(x for x in os.listdir(d) if x.endswith(".parquet")) for d, _, names in os.walk(root) if names}


def bill(i, customer, year, month, volume, cancelled=None, purpose="H"):
    return (i, customer, year, month, volume, cancelled, purpose)


def test_refresh_writes_only_the_changed_period(spark):
    root = tempfile.mkdtemp(prefix="wb-months-")
    old = [bill(1, 1, 2025, 5, 10), bill(2, 1, 2026, 5, 20), bill(3, 2, 2026, 4, 7)]
    t = make_tables(spark, consumption=old)
    monthly.write_months(t, root)
    before = files(root)
    extra = [bill(4, 2, 2026, 5, 3), bill(5, 2, 2026, 5, 4), bill(6, 2, 2026, 5, 100, cancelled=1)]
    now = make_tables(spark, consumption=old + extra)
    changed = now.consumption.where("bill_id >= 4")
    for _ in range(2):  # repeated: the same table
        monthly.refresh_months(now, changed, root)
        after = files(root)
        assert {d for d in after if after[d] != before.get(d)} == {os.path.join(root, "year=2026", "month=5")}
        got = monthly.from_months(spark, now, root).consumption
        assert got.where("month = 5 AND year = 2026 AND customer_id = 2 AND is_cancelled = 0").first().volume == 7
        assert got.agg(F.sum("bills")).first()[0] == 6


def test_period_without_bills_any_more_is_emptied(spark):
    root = tempfile.mkdtemp(prefix="wb-months-")
    t = make_tables(spark, consumption=[bill(1, 1, 2025, 5, 10), bill(2, 1, 2026, 5, None), bill(3, 1, None, 5, 1)])
    monthly.write_months(t, root)
    gone = make_tables(spark, consumption=[bill(1, 1, 2025, 5, 10)])
    monthly.refresh_months(gone, t.consumption.where("year = 2026"), root)
    assert rows_of(monthly.from_months(spark, t, root).consumption, "year", "bills") == [(2025, 1)]
    monthly.refresh_months(gone, t.consumption.limit(0), root)
    empty = tempfile.mkdtemp(prefix="wb-months-")
    monthly.write_months(make_tables(spark), empty)
    assert monthly.from_months(spark, t, empty).consumption.count() == 0


@pytest.mark.parametrize("report", [
    lambda t: consumption.region_month_growth_filtered(t, catalog.MONTH, catalog.MONTH_FILTERS),
    lambda t: consumption.region_top_customers(t, catalog.MONTH),
    lambda t: consumption.full_join_years(t, catalog.YTD),
    lambda t: consumption.kpi_status(t, catalog.MONTH),
    lambda t: consumption.purpose_growth(t, catalog.MONTH, catalog.REGION),
])
def test_reports_are_the_same(spark, report):
    t = Tables.from_generated(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="wb-months-")
    stored = monthly.refreshed(t, root, 1998, 5)
    assert report(stored).dtypes == report(t).dtypes
    assert rows_of(report(stored)) == rows_of(report(t))


def test_report_prunes_the_stored_periods(spark):
    t = Tables.from_generated(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="wb-months-")
    monthly.write_months(t, root)
    df = consumption.region_month_growth(monthly.from_months(spark, t, root), catalog.MONTH)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "year" in plan
