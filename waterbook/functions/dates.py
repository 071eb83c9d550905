"""Date helpers: as-of predicates, half-open ranges, clock durations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(value: dt.datetime | dt.date) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (folds to a constant, so it pushes down)."""
    if isinstance(value, dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    else:
        text = value.strftime("%Y-%m-%d 00:00:00")
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def in_calendar_year(ts: Column, year: int) -> Column:
    """``YEAR(ts) = y`` written as a half-open range so Parquet can prune."""
    return (ts >= ntz(dt.datetime(year, 1, 1))) & (ts < ntz(dt.datetime(year + 1, 1, 1)))


def month_key(year: Column, month: Column) -> Column:
    """``year * 12 + month``: orders billing months like ``DATEFROMPARTS(y, m, 1)``."""
    return year * F.lit(12) + month


def unpaid_as_of(posted_at: Column, paid_at: Column, is_paid: Column, cutoff: dt.date) -> Column:
    """Invoice open at the end of ``cutoff``: posted on or before it, and
    either paid after it or not flagged paid. SQL three-valued logic is kept:
    a paid flag of 1 with no payment date is not open (unknown OR false)."""
    d = F.lit(cutoff)
    return (F.to_date(posted_at) <= d) & (
        (F.to_date(paid_at) > d) | (F.coalesce(is_paid, F.lit(0)) != 1)
    )


def clock_seconds(start_min: Column, end_min: Column) -> Column:
    """Seconds from a start to an end time of day (minutes), wrapping past
    midnight when the end is earlier than the start; equal times give 0."""
    end_adj = F.when(end_min < start_min, end_min + F.lit(1440)).otherwise(end_min)
    return (end_adj - start_min) * F.lit(60)
