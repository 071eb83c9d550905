"""Report parameters as frozen objects.

Scalar parameters become literals in the plan. List parameters (regions,
customer codes) may be given as delimited text (comma, CR or LF, the way
users paste them), a Python sequence, or a one-column DataFrame when the
list is too large to inline; ``waterbook.sources.lists`` turns all three
into a DataFrame of distinct, trimmed, non-empty tokens.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Union

from pyspark.sql import DataFrame

ListParam = Union[str, Sequence[str], DataFrame, None]


@dataclass(frozen=True)
class Filters:
    """Optional report filters; ``None`` means "not applied".

    An empty text list is a set list with no tokens: an include list then
    keeps nothing and an exclude list keeps everything.
    """

    regions: ListParam = None
    class_code: str | None = None
    purpose_code: str | None = None
    include_customers: ListParam = None
    exclude_customers: ListParam = None


@dataclass(frozen=True)
class PeriodCompare:
    """Two years compared over the same month range (one month or January to N)."""

    base_year: int
    cmp_year: int
    month_from: int
    month_to: int

    @classmethod
    def month(cls, month: int, base_year: int, cmp_year: int) -> "PeriodCompare":
        return cls(base_year, cmp_year, month, month)

    @classmethod
    def year_to_date(cls, month: int, base_year: int, cmp_year: int) -> "PeriodCompare":
        return cls(base_year, cmp_year, 1, month)

    @property
    def years(self) -> list[int]:
        return sorted({self.base_year, self.cmp_year})


def add_months(day: dt.date, months: int) -> dt.date:
    """Calendar month shift clamped to the month end (2026-03-31 - 1 -> 2026-02-28)."""
    index = day.year * 12 + (day.month - 1) + months
    year, month0 = divmod(index, 12)
    last = calendar.monthrange(year, month0 + 1)[1]
    return dt.date(year, month0 + 1, min(day.day, last))


@dataclass(frozen=True)
class ArrearsParams:
    """Unpaid invoices of one billing month at a cut-off day, and of the
    previous billing month at the cut-off one month earlier."""

    year: int
    month: int
    cutoff: dt.date
    regions: ListParam = None

    @property
    def previous_period(self) -> tuple[int, int]:
        prev = add_months(dt.date(self.year, self.month, 1), -1)
        return prev.year, prev.month

    @property
    def previous_cutoff(self) -> dt.date:
        return add_months(self.cutoff, -1)


@dataclass(frozen=True)
class CumulativeArrearsParams:
    """Unpaid invoices of every billing month in a range at one cut-off day."""

    from_year: int
    from_month: int
    to_year: int
    to_month: int
    cutoff: dt.date
    regions: ListParam = None

    @property
    def month_keys(self) -> tuple[int, int]:
        return self.from_year * 12 + self.from_month, self.to_year * 12 + self.to_month


@dataclass(frozen=True)
class ReadingParams:
    """Large-customer readings of one region within one calendar year."""

    region: str
    year: int


@dataclass(frozen=True)
class FleetParams:
    """The instant the trip log is evaluated at; never the wall clock."""

    as_of: dt.datetime
    overlap_bucket_minutes: int = 15
