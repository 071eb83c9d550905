"""Run a report from the command line, the way the source scripts were run
with edited parameters.

    python -m waterbook month-report --tables generated:/root/testdata/sf0.01 \\
        --month 5 --base 1997 --cmp 1998 --text
    python -m waterbook arrears --tables parquet:/lake/domain --year 2026 --month 5 \\
        --cutoff 2026-06-18 --regions "VT,BR" --out /tmp/arrears --format csv

``--tables`` is ``generated:<dir>`` (the generated base tables),
``parquet:<root>`` (one dataset per domain table) or ``catalog:<database>``.
Without ``--out`` the (small) report is shown in display order; with it the
report is written by Spark to the given path.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame

from waterbook.params import (
    ArrearsParams,
    CumulativeArrearsParams,
    Filters,
    FleetParams,
    PeriodCompare,
    ReadingParams,
)
from waterbook.plans import arrears, consumption, fleet, flushing, present, readings
from waterbook.session import build_session
from waterbook.sources.tables import Tables


def _tables(spark, spec: str) -> Tables:
    kind, _, where = spec.partition(":")
    if kind == "generated":
        return Tables.from_generated(spark, where)
    if kind == "parquet":
        return Tables.from_parquet(spark, where)
    if kind == "catalog":
        return Tables.from_catalog(spark, where)
    raise SystemExit(f"unknown --tables kind: {kind}")


def _filters(a) -> Filters:
    return Filters(
        regions=a.regions,
        class_code=a.class_code,
        purpose_code=a.purpose,
        include_customers=a.include,
        exclude_customers=a.exclude,
    )


def _period(a, ytd: bool = False) -> PeriodCompare:
    if ytd:
        return PeriodCompare.year_to_date(a.month, a.base, a.cmp)
    if a.month_to:
        return PeriodCompare(a.base, a.cmp, a.month, a.month_to)
    return PeriodCompare.month(a.month, a.base, a.cmp)


def _purpose_text(df: DataFrame, a) -> DataFrame:
    return present.purpose_headings(present.format_purpose(df), _period(a, ytd=a.ytd))


def _fleet(a) -> FleetParams:
    return FleetParams(dt.datetime.fromisoformat(a.as_of))


def _date(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _plain(fmt):
    return lambda df, a: fmt(df)


def _arrears_text(df: DataFrame, a) -> DataFrame:
    p = ArrearsParams(a.year, a.month, _date(a.cutoff), a.regions)
    return present.arrears_headings(df, p.cutoff, p.previous_cutoff)


# report name -> (builder(tables, args) -> typed DataFrame, text formatter(df, args), display order)
REPORTS = {
    "month-growth": (
        lambda t, a: consumption.region_month_growth(t, _period(a)),
        _plain(present.format_month_growth),
        present.order_month_growth,
    ),
    "region-month": (
        lambda t, a: consumption.region_month_growth_filtered(t, _period(a), _filters(a)),
        None,
        present.order_by_ordinal,
    ),
    "top-customers": (
        lambda t, a: consumption.region_top_customers(t, _period(a), _filters(a)),
        None,
        lambda df: df.orderBy("region_ordinal", "rank"),
    ),
    "month-report": (
        lambda t, a: consumption.region_sectioned_report(t, _period(a), _filters(a)),
        _plain(present.format_sectioned),
        present.order_sectioned,
    ),
    "ytd": (
        lambda t, a: consumption.region_ytd_growth(t, _period(a, ytd=True), _filters(a)),
        _plain(present.format_ytd),
        present.order_by_ordinal,
    ),
    "purpose": (
        lambda t, a: consumption.purpose_growth(t, _period(a, ytd=a.ytd), a.region),
        _purpose_text,
        lambda df: df.orderBy("ordinal"),
    ),
    "class": (
        lambda t, a: consumption.class_period_growth(t, _period(a), _filters(a)),
        _plain(present.format_class),
        present.order_class_report,
    ),
    "kpi": (lambda t, a: consumption.kpi_status(t, _period(a)), _plain(present.kpi_text), None),
    "arrears": (
        lambda t, a: arrears.arrears_snapshot(t, ArrearsParams(a.year, a.month, _date(a.cutoff), a.regions)),
        _arrears_text,
        lambda df: df.orderBy("sort_order"),
    ),
    "arrears-cumulative": (
        lambda t, a: arrears.arrears_cumulative(
            t, CumulativeArrearsParams(a.year, a.month_from, a.year_to or a.year, a.month, _date(a.cutoff), a.regions)
        ),
        _plain(present.cumulative_headings),
        lambda df: df.orderBy("sort_order"),
    ),
    "readings": (
        lambda t, a: readings.reading_delta(t, ReadingParams(a.region, a.year)),
        _plain(present.format_readings),
        present.order_readings,
    ),
    "reading-summary": (
        lambda t, a: readings.reading_class_summary(t, ReadingParams(a.region, a.year)),
        _plain(present.format_reading_summary),
        lambda df: df.orderBy("sort_order"),
    ),
    "trip-status": (lambda t, a: fleet.trip_status(t.trip, _fleet(a)), None, present.order_trips),
    "trip-history": (lambda t, a: fleet.vehicle_history(t.trip, a.car), None, present.order_trips),
    "trip-replacement": (lambda t, a: fleet.trips_after_replacement(t.trip, _fleet(a)), None, present.order_trips),
    "trip-conflicts": (lambda t, a: fleet.order_conflicts(t.trip, t.trip, _fleet(a)), None, present.order_trips),
    "trip-completion": (
        lambda t, a: fleet.trip_completion(t.trip, fleet.returns_due(t.trip, _fleet(a))),
        None,
        present.order_trips,
    ),
    "trip-deletion": (
        lambda t, a: fleet.trip_deletion(t.trip, fleet.cancellations(t.trip, _fleet(a))),
        None,
        present.order_trips,
    ),
    "profiles": (lambda t, a: fleet.profile_upsert(t.vehicle_profile, t.profile_write), None, None),
    "trip-overlaps": (lambda t, a: fleet.trip_overlaps(t.trip, _fleet(a)), None, None),
    "vehicles-available": (
        lambda t, a: fleet.vehicles_available(t.fleet, t.trip, t.vehicle_profile, _fleet(a)),
        None,
        None,
    ),
    "maintenance": (lambda t, a: fleet.maintenance_overdue(t.fleet, t.vehicle_profile, _fleet(a)), None, None),
    "flush": (lambda t, a: flushing.flush_volume(t.flush_job), _plain(present.format_flush), None),
}


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m waterbook", description=__doc__.split("\n\n")[0])
    p.add_argument("report", choices=sorted(REPORTS))
    p.add_argument("--tables", required=True, help="generated:<dir> | parquet:<root> | catalog:<db>")
    p.add_argument("--month", type=int, default=5)
    p.add_argument("--month-to", type=int, help="last month of a range (class report)")
    p.add_argument("--month-from", type=int, default=1, help="first billing month (cumulative arrears)")
    p.add_argument("--base", type=int, help="base year")
    p.add_argument("--cmp", type=int, help="comparison year")
    p.add_argument("--year", type=int, help="billing or reading year")
    p.add_argument("--year-to", type=int, help="last billing year (cumulative arrears)")
    p.add_argument("--ytd", action="store_true", help="January to --month instead of one month")
    p.add_argument("--region", default="BR", help="one region code (purpose, readings)")
    p.add_argument("--regions", help="region list, comma or line separated")
    p.add_argument("--class-code")
    p.add_argument("--purpose")
    p.add_argument("--include", help="customer codes to keep")
    p.add_argument("--exclude", help="customer codes to drop")
    p.add_argument("--cutoff", help="cut-off day yyyy-mm-dd (arrears)")
    p.add_argument("--car", help="one vehicle's plate (trip history)")
    p.add_argument("--as-of", default=dt.datetime.now().replace(microsecond=0).isoformat(), help="trip log instant")
    p.add_argument("--text", action="store_true", help="printed text cells instead of typed numbers")
    p.add_argument("--out", help="write the report here instead of showing it")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--rows", type=int, default=200, help="rows to show")
    return p.parse_args(argv)


def build(tables: Tables, a: argparse.Namespace) -> DataFrame:
    make, text, order = REPORTS[a.report]
    df = make(tables, a)
    if a.text and text is None:
        print(f"{a.report} has no printed form: typed columns are given", file=sys.stderr)
    elif a.text:
        df = text(df, a)
    return order(df) if order is not None else df


def main(argv: list[str] | None = None) -> int:
    a = parse(sys.argv[1:] if argv is None else argv)
    spark = build_session("waterbook-cli")
    spark.sparkContext.setLogLevel("WARN")
    df = build(_tables(spark, a.tables), a)
    if a.out:
        df.write.mode("overwrite").format(a.format).option("header", "true").save(a.out)
    else:
        df.show(a.rows, truncate=False)
        if len(df.take(a.rows + 1)) > a.rows:
            print(f"only the first {a.rows} rows are shown; --rows or --out gives more", file=sys.stderr)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
