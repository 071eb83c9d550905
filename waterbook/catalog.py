"""Registered queries: every report run on the generated tables with the
fixture parameters. Each entry is ``(spark, sf_dir) -> DataFrame`` and runs
over the whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterbook.functions.codes import concat_nullsafe
from waterbook.params import (
    ArrearsParams,
    CumulativeArrearsParams,
    Filters,
    FleetParams,
    PeriodCompare,
    ReadingParams,
)
from waterbook.plans import arrears, consumption, fleet, flushing, logbook, monthly, present, readings
from waterbook.session import shared_folder
from waterbook.sources import lists
from waterbook.sources.tables import Tables

# Fixture parameters (FIXTURES.md): billing data spans 1995-2001, readings
# and trips January 2024.
MONTH = PeriodCompare.month(5, 1997, 1998)
YTD = PeriodCompare.year_to_date(5, 1997, 1998)
REGION = "BRIA"
CLASS_PERIOD = PeriodCompare(1997, 1998, 5, 5)
CLASS_EXCLUDED = "\n0150000493\n"
ARREARS = ArrearsParams(1998, 5, dt.date(1998, 6, 18), "VT,BRIA")
CUMULATIVE = CumulativeArrearsParams(1998, 1, 1998, 5, dt.date(1998, 6, 18), "BRIA")
# Every day of a year as a cut-off.
DAYS = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
READING = ReadingParams(REGION, 2024)
FLEET = FleetParams(dt.datetime(2024, 1, 15, 12, 0, 0))
# Filters as users type them: mixed case, blanks, line breaks.
MONTH_FILTERS = Filters(regions="VT,\r\n bria ", class_code=" xd", purpose_code="h")
INCLUDE_CLASS = "VIP"
EXCLUDE_CLASS = "XD"
# The vehicle of the one-vehicle history.
PLATE = "72A-00007"
# Decimals of doubles that two engines are compared on.
QUANTIZE = 6


lists_parse = lists.parse_text


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables.from_generated(spark, sf_dir)


def customer_list_text(t: Tables) -> DataFrame:
    """A pasted-list column per customer: code, class and region separated
    by blanks, commas and line breaks, with empty tokens in between."""
    c = t.customer
    code = concat_nullsafe(F.col("street_code"), F.col("meter_code"))
    text = F.concat(
        F.lit(" "),
        code,
        F.lit(" ,"),
        F.coalesce(F.col("class_code"), F.lit("")),
        F.lit("\r\n"),
        F.coalesce(F.col("region_code"), F.lit("")),
        F.lit(",,"),
    )
    return c.select("class_code", text.alias("list_text"))


def class_code_list(t: Tables, class_code: str) -> DataFrame:
    """Customer codes of one class, parsed from pasted-list text."""
    text = t.customer.where(F.col("class_code") == class_code).select(
        F.concat(F.lit(" "), concat_nullsafe(F.col("street_code"), F.col("meter_code")), F.lit("\r\n")).alias("t")
    )
    return lists.tokens(text, "t")


def flush_codes(t: Tables) -> DataFrame:
    """Jobs whose roughness and pig loss come from their codes alone."""
    coded = flushing.resolve_codes(t.flush_job.drop("roughness", "pig_loss_bar"))
    return coded.select("id", "material", "pig_type", "roughness", "pig_loss_bar")


def _q(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(tables(spark, sf_dir))


def _months(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``fn`` from monthly sums in which the compared month was added last."""
    return _q(lambda t: fn(monthly.refreshed(t, shared_folder(t.spark, "months"), MONTH.cmp_year, MONTH.month_to)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # consumption comparisons
    "region_month_growth": _q(lambda t: consumption.region_month_growth(t, MONTH)),
    "region_month_growth_filtered": _q(lambda t: consumption.region_month_growth_filtered(t, MONTH)),
    "region_month_filters": _q(lambda t: consumption.region_month_growth_filtered(t, MONTH, MONTH_FILTERS)),
    "region_top_customers": _q(lambda t: consumption.region_top_customers(t, MONTH)),
    "region_sectioned_report": _q(lambda t: consumption.region_sectioned_report(t, MONTH)),
    "region_ytd_growth": _q(lambda t: consumption.region_ytd_growth(t, YTD)),
    "full_join_years": _q(lambda t: consumption.full_join_years(t, YTD)),
    "purpose_month_growth": _q(lambda t: consumption.purpose_growth(t, MONTH, REGION)),
    "purpose_ytd_growth": _q(lambda t: consumption.purpose_growth(t, YTD, REGION)),
    "class_period_growth": _q(
        lambda t: consumption.class_period_growth(
            t, CLASS_PERIOD, Filters(regions=REGION, exclude_customers=CLASS_EXCLUDED)
        )
    ),
    "kpi_status": _q(lambda t: consumption.kpi_status(t, MONTH)),
    "region_decode": _q(consumption.region_decode),
    "growth_policies": _q(lambda t: consumption.growth_policies(t, MONTH)),
    "region_growth_rollup": _q(lambda t: consumption.region_growth_rollup(t, MONTH)),
    "filter_list_tokens": _q(lambda t: lists.tokens(customer_list_text(t), "list_text")),
    "customer_include_list": _q(
        lambda t: consumption.customer_include_list(t, MONTH, class_code_list(t, INCLUDE_CLASS))
    ),
    "customer_exclude_list": _q(
        lambda t: consumption.customer_exclude_list(t, MONTH, class_code_list(t, EXCLUDE_CLASS))
    ),
    "growth_status_label": _q(lambda t: present.status_label(consumption.region_sectioned_report(t, MONTH))),
    "report_formatting": _q(lambda t: present.format_sectioned(consumption.region_sectioned_report(t, MONTH))),
    # printed report text
    "region_month_text": _q(lambda t: present.format_month_growth(consumption.region_month_growth(t, MONTH))),
    "kpi_text": _q(lambda t: present.kpi_text(consumption.kpi_status(t, MONTH))),
    "ytd_report_text": _q(lambda t: present.format_ytd(consumption.region_ytd_growth(t, YTD))),
    "class_report_text": _q(
        lambda t: present.format_class(
            consumption.class_period_growth(t, CLASS_PERIOD, Filters(regions=REGION, exclude_customers=CLASS_EXCLUDED))
        )
    ),
    "reading_list_text": _q(lambda t: present.format_readings(readings.reading_delta(t, READING))),
    "reading_summary_text": _q(lambda t: present.format_reading_summary(readings.reading_class_summary(t, READING))),
    "purpose_month_text": _q(
        lambda t: present.purpose_headings(present.format_purpose(consumption.purpose_growth(t, MONTH, REGION)), MONTH)
    ),
    "arrears_cumulative_text": _q(lambda t: present.cumulative_headings(arrears.arrears_cumulative(t, CUMULATIVE))),
    "arrears_report_text": _q(
        lambda t: present.arrears_headings(
            arrears.arrears_snapshot(t, ARREARS), ARREARS.cutoff, ARREARS.previous_cutoff
        )
    ),
    # the same comparisons from stored monthly sums
    "region_sectioned_from_months": _months(lambda t: consumption.region_sectioned_report(t, MONTH)),
    "region_month_from_months": _months(lambda t: consumption.region_month_growth(t, MONTH)),
    "region_ytd_from_months": _months(lambda t: consumption.region_ytd_growth(t, YTD)),
    "purpose_ytd_from_months": _months(lambda t: consumption.purpose_growth(t, YTD, REGION)),
    "class_period_from_months": _months(
        lambda t: consumption.class_period_growth(
            t, CLASS_PERIOD, Filters(regions=REGION, exclude_customers=CLASS_EXCLUDED)
        )
    ),
    # arrears
    "arrears_snapshot": _q(lambda t: arrears.arrears_snapshot(t, ARREARS)),
    "arrears_cumulative": _q(lambda t: arrears.arrears_cumulative(t, CUMULATIVE)),
    "arrears_daily": _q(lambda t: arrears.arrears_daily(t, CUMULATIVE, *DAYS)),
    "arrears_rejected_months": _q(arrears.rejected_months),
    "positive_invoices": _q(arrears.positive_invoices),
    # readings
    "customer_dedup": _q(readings.customer_dedup),
    "reading_delta": _q(lambda t: readings.reading_delta(t, READING)),
    "reading_class_summary": _q(lambda t: readings.reading_class_summary(t, READING)),
    # trip log
    "trip_validation": _q(lambda t: fleet.trip_validation(t.trip)),
    "trip_overlaps": _q(lambda t: fleet.trip_overlaps(t.trip, FLEET)),
    "trips_after_replacement": _q(lambda t: fleet.trips_after_replacement(t.trip, FLEET)),
    "trips_after_replacement_sweep": _q(lambda t: fleet.trips_after_replacement(t.trip, FLEET, method="sweep")),
    "trips_after_refusal": _q(lambda t: fleet.trips_after_refusal(t.trip, FLEET)),
    "order_conflicts": _q(lambda t: fleet.order_conflicts(t.trip, t.trip, FLEET)),
    "trip_status": _q(lambda t: fleet.trip_status(t.trip, FLEET)),
    "trip_distance": _q(lambda t: fleet.trip_distance(t.trip)),
    "vehicles_available": _q(lambda t: fleet.vehicles_available(t.fleet, t.trip, t.vehicle_profile, FLEET)),
    "maintenance_overdue": _q(lambda t: fleet.maintenance_overdue(t.fleet, t.vehicle_profile, FLEET)),
    "vehicle_history": _q(lambda t: fleet.vehicle_history(t.trip)),
    "vehicle_history_one": _q(lambda t: fleet.vehicle_history(t.trip, PLATE)),
    "profile_upsert": _q(lambda t: fleet.profile_upsert(t.vehicle_profile, t.profile_write)),
    "trip_completion": _q(lambda t: fleet.trip_completion(t.trip, fleet.returns_due(t.trip, FLEET))),
    "trip_deletion": _q(lambda t: fleet.trip_deletion(t.trip, fleet.cancellations(t.trip, FLEET))),
    "profile_store_batches": _q(
        lambda t: logbook.profiles_after_batches(t, shared_folder(t.spark, "profiles"), FLEET.as_of)
    ),
    "trip_store_batches": _q(lambda t: logbook.trips_after_batches(t, shared_folder(t.spark, "trips"), FLEET)),
    "trip_json_log": _q(lambda t: logbook.trip_log_read_back(t, FLEET, shared_folder(t.spark, "trip-json"))),
    # the rows of each report family in the order they are printed
    "region_sectioned_ordered": _q(
        lambda t: present.numbered_rows(consumption.region_sectioned_report(t, MONTH), "sectioned")
    ),
    "region_month_ordered": _q(
        lambda t: present.numbered_rows(consumption.region_month_growth(t, MONTH), "month_growth")
    ),
    "region_ytd_ordered": _q(lambda t: present.numbered_rows(consumption.region_ytd_growth(t, YTD), "ordinal")),
    "class_period_ordered": _q(
        lambda t: present.numbered_rows(
            consumption.class_period_growth(t, CLASS_PERIOD, Filters(regions=REGION, exclude_customers=CLASS_EXCLUDED)),
            "class_report",
        )
    ),
    "arrears_cumulative_ordered": _q(
        lambda t: present.numbered_rows(arrears.arrears_cumulative(t, CUMULATIVE), "cashier")
    ),
    "reading_list_ordered": _q(lambda t: present.numbered_rows(readings.reading_delta(t, READING), "readings")),
    "reading_summary_ordered": _q(
        lambda t: present.numbered_rows(readings.reading_class_summary(t, READING), "summary")
    ),
    "trip_list_ordered": _q(lambda t: present.numbered_rows(fleet.trip_status(t.trip, FLEET), "trips")),
    # pipe flushing
    "flush_volume": _q(lambda t: flushing.flush_volume(t.flush_job, QUANTIZE)),
    "flush_codes": _q(flush_codes),
    "flush_text": _q(lambda t: present.format_flush(flushing.flush_volume(t.flush_job, QUANTIZE))),
}
