"""Presentation: labels and number text, applied after the typed reports.

Reports return typed numbers; these functions add the text columns the
printed reports show. Ordering columns stay available to ``orderBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterbook.functions import formatting as fmt
from waterbook.functions.growth import growth_hundredths
from waterbook.operators.ordering import numbered
from waterbook.sources import literals as L


def status_label(df: DataFrame) -> DataFrame:
    """Row status of the sectioned report. Section headers (no measures),
    a growing total, growth, decline, stable. The total is recognised by its
    ``is_total`` flag rather than by searching its label text."""
    c = F.col
    status = (
        F.when(c("base").isNull() & c("cmp").isNull(), F.lit(L.STATUS_SECTION))
        .when(c("is_total") & (c("diff") > 0), F.lit(L.STATUS_TOTAL_UP))
        .when(c("diff") > 0, F.lit(L.STATUS_UP))
        .when(c("diff") < 0, F.lit(L.STATUS_DOWN))
        .otherwise(F.lit(L.STATUS_STABLE))
    )
    return df.withColumn("status", status)


def format_sectioned(df: DataFrame) -> DataFrame:
    """Text cells of the sectioned report: ``#,##0`` volumes, signed
    difference, ``0.00`` growth with sign and `` %``; blank where the row has
    no number."""
    c = F.col
    # hundredths computed once, then referenced by column in every branch
    labelled = status_label(df).withColumn("__h", growth_hundredths(c("base"), c("diff")))
    h = c("__h")
    return labelled.select(
        "section",
        "sort_order",
        "region_ordinal",
        "rank",
        "label",
        F.when(c("base").isNull(), F.lit("")).otherwise(fmt.grouped(c("base"))).alias("base_text"),
        F.when(c("cmp").isNull(), F.lit("")).otherwise(fmt.grouped(c("cmp"))).alias("cmp_text"),
        F.when(c("diff").isNull(), F.lit("")).otherwise(fmt.signed_grouped(c("diff"))).alias("diff_text"),
        fmt.growth_text_signed(
            F.when(c("growth_pct").isNotNull(), F.coalesce(h, F.lit(0))), c("growth_pct") > 0, c("growth_pct") == 0
        ).alias("growth_text"),
        "status",
    )


def format_month_growth(df: DataFrame) -> DataFrame:
    """Web report cells: ``{:,.0f}`` volumes, ``{:+,.0f}`` change and
    ``{:+.2f} %`` growth (``+inf %`` / ``-inf %`` on a zero base)."""
    c = F.col
    df = df.withColumn("__h", growth_hundredths(c("base"), c("diff")))
    h = c("__h")
    g = c("growth_pct")
    growth = (
        F.when(g == F.lit(float("inf")), F.lit("+inf %"))
        .when(g == F.lit(float("-inf")), F.lit("-inf %"))
        .otherwise(
            F.concat(
                F.when(g >= 0, F.lit("+")).otherwise(F.lit("")),
                fmt.fixed2_dot(F.coalesce(h, F.lit(0))),
                F.lit(" %"),
            )
        )
    )
    return df.select(
        "region",
        "is_total",
        fmt.comma_grouped(c("base")).alias("base_text"),
        fmt.comma_grouped(c("cmp")).alias("cmp_text"),
        fmt.signed_comma_grouped(c("diff")).alias("diff_text"),
        growth.alias("growth_text"),
    )


def format_ytd(df: DataFrame) -> DataFrame:
    """Right-aligned cells of the year-to-date report: volumes ``#,##0`` in
    15 characters, growth ``#,##0.##`` + `` %`` in 10 (NULL growth stays
    NULL)."""
    c = F.col
    df = df.withColumn("__h", growth_hundredths(c("base"), c("diff")))
    h = c("__h")
    return df.select(
        "region_code",
        "region_label",
        "is_total",
        "region_ordinal",
        fmt.right_align(fmt.grouped(c("base")), 15).alias("base_text"),
        fmt.right_align(fmt.grouped(c("cmp")), 15).alias("cmp_text"),
        fmt.right_align(fmt.grouped(c("diff")), 15).alias("diff_text"),
        fmt.right_align(F.concat(fmt.pct_trimmed(h), F.lit(" %")), 10).alias("growth_text"),
    )


def format_class(df: DataFrame) -> DataFrame:
    """Class report cells: dot-grouped volumes where zero prints empty."""
    c = F.col
    return df.select(
        "class_code",
        "class_name",
        "is_total",
        fmt.blank_zero_grouped(c("base")).alias("base_text"),
        fmt.blank_zero_grouped(c("cmp")).alias("cmp_text"),
        fmt.blank_zero_grouped(c("diff")).alias("diff_text"),
        fmt.fixed2_dot(growth_hundredths(c("base"), c("diff"))).alias("growth_text"),
    )


def format_readings(df: DataFrame) -> DataFrame:
    """Reading list cells: dates ``dd/MM/yyyy``, money-style volumes."""
    c = F.col
    return df.select(
        "customer_code",
        "name",
        fmt.dd_mm_yyyy(c("prev_read_at")).alias("prev_date"),
        fmt.dd_mm_yyyy(c("last_read_at")).alias("last_date"),
        fmt.money_text(c("prev_volume")).alias("prev_text"),
        fmt.money_text(c("last_volume")).alias("last_text"),
        fmt.money_text(c("delta")).alias("delta_text"),
        fmt.fixed2_dot(F.coalesce(growth_hundredths(c("prev_volume"), c("delta")), F.lit(0))).alias("growth_text"),
    )


def format_reading_summary(df: DataFrame) -> DataFrame:
    """Class summary cells: money-style volumes, two-decimal growth."""
    c = F.col
    return df.select(
        "sort_order",
        "purpose_name",
        "group_name",
        "class_code",
        fmt.money_text(c("prev_volume")).alias("prev_text"),
        fmt.money_text(c("last_volume")).alias("last_text"),
        fmt.money_text(c("delta")).alias("delta_text"),
        fmt.fixed2_dot(F.coalesce(growth_hundredths(c("prev_volume"), c("delta")), F.lit(0))).alias("growth_text"),
    )


def arrears_headings(df: DataFrame, cutoff, previous_cutoff) -> DataFrame:
    """Column headings carrying the cut-off days (``dd/MM``), as printed."""
    cur, prev = cutoff.strftime("%d/%m"), previous_cutoff.strftime("%d/%m")
    names = {
        "cur_transfer": cur + L.ARREARS_TRANSFER_SUFFIX,
        "cur_cash": cur + L.ARREARS_CASH_SUFFIX,
        "cur_total": cur + L.ARREARS_TOTAL_SUFFIX,
        "prev_transfer": prev + L.ARREARS_TRANSFER_SUFFIX,
        "prev_cash": prev + L.ARREARS_CASH_SUFFIX,
        "prev_total": prev + L.ARREARS_TOTAL_SUFFIX,
        "diff": L.ARREARS_DIFF_HEADING,
    }
    return df.select("cashier", "sort_order", *[F.col(k).alias(v) for k, v in names.items()])


def format_purpose(df: DataFrame) -> DataFrame:
    """Purpose report: ``#,##0`` cells and ``#,##0.##`` growth with `` %``."""
    c = F.col
    h = F.coalesce(growth_hundredths(c("base"), c("diff")), F.lit(0))
    return df.select(
        "ordinal",
        "purpose_code",
        "purpose_name",
        fmt.grouped(c("base")).alias("base_text"),
        fmt.grouped(c("cmp")).alias("cmp_text"),
        fmt.grouped(c("diff")).alias("diff_text"),
        F.concat(fmt.pct_trimmed(h), F.lit(" %")).alias("growth_text"),
    )


def purpose_headings(df: DataFrame, period) -> DataFrame:
    """The printed purpose report's columns under their headings, the two
    volumes under ``T<month>/<year>``."""
    names = dict(L.PURPOSE_HEADINGS)
    names |= {"base_text": f"T{period.month_to}/{period.base_year}", "cmp_text": f"T{period.month_to}/{period.cmp_year}"}
    return df.select("ordinal", *[F.col(c).alias(names[c]) for c in df.columns if c != "ordinal"])


def cumulative_headings(df: DataFrame) -> DataFrame:
    """Cumulative arrears by display name under the printed headings."""
    return df.select("sort_order", *[F.col(k).alias(v) for k, v in L.CUMULATIVE_HEADINGS.items()])


def kpi_text(df: DataFrame) -> DataFrame:
    """KPI cards: totals ``1,234``, signed change, signed growth and the
    status label."""
    c = F.col
    label = (
        F.when(c("status") == "up", F.lit(L.KPI_UP))
        .when(c("status") == "down", F.lit(L.KPI_DOWN))
        .otherwise(F.lit(L.KPI_STABLE))
    )
    h = F.coalesce(growth_hundredths(c("base"), c("diff")), F.lit(0))
    return df.select(
        fmt.comma_grouped(c("base")).alias("base_text"),
        fmt.comma_grouped(c("cmp")).alias("cmp_text"),
        fmt.signed_comma_grouped(c("diff")).alias("diff_text"),
        F.concat(F.when(h >= 0, F.lit("+")).otherwise(F.lit("")), fmt.fixed2_dot(h), F.lit("%")).alias("growth_text"),
        label.alias("status_label"),
    )


# -- display order (the reports' ORDER BY clauses) ---------------------------------


#: The columns each report is printed by, nulls first (-: downwards, nulls last).
ORDERS = {
    "sectioned": ["section", "region_ordinal", "sort_order", "rank"],
    "month_growth": ["is_total", "region"],
    "ordinal": ["is_total", "region_ordinal", "region_code", "base", "cmp"],  # unknown regions share one ordinal
    "cashier": ["is_total", "sort_order"],
    "summary": ["sort_order"],
    "class_report": ["is_total", "class_code"],
    "readings": ["customer_code"],
    "trips": ["-id"],
}


def printed_order(report: str) -> list[F.Column]:
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in ORDERS[report]]


def numbered_rows(df: DataFrame, report: str) -> DataFrame:
    """The report with ``row_no``, the place in which it is printed."""
    return numbered(df, *printed_order(report))


def order_sectioned(df: DataFrame) -> DataFrame:
    """Sectioned report: summary then per region its header and top rows."""
    return df.orderBy(*printed_order("sectioned"))


def order_month_growth(df: DataFrame) -> DataFrame:
    """Web report: regions by name, the total last."""
    return df.orderBy(*printed_order("month_growth"))


def order_by_ordinal(df: DataFrame, ordinal: str = "region_ordinal") -> DataFrame:
    """Detail rows by their fixed ordinal, the total row last."""
    return df.orderBy("is_total", ordinal)


def order_class_report(df: DataFrame) -> DataFrame:
    return df.orderBy(*printed_order("class_report"))


def order_readings(df: DataFrame) -> DataFrame:
    return df.orderBy(*printed_order("readings"))


def order_trips(df: DataFrame) -> DataFrame:
    """Trip list, newest order first."""
    return df.orderBy(*printed_order("trips"))


def format_flush(df: DataFrame) -> DataFrame:
    """Result panel text: two decimals (duration in minutes with one), with
    the calculator's units; invalid jobs show their reason."""
    c = F.col

    def fixed(col: F.Column, places: int, unit: str) -> F.Column:
        # %f prints a missing number as text
        return F.when(col.isNotNull(), F.concat(F.format_string(f"%.{places}f", col), F.lit(unit)))

    return df.select(
        "id",
        "invalid_reason",
        fixed(c("dz"), 2, L.FLUSH_UNITS["dz"]).alias("dz_text"),
        fixed(c("net_head"), 2, L.FLUSH_UNITS["net_head"]).alias("net_head_text"),
        fixed(c("local_loss_m"), 2, L.FLUSH_UNITS["local_loss_m"]).alias("local_loss_text"),
        fixed(c("velocity"), 2, L.FLUSH_UNITS["velocity"]).alias("velocity_text"),
        fixed(c("flow_lps"), 2, L.FLUSH_UNITS["flow_lps"]).alias("flow_text"),
        fixed(c("duration_s") / F.lit(60.0), 1, L.FLUSH_UNITS["duration_min"]).alias("duration_text"),
        fixed(c("volume_m3"), 2, L.FLUSH_UNITS["volume_m3"]).alias("volume_text"),
    )
