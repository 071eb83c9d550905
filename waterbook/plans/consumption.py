"""Billed-consumption comparison reports.

Shape shared by all of them: restrict the billing fact to the compared
months and years (pruned at the scan), pre-aggregate to one row per
customer with both years' sums side by side (partial aggregation on the
map side), join the customer master on that much smaller input, then
aggregate to the report grain and append a grand-total row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterbook.functions.codes import (
    class_name,
    concat_nullsafe,
    norm,
    purpose_codes,
    purpose_name,
    purpose_ordinal,
    region_name,
    region_ordinal,
    region_upper_name,
)
from waterbook.functions.growth import growth_pct
from waterbook.operators.compare import (
    full_join_periods,
    rollup_total,
    sum_by,
    two_period,
    with_diff_growth,
    with_total,
)
from waterbook.operators.filters import active_bill, equals_optional, in_list
from waterbook.operators.rank import top_n_per_group
from waterbook.params import Filters, PeriodCompare
from waterbook.schemas import SUM_TYPE
from waterbook.sources import literals as L
from waterbook.sources.tables import Tables

NO_FILTERS = Filters()


# -- shared building blocks ------------------------------------------------


def period_bills(tables: Tables, period: PeriodCompare, active_only: bool = True) -> DataFrame:
    """Bills of the compared months and years (and active ones only)."""
    cond = F.col("month").between(period.month_from, period.month_to) & F.col("year").isin(period.years)
    if active_only:
        cond = cond & active_bill()
    return tables.consumption.where(cond)


def per_customer(bills: DataFrame, period: PeriodCompare, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per customer (and extra keys): ``base``, ``cmp`` and the
    number of bills in each year (``base_rows``, ``cmp_rows``)."""
    year = F.col("year")
    return two_period(
        bills,
        ["customer_id", *extra_keys],
        period,
        extra_aggs=[
            F.count_if(year == period.base_year).alias("base_rows"),
            F.count_if(year == period.cmp_year).alias("cmp_rows"),
        ],
    )


def customer_master(tables: Tables) -> DataFrame:
    return tables.customer.select(
        "customer_id", "street_code", "meter_code", "street_sub", "name", "region_code", "class_code"
    )


def join_customer(per_cust: DataFrame, tables: Tables, how: str) -> DataFrame:
    """Attach the customer master. ``customer_code`` is ``CONCAT(street,
    meter)`` with NULL parts as empty text, so an unmatched bill has code ''."""
    joined = per_cust.join(customer_master(tables), "customer_id", how)
    return joined.withColumn("customer_code", concat_nullsafe(F.col("street_code"), F.col("meter_code")))


def filtered_customers(tables: Tables, filters: Filters, street: bool = False, region: str | None = None) -> DataFrame:
    """Customer side of an INNER join, filtered before the join: the
    street-master check (a semi join on the small street table), optional
    region and list filters. Equivalent to filtering after an INNER join,
    and it shrinks the side that is shuffled."""
    c = customer_master(tables).withColumn(
        "customer_code", concat_nullsafe(F.col("street_code"), F.col("meter_code"))
    )
    if street:
        c = with_street(c, tables)
    c = equals_optional(c, "region_code", region)
    return customer_filters(c, filters)


def with_street(df: DataFrame, tables: Tables) -> DataFrame:
    """INNER join to the street master used only to drop customers without a
    street row: a semi join on the distinct keys (no row multiplication)."""
    keys = tables.street.select("street_code", "street_sub")
    return df.join(keys, ["street_code", "street_sub"], "left_semi")


def customer_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Optional filters on customer attributes, applied after the join so an
    unmatched bill behaves as the SQL predicates on NULL columns do."""
    df = in_list(df, "region_code", filters.regions, normalise=True)
    df = equals_optional(df, "class_code", filters.class_code)
    df = in_list(df, "customer_code", filters.include_customers, normalise=True)
    df = in_list(df, "customer_code", filters.exclude_customers, negate=True, normalise=True)
    return df


def bill_filters(bills: DataFrame, filters: Filters) -> DataFrame:
    return equals_optional(bills, "purpose_code", filters.purpose_code)


def sum_up(df: DataFrame, keys: list, measures: tuple[str, ...] = ("base", "cmp")) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).cast(SUM_TYPE).alias(m) for m in measures])


# -- R1: region month growth (web report) --------------------------------------


def region_month_growth(tables: Tables, period: PeriodCompare) -> DataFrame:
    """Per region name: base, cmp, diff and growth for one month of two years.

    LEFT join, so bills without a customer count under "other". Detail growth
    is ``diff / base * 100`` with +/-infinity on a zero base (0 when both are
    0); the total row's growth is 0 on a zero base.
    """
    pc = per_customer(period_bills(tables, period), period)
    j = join_customer(pc, tables, "left").withColumn("region", region_name(norm(F.col("region_code"))))
    return with_total(
        j,
        ["region"],
        ["base", "cmp"],
        {"region": L.REGION_TOTAL_NAME},
        on_zero="zero",
        order="ratio",
        detail_on_zero="inf",
    )


def kpi_status(tables: Tables, period: PeriodCompare) -> DataFrame:
    """System totals of the web report and a three-way status.

    The LEFT join to customers neither drops nor repeats bills (the customer
    key is unique), so the totals need no join: one scan, one global
    aggregate."""
    bills = period_bills(tables, period)
    year = F.col("year")
    v = F.coalesce(F.col("volume"), F.lit(0))
    tot = bills.agg(
        F.coalesce(F.sum(F.when(year == period.base_year, v)), F.lit(0)).cast(SUM_TYPE).alias("base"),
        F.coalesce(F.sum(F.when(year == period.cmp_year, v)), F.lit(0)).cast(SUM_TYPE).alias("cmp"),
    )
    tot = with_diff_growth(tot, "zero", order="ratio")
    status = F.when(F.col("diff") > 0, F.lit("up")).when(F.col("diff") < 0, F.lit("down")).otherwise(F.lit("stable"))
    return tot.withColumn("status", status)


# -- R2-R4: month growth with filters, top customers, sectioned report ---------


def customer_level(tables: Tables, period: PeriodCompare, filters: Filters = NO_FILTERS) -> DataFrame:
    """Bills pre-aggregated per customer, LEFT joined to customers, filtered,
    with region name and ordinal. Shared by R2, R3 and R4."""
    bills = bill_filters(period_bills(tables, period), filters)
    j = customer_filters(join_customer(per_customer(bills, period), tables, "left"), filters)
    code = norm(F.col("region_code"))
    return j.select(
        region_name(code).alias("region"),
        region_ordinal(code).alias("region_ordinal"),
        "customer_code",
        F.col("name").alias("customer_name"),
        "base",
        "cmp",
    )


def region_month_growth_filtered(
    tables: Tables, period: PeriodCompare, filters: Filters = NO_FILTERS
) -> DataFrame:
    """Per region: base, cmp, diff, growth (0 on a zero base), fixed region
    order 1..6, and a total row with ordinal 7."""
    return _region_summary(customer_level(tables, period, filters))


def _region_summary(cust: DataFrame) -> DataFrame:
    return with_total(
        cust,
        ["region", "region_ordinal"],
        ["base", "cmp"],
        {"region": L.REGION_TOTAL_NAME, "region_ordinal": L.REGION_TOTAL_ORDINAL},
        on_zero="zero",
    )


def region_top_customers(
    tables: Tables, period: PeriodCompare, filters: Filters = NO_FILTERS, n: int = L.TOP_N
) -> DataFrame:
    """Top ``n`` customers per region by comparison-year volume.

    Ties are broken by customer code, then name, so the cut is deterministic."""
    return _top_customers(customer_level(tables, period, filters), n)


def _top_customers(cust: DataFrame, n: int) -> DataFrame:
    per_code = sum_up(cust, ["region", "region_ordinal", "customer_code", "customer_name"])
    order = [F.col("cmp").desc(), F.col("customer_code").asc_nulls_first(), F.col("customer_name").asc_nulls_first()]
    top = top_n_per_group(per_code, ["region"], order, n)
    return with_diff_growth(top, "zero").withColumn("label", _top_label())


def _top_label() -> F.Column:
    return concat_nullsafe(
        L.TOP_LABEL_PREFIX,
        F.col("rank").cast("string"),
        L.TOP_LABEL_MIDDLE,
        F.col("customer_code"),
        L.TOP_LABEL_SEPARATOR,
        F.col("customer_name"),
    )


def region_sectioned_report(
    tables: Tables, period: PeriodCompare, filters: Filters = NO_FILTERS, n: int = L.TOP_N
) -> DataFrame:
    """Summary section (regions and total), then per region a header row and
    its top customers. Hidden ordering columns: ``section``, ``sort_order``,
    ``region_ordinal``, ``rank``; measures are NULL on header rows.

    One pipeline: the sums per customer code are aggregated once more over
    the grouping sets (region, code, name), (region), (), and one
    ``row_number`` within (grouping level, region) cuts the customers; region
    and total rows are alone in theirs, so the same limit keeps them. The
    fact is scanned and joined to the customers once."""
    names = ["region", "region_ordinal", "customer_code", "customer_name"]
    per_code = sum_by(customer_level(tables, period, filters), names, ["base", "cmp"])
    typed = {f.name: f.dataType for f in per_code.schema.fields}
    # a marker row keeps the total set non-empty; its other groups are dropped
    marker = per_code.sparkSession.range(1).select(
        *[F.lit(None).cast(t).alias(x) for x, t in typed.items()], F.lit(True).alias("__marker")
    )
    marked = per_code.withColumn("__marker", F.lit(False)).unionByName(marker)
    regions = ["region", "region_ordinal", "__marker"]
    levels = marked.groupingSets([[*names, "__marker"], regions, []], *names, "__marker").agg(
        F.sum("base").cast(SUM_TYPE).alias("base"),
        F.sum("cmp").cast(SUM_TYPE).alias("cmp"),
        F.grouping("region").alias("total"),
        F.grouping("customer_code").alias("summed"),
    )
    levels = levels.where((F.col("total") == 1) | ~F.col("__marker")).drop("__marker")
    order = [F.col("cmp").desc(), F.col("customer_code").asc_nulls_first(), F.col("customer_name").asc_nulls_first()]
    cut = top_n_per_group(levels, ["total", "summed", "region"], order, n)
    c = F.col
    total = c("total") == 1
    cut = with_diff_growth(cut, "zero")
    own = F.struct(
        F.when(c("summed") == 1, F.lit(1)).otherwise(F.lit(2)).alias("section"),
        F.when(total | (c("summed") == 0), F.lit(2)).otherwise(F.lit(1)).alias("sort_order"),
        F.when(total, F.lit(L.REGION_TOTAL_ORDINAL)).otherwise(c("region_ordinal")).cast("int").alias("region_ordinal"),
        F.when(c("summed") == 0, c("rank")).cast("int").alias("rank"),
        F.when(total, F.lit(L.REGION_TOTAL_NAME)).when(c("summed") == 1, c("region")).otherwise(_top_label()).alias("label"),
        c("base"),
        c("cmp"),
        c("diff"),
        c("growth_pct"),
        total.alias("is_total"),
    )
    header = F.struct(
        F.lit(2).alias("section"),
        F.lit(1).alias("sort_order"),
        c("region_ordinal").cast("int").alias("region_ordinal"),
        F.lit(0).alias("rank"),
        F.upper(concat_nullsafe(L.TOP_HEADER_PREFIX, c("region"), L.TOP_HEADER_SUFFIX)).alias("label"),
        F.lit(None).cast(SUM_TYPE).alias("base"),
        F.lit(None).cast(SUM_TYPE).alias("cmp"),
        F.lit(None).cast(cut.schema["diff"].dataType).alias("diff"),
        F.lit(None).cast("double").alias("growth_pct"),
        F.lit(False).alias("is_total"),
    )
    rows = F.when((c("summed") == 1) & ~total, F.array(own, header)).otherwise(F.array(own))
    return cut.select(F.explode(rows).alias("r")).select("r.*")


# -- R5: region year-to-date growth --------------------------------------------


def region_ytd_growth(tables: Tables, period: PeriodCompare, filters: Filters = NO_FILTERS) -> DataFrame:
    """Per normalised region code over a month range of two years.

    INNER joins to customers and streets. The two yearly aggregates of the
    source were FULL joined on the code; a NULL code never matches, so it
    stays as one row per year that has rows. Here each customer row with a
    NULL code is split into a base-year and a comparison-year part tagged
    apart, inside the same aggregate. Unknown codes are shown one by one as
    "other (code)". Growth is NULL on a zero base.
    """
    bills = bill_filters(period_bills(tables, period), filters)
    j = per_customer(bills, period).join(filtered_customers(tables, filters, street=True), "customer_id", "inner")
    code = norm(F.col("region_code"))
    zero = F.lit(0).cast(SUM_TYPE)

    def part(tag: int, base, cmp_, rows):
        return F.struct(F.lit(tag).alias("tag"), base.alias("b"), cmp_.alias("c"), rows.alias("n"))

    parts = F.when(
        code.isNull(),
        F.array(
            part(1, F.col("base"), zero, F.col("base_rows")),
            part(2, zero, F.col("cmp"), F.col("cmp_rows")),
        ),
    ).otherwise(F.array(part(0, F.col("base"), F.col("cmp"), F.col("base_rows") + F.col("cmp_rows"))))
    exploded = j.select(code.alias("region_code"), F.explode(parts).alias("p")).select(
        "region_code", F.col("p.tag").alias("tag"), F.col("p.b").alias("base"), F.col("p.c").alias("cmp"),
        F.col("p.n").alias("n"),
    )
    out = with_total(
        exploded,
        ["region_code", "tag"],
        ["base", "cmp"],
        {"region_code": L.YTD_TOTAL_CODE},
        on_zero="null",
        extra_sums=["n"],
    ).where(F.col("is_total") | (F.col("n") > 0))
    k = F.col("region_code")
    total = F.col("is_total")
    return out.select(
        k,
        F.when(total, F.lit(L.YTD_TOTAL_LABEL)).otherwise(region_upper_name(k)).alias("region_label"),
        F.when(total, F.lit(6)).otherwise(region_ordinal(k)).alias("region_ordinal"),
        "base",
        "cmp",
        "is_total",
        "diff",
        "growth_pct",
    )


def full_join_years(tables: Tables, period: PeriodCompare) -> DataFrame:
    """The FULL OUTER join form itself: per normalised region code, each
    year aggregated on its own, then joined (INNER customer join)."""
    pc = per_customer(period_bills(tables, period), period)
    j = join_customer(pc, tables, "inner").withColumn("region_code", norm(F.col("region_code")))
    # both sides read one aggregate, whose shuffle is reused
    sums = sum_by(j, ["region_code"], ["base", "cmp"], ["base_rows", "cmp_rows"])
    base = sums.where(F.col("base_rows") > 0).select("region_code", F.col("base").alias("v"))
    cmp_ = sums.where(F.col("cmp_rows") > 0).select("region_code", F.col("cmp").alias("v"))
    return full_join_periods(base, cmp_, "region_code", "v")


# -- R6, R7: usage-purpose growth for one region ---------------------------------


def purpose_growth(tables: Tables, period: PeriodCompare, region: str) -> DataFrame:
    """Per usage purpose H/K/Q/S of one region (single month or year to date).

    The source LEFT joins the comparison year to the base year, so only
    purposes with at least one base-year bill appear (in detail and total).
    Growth 0 on a zero base."""
    bills = period_bills(tables, period).withColumn("purpose", norm(F.col("purpose_code")))
    bills = bills.where(F.col("purpose").isin(purpose_codes()))
    pc = per_customer(bills, period, extra_keys=("purpose",))
    j = pc.join(filtered_customers(tables, NO_FILTERS, region=region).select("customer_id"), "customer_id", "inner")
    per_purpose = j.groupBy("purpose").agg(
        F.sum("base").cast(SUM_TYPE).alias("base"),
        F.sum("cmp").cast(SUM_TYPE).alias("cmp"),
        F.sum("base_rows").alias("base_rows"),
    )
    kept = per_purpose.where(F.col("base_rows") > 0)
    p = F.col("purpose")
    detail = kept.select(
        purpose_ordinal(p).alias("ordinal"),
        p.alias("purpose_code"),
        purpose_name(p).alias("purpose_name"),
        "base",
        "cmp",
    )
    return with_total(
        detail,
        ["ordinal", "purpose_code", "purpose_name"],
        ["base", "cmp"],
        {"ordinal": L.PURPOSE_TOTAL_ORDINAL, "purpose_code": "", "purpose_name": L.PURPOSE_TOTAL_NAME},
        on_zero="zero",
    )


# -- R8: special-class growth ----------------------------------------------------


def class_period_growth(tables: Tables, period: PeriodCompare, filters: Filters = NO_FILTERS) -> DataFrame:
    """Per special customer class; all bills count (no cancelled filter).

    Per customer code: both years' sums and the greatest class seen in each
    year; the class is the comparison year's, else the base year's, else
    "unclassified". Growth NULL on a zero base."""
    bills = bill_filters(period_bills(tables, period, active_only=False), filters)
    j = per_customer(bills, period).join(filtered_customers(tables, filters, street=True), "customer_id", "inner")
    per_code = j.groupBy("customer_code").agg(
        F.sum("base").cast(SUM_TYPE).alias("base"),
        F.sum("cmp").cast(SUM_TYPE).alias("cmp"),
        F.max(F.when(F.col("cmp_rows") > 0, norm("class_code"))).alias("cmp_class"),
        F.max(F.when(F.col("base_rows") > 0, norm("class_code"))).alias("base_class"),
    )
    cls = F.coalesce(F.col("cmp_class"), F.col("base_class"), F.lit(L.CLASS_UNCLASSIFIED))
    out = with_total(per_code.withColumn("class_code", cls), ["class_code"], ["base", "cmp"], {}, on_zero="null")
    name = F.when(F.col("is_total"), F.lit(L.CLASS_TOTAL_NAME)).otherwise(class_name(F.col("class_code")))
    return out.select("class_code", name.alias("class_name"), "base", "cmp", "is_total", "diff", "growth_pct")


# -- building-block queries ---------------------------------------------------------


def region_decode(tables: Tables) -> DataFrame:
    """Every customer's raw region code with its normalised code, both name
    spellings and the ordinal."""
    code = norm(F.col("region_code"))
    return tables.customer.select(
        "customer_id",
        F.col("region_code").alias("raw_code"),
        code.alias("region_code"),
        region_name(code).alias("region_name"),
        region_upper_name(code).alias("region_label"),
        region_ordinal(code).alias("region_ordinal"),
    )


def growth_policies(tables: Tables, period: PeriodCompare) -> DataFrame:
    """Per customer, growth under the three zero-base policies."""
    pc = per_customer(period_bills(tables, period), period)
    b, c = F.col("base"), F.col("cmp")
    return pc.select(
        "customer_id",
        "base",
        "cmp",
        (c - b).cast(SUM_TYPE).alias("diff"),
        growth_pct(b, c, "zero").alias("growth_zero"),
        growth_pct(b, c, "null").alias("growth_null"),
        growth_pct(b, c, "inf", order="ratio").alias("growth_inf"),
    )


def region_growth_rollup(tables: Tables, period: PeriodCompare) -> DataFrame:
    """Detail per normalised region code plus the grand total in one
    ``rollup`` aggregate; a NULL code and the total differ by ``is_total``."""
    bills = period_bills(tables, period)
    j = per_customer(bills, period).join(
        tables.customer.select("customer_id", norm(F.col("region_code")).alias("region_code")), "customer_id", "left"
    )
    return rollup_total(j, "region_code")


def customer_include_list(tables: Tables, period: PeriodCompare, include) -> DataFrame:
    """Month growth per region restricted to an include list of customer codes."""
    return region_month_growth_filtered(tables, period, Filters(include_customers=include))


def customer_exclude_list(tables: Tables, period: PeriodCompare, exclude) -> DataFrame:
    """Month growth per region without the customers of an exclude list."""
    return region_month_growth_filtered(tables, period, Filters(exclude_customers=exclude))
