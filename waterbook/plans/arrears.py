"""Unpaid-invoice counts per cashier and payment channel.

Bills are filtered to the billing months, to invoices with money and to
invoices still open at the cut-off; then counted per (customer, cashier,
period, channel) before the customer join, so the join sees at most a few
rows per customer. The customer join is INNER (a bill without a customer
is not counted) and carries the optional region-list filter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waterbook.functions.codes import norm
from waterbook.functions.dates import month_key, unpaid_as_of
from waterbook.operators.filters import in_list, positive_invoice
from waterbook.params import ArrearsParams, CumulativeArrearsParams
from waterbook.sources import literals as L
from waterbook.sources.tables import Tables

CASHIER_CODES = [c for c, _, _ in L.CASHIERS]


def _cashier() -> F.Column:
    return norm(F.coalesce(F.col("cashier"), F.lit("")))


def _is_transfer() -> F.Column:
    return norm(F.coalesce(F.col("pay_channel"), F.lit(""))) == F.lit(L.TRANSFER_CHANNEL)


def _counted(bills: DataFrame, tables: Tables, regions, tags: tuple[str, ...] = ()) -> DataFrame:
    """Open bills of the listed cashiers, counted per customer, cashier,
    channel (and ``tags``) before customers are joined, so the join shuffles
    counts instead of bills; then only customers that exist (and are in the
    region list)."""
    listed = bills.withColumn("cashier_code", _cashier()).where(F.col("cashier_code").isin(CASHIER_CODES))
    counts = listed.groupBy("customer_id", "cashier_code", _is_transfer().alias("is_transfer"), *tags).agg(
        F.count(F.lit(1)).alias("n")
    )
    customers = in_list(tables.customer.select("customer_id", "region_code"), "region_code", regions, normalise=True)
    return counts.join(customers.select("customer_id"), "customer_id", "left_semi")


def _finish(counted: DataFrame, measures: dict[str, F.Column], spark) -> DataFrame:
    """Per-cashier counts and their total.

    Counts are summed per cashier first. The cashier list joins in as rows
    with NULL measures, not as a join, so every cashier gets a row (shown as
    0) and the total is never empty; a grouping-sets aggregate over those few
    rows adds the total. Names and order come from map lookups."""
    sums = [F.sum(F.when(cond, F.col("n"))).alias(name) for name, cond in measures.items()]
    per = counted.groupBy("cashier_code").agg(*sums)
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CASHIER_CODES])).alias("cashier_code"))
    agg = per.unionByName(listed, allowMissingColumns=True).groupingSets([["cashier_code"], []], "cashier_code").agg(
        *[F.sum(m).alias(m) for m in measures], (F.grouping_id() > 0).alias("is_total")
    )
    total = F.col("is_total")
    names = F.create_map(*[F.lit(x) for c, n, _ in L.CASHIERS for x in (c, n)])
    places = F.create_map(*[F.lit(x) for c, _, o in L.CASHIERS for x in (c, o)])
    own = lambda m: F.try_element_at(m, F.col("cashier_code"))
    return agg.select(
        F.when(total, F.lit(L.CASHIER_TOTAL[0])).otherwise(F.col("cashier_code")).alias("cashier"),
        F.when(total, F.lit(L.CASHIER_TOTAL[1])).otherwise(own(names)).alias("cashier_name"),
        F.when(total, F.lit(L.CASHIER_TOTAL[2])).otherwise(own(places)).cast("int").alias("sort_order"),
        "is_total",
        *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in measures],
    )


def arrears_snapshot(tables: Tables, p: ArrearsParams) -> DataFrame:
    """Open invoices of this billing month at the cut-off and of the previous
    billing month at the cut-off one month earlier, split by channel."""
    y1, m1 = p.previous_period
    cur = (F.col("year") == p.year) & (F.col("month") == p.month)
    prev = (F.col("year") == y1) & (F.col("month") == m1)
    bills = tables.consumption.where((cur | prev) & positive_invoice())
    posted, paid, flag = F.col("posted_at"), F.col("paid_at"), F.col("is_paid")
    tag = (
        F.when(cur & unpaid_as_of(posted, paid, flag, p.cutoff), F.lit(2))
        .when(prev & unpaid_as_of(posted, paid, flag, p.previous_cutoff), F.lit(1))
    )
    tagged = bills.withColumn("tag", tag).where(F.col("tag").isNotNull())
    counted = _counted(tagged, tables, p.regions, ("tag",))
    t, tr = F.col("tag"), F.col("is_transfer")
    measures = {
        "cur_transfer": (t == 2) & tr,
        "cur_cash": (t == 2) & ~tr,
        "cur_total": t == 2,
        "prev_transfer": (t == 1) & tr,
        "prev_cash": (t == 1) & ~tr,
        "prev_total": t == 1,
    }
    out = _finish(counted, measures, tables.spark)
    return out.withColumn("diff", F.col("cur_total") - F.col("prev_total"))


def arrears_cumulative(tables: Tables, p: CumulativeArrearsParams) -> DataFrame:
    """Open invoices at one cut-off over a range of billing months.

    The month range is ``year*12+month`` between two keys, the same order as
    comparing first-of-month dates, with no per-row date construction. A
    bill with an impossible month is left out here and returned by
    ``rejected_months``."""
    lo, hi = p.month_keys
    key = month_key(F.col("year"), F.col("month"))
    bills = tables.consumption.where(
        F.col("year").between(p.from_year, p.to_year)
        & F.col("month").between(1, 12)  # an impossible month never lands in a neighbour year
        & key.between(lo, hi)
        & unpaid_as_of(F.col("posted_at"), F.col("paid_at"), F.col("is_paid"), p.cutoff)
        & positive_invoice()
    )
    counted = _counted(bills, tables, p.regions)
    tr = F.col("is_transfer")
    return _finish(counted, {"open_transfer": tr, "open_cash": ~tr, "open_total": F.lit(True)}, tables.spark)


def arrears_daily(tables: Tables, p: CumulativeArrearsParams, first: dt.date, last: dt.date) -> DataFrame:
    """``arrears_cumulative`` at the end of every day from ``first`` to
    ``last``, in one scan: a bill is +1 on the day it is posted and -1 on the
    day it is paid, days before ``first`` count for it, and the open bills of
    a day are the sum so far. Bills collapse to counts per customer and day
    before any join; the running sum is over days per cashier, so its size
    is that of the result, not of the bills."""
    lo, hi = p.month_keys
    posted, paid = F.to_date("posted_at"), F.to_date("paid_at")
    closed = F.coalesce(F.col("is_paid"), F.lit(0)) == 1
    bills = tables.consumption.where(
        F.col("year").between(p.from_year, p.to_year)
        & F.col("month").between(1, 12)
        & month_key(F.col("year"), F.col("month")).between(lo, hi)
        & positive_invoice()
        & (posted <= F.lit(last))
        & (~closed | (paid > posted))  # paid at an unknown day: open on none
    )
    event = lambda day, n: F.struct(F.greatest(day, F.lit(first)).alias("day"), F.lit(n).alias("delta"))
    events = F.when(closed & (paid <= F.lit(last)), F.array(event(posted, 1), event(paid, -1))).otherwise(F.array(event(posted, 1)))
    moves = bills.select("customer_id", "cashier", "pay_channel", F.inline(events))
    counted = _counted(moves, tables, p.regions, ("day", "delta"))
    net = F.col("n") * F.col("delta")
    per = counted.groupBy("cashier_code", "day").agg(
        F.sum(F.when(F.col("is_transfer"), net)).alias("transfer"), F.sum(F.when(~F.col("is_transfer"), net)).alias("cash")
    )
    lines = tables.spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CASHIER_CODES])).alias("cashier_code"))
    grid = lines.select("cashier_code", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    daily = per.unionByName(grid, allowMissingColumns=True).groupingSets([["cashier_code", "day"], ["day"]], "cashier_code", "day").agg(
        F.sum("transfer").alias("transfer"), F.sum("cash").alias("cash"), (F.grouping("cashier_code") > 0).alias("is_total")
    )
    so_far = Window.partitionBy("is_total", "cashier_code").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("is_total")
    names = F.create_map(*[F.lit(x) for c, n, _ in L.CASHIERS for x in (c, n)])
    orders = F.create_map(*[F.lit(x) for c, _, o in L.CASHIERS for x in (c, o)])
    out = daily.select(
        "day",
        F.when(total, F.lit(L.CASHIER_TOTAL[0])).otherwise(F.col("cashier_code")).alias("cashier"),
        F.when(total, F.lit(L.CASHIER_TOTAL[1])).otherwise(names[F.col("cashier_code")]).alias("cashier_name"),
        F.when(total, F.lit(L.CASHIER_TOTAL[2])).otherwise(orders[F.col("cashier_code")]).alias("sort_order"),
        "is_total",
        F.coalesce(F.sum("transfer").over(so_far), F.lit(0)).alias("open_transfer"),
        F.coalesce(F.sum("cash").over(so_far), F.lit(0)).alias("open_cash"),
    )
    return out.withColumn("open_total", F.col("open_transfer") + F.col("open_cash"))


def rejected_months(tables: Tables) -> DataFrame:
    """Bills that no month report can place: year or month missing, or the
    month not 1 to 12. The cumulative report leaves these out."""
    c = tables.consumption
    bad = F.col("year").isNull() | ~F.coalesce(F.col("month").between(1, 12), F.lit(False))
    return c.where(bad).select("bill_id", "customer_id", "year", "month")


def positive_invoices(tables: Tables) -> DataFrame:
    """Bills that carry money under the bill-mode rule, with that amount."""
    c = tables.consumption
    a1 = F.coalesce(F.col("amount_1"), F.lit(0))
    a = F.coalesce(F.col("amount"), F.lit(0))
    amount = F.when(F.col("bill_mode") == 0, a1 + a).otherwise(a)
    return c.where(positive_invoice()).select("bill_id", "bill_mode", amount.cast("decimal(19,2)").alias("invoice_amount"))
