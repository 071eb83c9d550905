"""Billed volume by month, customer and purpose, stored once for all comparisons.

The comparison reports read bills only to sum them, so they give the same
results from sums. The sums are stored by billing period; when bills change,
only the periods they belong to are computed and written again (dynamic
partition overwrite), and repeating that gives the same table. Every written
period has a marker row of no bills, so a period whose last bill went is
emptied too. Bills without a year or month are in no report and not stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterbook.operators.filters import active_bill
from waterbook.schemas import SUM_TYPE
from waterbook.sources.tables import Tables

PERIOD = ["year", "month"]
COLUMNS = f"customer_id long, purpose_code string, is_cancelled int, volume {SUM_TYPE}, bills long, year int, month int"


def monthly_totals(bills: DataFrame) -> DataFrame:
    """Sums per period, customer, purpose and cancellation. All-NULL volumes
    stay NULL; a customer of a third of all bills is summed map-side."""
    cancelled = F.when(active_bill(), F.lit(0)).otherwise(F.lit(1)).alias("is_cancelled")
    keys = [*PERIOD, "customer_id", "purpose_code", cancelled]
    return bills.groupBy(*keys).agg(F.sum("volume").cast(SUM_TYPE).alias("volume"), F.count(F.lit(1)).alias("bills"))


def _write(totals: DataFrame, periods: DataFrame, root: str, parts: int) -> None:
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    marker = periods.select(*PERIOD).distinct().withColumn("bills", F.lit(0).cast("long"))
    rows = totals.unionByName(marker, allowMissingColumns=True).select(*columns)
    dealt = rows.repartition(*PERIOD, F.pmod(F.xxhash64("customer_id"), F.lit(parts)))
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PERIOD).parquet(root)


def write_months(tables: Tables, root: str, parts: int = 32) -> None:
    """Every period of the billing fact."""
    bills = tables.consumption.where(F.col("year").isNotNull() & F.col("month").isNotNull())
    totals = monthly_totals(bills)
    _write(totals, totals, root, parts)


def refresh_months(tables: Tables, changed: DataFrame, root: str, parts: int = 32) -> None:
    """Compute the periods of the ``changed`` bills (new, altered, or as they
    were before they went) again from the billing fact. Periods are a few
    hundred at most, so they are listed and prune the scan of the fact."""
    periods = changed.select(*PERIOD).where("year is not null and month is not null").distinct()
    listed = periods.collect()
    if not listed:
        return
    here = reduce(lambda a, b: a | b, [(F.col("year") == y) & (F.col("month") == m) for y, m in listed])
    frame = tables.spark.createDataFrame(listed, "year int, month int")
    _write(monthly_totals(tables.consumption.where(here)), frame, root, parts)


def from_months(spark: SparkSession, tables: Tables, root: str) -> Tables:
    """``tables`` whose comparison reports read the stored sums."""
    return tables.with_table("consumption", spark.read.schema(COLUMNS).parquet(root).where("bills > 0"))


def refreshed(tables: Tables, root: str, year: int, month: int) -> Tables:
    """The store as it was before the bills of one period came, brought up to date."""
    new = (F.col("year") == year) & (F.col("month") == month)
    before = tables.consumption.where(F.coalesce(~new, F.lit(True)))
    write_months(tables.with_table("consumption", before), root)
    refresh_months(tables, tables.consumption.where(new), root)
    return from_months(tables.spark, tables, root)
