"""Large-customer meter readings: latest vs previous reading.

The source numbers readings per customer and LEFT self-joins rank 1 to
rank 2. Here one window keeps the two latest readings per customer
(a ``WindowGroupLimit`` drops the rest before the shuffle, so a customer
with a third of all readings ships two rows per task) and a pivot on the
same partitioning turns them into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterbook.functions.codes import concat_nullsafe, norm
from waterbook.functions.dates import in_calendar_year
from waterbook.functions.growth import growth_pct
from waterbook.operators.rank import latest_two, min_per_key
from waterbook.params import ReadingParams
from waterbook.schemas import SUM_TYPE
from waterbook.sources import literals as L
from waterbook.sources.tables import Tables


def customer_dedup(tables: Tables) -> DataFrame:
    """One class per concatenated customer code (the smallest non-NULL).

    Keyed on the concatenated code, not the (street, meter) pair: two pairs
    can concatenate to the same code, and the readings only know the code."""
    c = tables.customer
    code = concat_nullsafe(F.col("street_code"), F.col("meter_code"))
    folded = c.withColumn("class_code", norm("class_code"))
    return min_per_key(folded, code, "class_code", key_name="customer_code")


def reading_delta(tables: Tables, p: ReadingParams) -> DataFrame:
    """Per customer of a region and year: latest and previous reading dates
    and volumes (NULL volume as 0), the change, and the customer class
    (``'1'`` when unknown)."""
    r = tables.large_reading.where(
        (norm(F.col("region_code")) == F.lit(p.region.strip(" ").upper())) & in_calendar_year(F.col("read_at"), p.year)
    )
    r = r.withColumn("reading", F.struct("read_at", F.coalesce(F.col("volume"), F.lit(0)).alias("volume"), "name"))
    order = [
        F.col("read_at").desc(),
        F.col("volume").desc_nulls_last(),
        F.col("name").asc_nulls_first(),
    ]
    two = latest_two(r.select("customer_code", "read_at", "volume", "name", "reading"), "customer_code", order, ["reading"])
    # one class per code, by partial aggregation of the narrow master columns
    dedup = customer_dedup(tables)
    j = two.join(dedup, "customer_code", "left")
    last_v = F.coalesce(F.col("last_reading.volume"), F.lit(0))
    prev_v = F.coalesce(F.col("prev_reading.volume"), F.lit(0))
    return j.select(
        F.coalesce(F.col("class_code"), F.lit(L.DEFAULT_READING_CLASS)).alias("class_code"),
        "customer_code",
        F.col("last_reading.name").alias("name"),
        F.col("prev_reading.read_at").alias("prev_read_at"),
        F.col("last_reading.read_at").alias("last_read_at"),
        prev_v.cast(SUM_TYPE).alias("prev_volume"),
        last_v.cast(SUM_TYPE).alias("last_volume"),
        (last_v - prev_v).cast(SUM_TYPE).alias("delta"),
        growth_pct(prev_v, last_v, "zero").alias("growth_pct"),
    )


def reading_class_summary(tables: Tables, p: ReadingParams) -> DataFrame:
    """The fixed class catalogue with per-class sums (zeros kept), and a
    total over *all* customers, including classes missing from the
    catalogue, so detail rows need not add up to the total.

    No join: the catalogue classes are added to the input as rows with NULL
    measures, one grouping-sets aggregate gives per-class sums and the total
    (NULL sums when there are no readings, as SUM over nothing), and the
    catalogue attributes are looked up from the class code."""
    rows = reading_delta(tables, p)
    measures = ("prev_volume", "last_volume", "delta")
    codes = [c for _, _, _, c in L.CLASS_CATALOGUE]
    cat_rows = tables.spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("class_code"))
    marked = rows.select("class_code", *measures).unionByName(cat_rows, allowMissingColumns=True)
    agg = marked.groupingSets([["class_code"], []], "class_code").agg(
        *[F.sum(m).cast(SUM_TYPE).alias(m) for m in measures], (F.grouping_id() > 0).alias("is_total")
    )
    total = F.col("is_total")
    kept = agg.where(total | F.col("class_code").isin(codes))

    def lookup(i: int) -> F.Column:
        m = F.create_map(*[F.lit(x) for row in L.CLASS_CATALOGUE for x in (row[3], row[i])])
        return F.try_element_at(m, F.col("class_code"))

    out = kept.select(
        F.when(total, F.lit(L.CATALOGUE_TOTAL_ORDINAL)).otherwise(lookup(0)).cast("int").alias("sort_order"),
        F.when(total, F.lit(L.CATALOGUE_TOTAL_LABEL)).otherwise(lookup(1)).alias("purpose_name"),
        F.when(total, F.lit(None).cast("string")).otherwise(lookup(2)).alias("group_name"),
        F.when(total, F.lit(None).cast("string")).otherwise(F.col("class_code")).alias("class_code"),
        *[F.when(total, F.col(m)).otherwise(F.coalesce(F.col(m), F.lit(0))).cast(SUM_TYPE).alias(m) for m in measures],
        total.alias("is_total"),
    )
    return out.withColumn("growth_pct", growth_pct(F.col("prev_volume"), F.col("last_volume"), "zero"))
