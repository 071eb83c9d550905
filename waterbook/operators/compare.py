"""Two-period comparison, growth and grand totals.

The reports compare a base and a comparison year. Written naively that is
two scans of the fact, two aggregates and a FULL or LEFT join. Here it is
one scan: ``year IN (base, cmp)`` and conditional sums in one aggregate,
which Spark computes partially on the map side, so a hot key costs one row
per map task in the shuffle.

Row sets of the joins are kept exactly:

* FULL join of the two yearly aggregates = groups with a row in either
  year. A NULL key never matches across a join, so a NULL key keeps one
  row per year (see ``region_ytd_growth``).
* LEFT join driven by the base year = groups with at least one base-year
  row, whatever their sum (see ``purpose_growth``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterbook.functions.growth import growth_pct
from waterbook.params import PeriodCompare
from waterbook.schemas import SUM_TYPE


def two_period(
    df: DataFrame,
    keys: Sequence[str],
    period: PeriodCompare,
    value: str = "volume",
    extra_aggs: Sequence[Column] = (),
) -> DataFrame:
    """Per ``keys``: ``base`` and ``cmp`` sums of ``value`` for the two years.

    ``df`` must already be restricted to the compared months and years.
    Callers add row counts per year (``extra_aggs``) when they need the
    FULL-join or LEFT-join row set described above.
    """
    year = F.col("year")
    v = F.coalesce(F.col(value), F.lit(0))
    return df.groupBy(*keys).agg(
        F.sum(F.when(year == period.base_year, v).otherwise(F.lit(0))).cast(SUM_TYPE).alias("base"),
        F.sum(F.when(year == period.cmp_year, v).otherwise(F.lit(0))).cast(SUM_TYPE).alias("cmp"),
        *extra_aggs,
    )


def with_diff_growth(df: DataFrame, on_zero: str, order: str = "sql") -> DataFrame:
    return df.withColumn("diff", (F.col("cmp") - F.col("base")).cast(SUM_TYPE)).withColumn(
        "growth_pct", growth_pct(F.col("base"), F.col("cmp"), on_zero, order)
    )


def sum_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Sums of volume ``measures`` and of row ``counts`` per key."""
    sums = [F.sum(m).cast(SUM_TYPE).alias(m) for m in measures] + [F.sum(n).cast("long").alias(n) for n in counts]
    return df.groupBy(*keys).agg(*sums)


def with_total(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    total_values: dict[str, object],
    on_zero: str,
    order: str = "sql",
    detail_on_zero: str | None = None,
    extra_sums: Sequence[str] = (),
) -> DataFrame:
    """Rows per key plus a grand-total row, then ``diff`` and ``growth_pct``.

    ``df`` may be the detail itself or finer rows (one per customer, say).
    It is summed per key first; one ``GROUPING SETS ((keys), ())`` aggregate
    over those few rows gives detail and total, so the pipeline that
    produced ``df`` runs once and ``Expand`` only doubles reduced rows.

    Key columns of the total row take ``total_values`` (NULL when absent);
    ``is_total`` flags it, so a NULL key is never mistaken for the total.
    Growth uses ``on_zero`` on the total and ``detail_on_zero`` (default the
    same) on detail rows. ``extra_sums`` are summed like measures but left
    out of diff/growth (row counts for a caller's filter).
    """
    keys = list(keys)
    sums = [*measures, *extra_sums]
    typed = {f.name: f.dataType for f in df.schema.fields}
    rows = sum_by(df, keys, measures, extra_sums)
    # One literal marker row keeps the grand-total set non-empty, so an empty
    # input still yields a total row (with NULL sums, like SUM over nothing).
    # Its own detail group is dropped again below.
    marker = df.sparkSession.range(1).select(
        *[F.lit(None).cast(typed[c]).alias(c) for c in rows.columns], F.lit(True).alias("__marker")
    )
    marked = rows.withColumn("__marker", F.lit(False)).unionByName(marker)
    agg = marked.groupingSets([[*keys, "__marker"], []], *keys, "__marker").agg(
        *[F.sum(F.col(m)).cast(SUM_TYPE if m in measures else "long").alias(m) for m in sums],
        (F.grouping_id() > 0).alias("is_total"),
    )
    agg = agg.where(F.col("is_total") | ~F.col("__marker"))
    total = F.col("is_total")
    key_cols = [
        F.when(total, F.lit(total_values.get(k)).cast(typed[k])).otherwise(F.col(k)).alias(k) for k in keys
    ]
    out = agg.select(*key_cols, *sums, "is_total").withColumn("diff", (F.col("cmp") - F.col("base")).cast(SUM_TYPE))
    g_total = growth_pct(F.col("base"), F.col("cmp"), on_zero, order)
    g_detail = growth_pct(F.col("base"), F.col("cmp"), detail_on_zero or on_zero, order)
    return out.withColumn("growth_pct", F.when(total, g_total).otherwise(g_detail))


def rollup_total(df: DataFrame, key: str, on_zero: str = "zero") -> DataFrame:
    """Detail per ``key`` of rows with ``base`` and ``cmp``, plus a grand
    total, by ``rollup`` over the sums per key; ``grouping(key)`` tells the
    total from a NULL key."""
    out = sum_by(df, [key], ["base", "cmp"]).rollup(key).agg(
        F.sum("base").cast(SUM_TYPE).alias("base"),
        F.sum("cmp").cast(SUM_TYPE).alias("cmp"),
        (F.grouping(key) == 1).alias("is_total"),
    )
    return with_diff_growth(out, on_zero)


def full_join_periods(base: DataFrame, cmp_: DataFrame, key: str, value: str) -> DataFrame:
    """FULL OUTER join of two per-key aggregates, key coalesced, missing
    sides as 0. A NULL key matches nothing, so each side keeps its own row."""
    b = base.select(F.col(key).alias("__kb"), F.col(value).alias("base"))
    c = cmp_.select(F.col(key).alias("__kc"), F.col(value).alias("cmp"))
    j = b.join(c, b["__kb"] == c["__kc"], "full")
    return j.select(
        F.coalesce(F.col("__kc"), F.col("__kb")).alias(key),
        F.coalesce(F.col("base"), F.lit(0)).cast(SUM_TYPE).alias("base"),
        F.coalesce(F.col("cmp"), F.lit(0)).cast(SUM_TYPE).alias("cmp"),
    ).withColumn("diff", (F.col("cmp") - F.col("base")).cast(SUM_TYPE))
