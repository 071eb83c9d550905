"""Ranking operators: top-k per group, latest two rows per key, dedup.

Top-k uses ``row_number`` followed by a filter; Catalyst turns that into a
``WindowGroupLimit`` that keeps at most k rows per group in each map task
before the shuffle, so even a group holding a third of all rows ships only
k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], n: int, rank_col: str = "rank"
) -> DataFrame:
    """Rows ranked 1..n per group. ``order_cols`` must end in a unique
    tie-break so the result is deterministic."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def latest_two(df: DataFrame, key: str, order_cols: Sequence[Column], value_cols: Sequence[str]) -> DataFrame:
    """Per key, the first and second row in ``order_cols`` order.

    Returns ``key`` plus ``last_<c>`` and ``prev_<c>`` for each value column
    (``prev_*`` NULL when the key has one row). Equivalent to numbering rows
    and LEFT joining rank 1 to rank 2 on the key, without the self-join:
    the window keeps two rows per key (limited before the shuffle), and the
    pivot that follows runs on the window's partitioning with no new
    exchange.
    """
    ranked = top_n_per_group(df, [key], order_cols, 2, "__rn")
    rn = F.col("__rn")
    aggs = []
    for c in value_cols:
        aggs.append(F.max(F.when(rn == 1, F.col(c))).alias(f"last_{c}"))
        aggs.append(F.max(F.when(rn == 2, F.col(c))).alias(f"prev_{c}"))
    return ranked.groupBy(key).agg(*aggs)


def min_per_key(df: DataFrame, key: str | Column, value: str, key_name: str | None = None) -> DataFrame:
    """One deterministic value per key: the smallest non-NULL one. Stands in
    for "any row per key" dedup; partial aggregation keeps it skew-proof."""
    k = F.col(key) if isinstance(key, str) else key
    name = key_name or (key if isinstance(key, str) else "key")
    return df.groupBy(k.alias(name)).agg(F.min(value).alias(value))
