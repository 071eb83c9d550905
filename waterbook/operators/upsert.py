"""Keyed writes expressed as DataFrame operations.

* ``latest_per_key``: last write wins per key, as one aggregate over a
  struct ordered by version (partial aggregation; no window, no sort of a
  hot key's rows in one task).
* ``update_by_key``: set columns from an update set (LEFT join, coalesce).
* ``delete_by_key``: drop rows whose key is in a delete set (anti join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, version_cols: Sequence[str]) -> DataFrame:
    """The row with the greatest ``version_cols`` (compared in order) per key.
    Version columns must make the order total within a key."""
    payload = [c for c in df.columns if c != key]
    ordered = F.struct(*[F.col(v).alias(f"__v{i}") for i, v in enumerate(version_cols)], *[F.col(c) for c in payload])
    best = df.groupBy(key).agg(F.max(ordered).alias("__best"))
    return best.select(key, *[F.col(f"__best.{c}").alias(c) for c in payload])


def update_by_key(
    df: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], version_cols: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``df`` with ``columns`` replaced where ``updates`` has a
    non-NULL value. Of several updates of a key the greatest by
    ``version_cols``, then by ``columns``, counts, so no row is multiplied."""
    latest = latest_per_key(updates.select(key, *version_cols, *columns), key, [*version_cols, *columns])
    u = latest.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(u, key, "left")
    out = [F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*out)


def delete_by_key(df: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    return df.join(deletes.select(key), key, "left_anti")
