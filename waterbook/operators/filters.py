"""Row filters of the reports (all pushed to the scan where possible)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterbook.functions.codes import norm
from waterbook.sources import lists


def active_bill() -> Column:
    """``is_cancelled IS NULL OR is_cancelled = 0``."""
    return F.coalesce(F.col("is_cancelled"), F.lit(0)) == 0


def positive_invoice() -> Column:
    """Invoice has money: with bill mode 0 both amounts count, otherwise (a
    NULL mode included) only the main amount."""
    a1 = F.coalesce(F.col("amount_1"), F.lit(0))
    a = F.coalesce(F.col("amount"), F.lit(0))
    return F.when(F.col("bill_mode") == 0, a1 + a).otherwise(a) > 0


def in_list(df: DataFrame, col: Column | str, param, negate: bool = False, normalise: bool = False) -> DataFrame:
    """Keep rows whose ``col`` is (``negate``: is not) in a list parameter.

    Text or sequence parameters are parsed on the driver and become an
    ``isin`` hash set; a DataFrame parameter becomes a semi / anti join, and
    AQE broadcasts it only when its shuffle stage proves small at run time.
    ``None`` means the filter is off.
    """
    if param is None:
        return df
    key = F.col(col) if isinstance(col, str) else col
    key = norm(key) if normalise else key
    if isinstance(param, DataFrame):
        token_df = lists.to_frame(df.sparkSession, param, out="__token")
        if normalise:
            token_df = token_df.select(norm(F.col("__token")).alias("__token"))
        tmp = df.withColumn("__key", key)
        how = "left_anti" if negate else "left_semi"
        return tmp.join(token_df, tmp["__key"] == token_df["__token"], how).drop("__key")
    values = lists.to_values(param)
    if normalise:
        values = sorted({v.upper() for v in values})
    if not values:
        # an empty include list keeps nothing, an empty exclude list keeps all
        return df if negate else df.where(F.lit(False))
    cond = key.isin(values)
    return df.where(~cond if negate else cond)


def equals_optional(df: DataFrame, col: Column | str, value: str | None, normalise: bool = True) -> DataFrame:
    """``@p IS NULL OR col = @p``: the predicate exists only when set."""
    if value is None:
        return df
    key = F.col(col) if isinstance(col, str) else col
    if normalise:
        return df.where(norm(key) == F.lit(value.strip(" ").upper()))
    return df.where(key == F.lit(value))
