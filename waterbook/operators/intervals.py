"""Interval overlap join on an equality key (same vehicle, times overlap).

Overlap of half-open intervals: ``a.start < b.end AND a.end > b.start``.
A plain equi-join on the key would compare every pair of one key's rows;
a key holding a third of the data would be a quadratic single task.
Instead rows meet in ``(key, level, bucket)``: buckets of level 0 are short,
and of every further level ``STEP`` times as wide. An interval is at home on
the first level whose buckets are at least as long as it is, where it touches
at most two of them and covers at least ``1 / STEP`` of one (but for level 0).
Two intervals meet on the greater of their home levels, so one of the two is
always at home: home rows are joined with the rows of their own level and with
the visitors from below. A row visits only levels that are the home of some
interval, so short intervals alone cost no long buckets. What is compared
in a bucket thus stays within a small multiple of the pairs that do overlap,
however many rows the key has. A pair is emitted in the bucket that holds
``greatest(a.start, b.start)``, once, with no ``distinct``. Buckets are wall
clock arithmetic, so no time zone is involved. Exact for any intervals,
including end before start; intervals without both times overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import datetime as dt
import math

EPOCH = dt.date(1970, 1, 1)


def bucket_of(ts: Column, bucket_minutes: int) -> Column:
    if 1440 % bucket_minutes:
        raise ValueError("bucket_minutes must divide a day (1440)")
    per_day = 1440 // bucket_minutes
    day = F.date_diff(F.to_date(ts), F.lit(EPOCH)).cast("long")
    minute_of_day = F.hour(ts) * F.lit(60) + F.minute(ts)
    return day * F.lit(per_day) + F.floor(minute_of_day / F.lit(bucket_minutes)).cast("long")


#: Width of a level's buckets over those of the level below; 15 levels from a
#: quarter of an hour up span more than 7,000 years.
STEP, LEVELS = 4, 15


def _minute(ts: Column) -> Column:
    """Whole minutes of the wall clock since 1970 (towards it before)."""
    return (ts.cast("timestamp_ntz") - F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")).cast("interval minute").cast("long")


def _width(level: Column, bucket_minutes: int) -> Column:
    return F.lit(bucket_minutes) * F.pow(F.lit(float(STEP)), level)


def _homes(df: DataFrame, key: str, id_col: str, start: str, end: str, width: int) -> DataFrame:
    """A row per interval with both times, and its home level."""
    lo, hi = _minute(F.least(start, end)), _minute(F.greatest(start, end))
    home = F.ceil(F.log2(F.greatest(hi - lo, F.lit(1)) / width) / math.log2(STEP)).cast("int")
    home = F.greatest(F.lit(0), F.least(home, F.lit(LEVELS - 1)))
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"),
        lo.alias("lo"), hi.alias("hi"), home.alias("home"),
    )


def _in_buckets(rows: DataFrame, width: int) -> DataFrame:
    """A row per bucket that an interval touches on its ``level``."""
    at = lambda c: F.floor(F.col(c) / _width(F.col("level"), width))
    return rows.withColumn("b", F.explode(F.sequence(at("lo"), at("hi")))).drop("lo", "hi")


def _at_home(rows: DataFrame, width: int) -> DataFrame:
    return _in_buckets(rows.withColumn("level", F.col("home")), width)


def _visiting(rows: DataFrame, hosts: DataFrame, width: int, own: bool) -> DataFrame:
    """Rows on the levels above their home (``own``: and on it) that are home
    to some row of ``hosts``: a scalar subquery of at most ``LEVELS`` numbers,
    so neither side is shuffled for it."""
    levels = hosts.agg(F.sort_array(F.collect_set("home"))).scalar()
    rows = rows.withColumn("levels", levels)
    above = F.filter("levels", lambda x: x >= F.col("home") if own else x > F.col("home"))
    return _in_buckets(rows.withColumn("level", F.explode(above)).drop("levels"), width)


def _meet() -> Column:
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    return (a("k") == b("k")) & (a("level") == b("level")) & (a("b") == b("b"))


def _overlap() -> Column:
    return (F.col("a.s") < F.col("b.e")) & (F.col("a.e") > F.col("b.s"))


def meetings(df: DataFrame, key: str, id_col: str, start: str, end: str, bucket_minutes: int = 15) -> DataFrame:
    """What ``overlapping_pairs`` compares: rows ``a`` at home with rows ``b``
    of the same bucket, before any comparison of times."""
    rows = _homes(df, key, id_col, start, end, bucket_minutes)
    return _at_home(rows, bucket_minutes).alias("a").join(_visiting(rows, rows, bucket_minutes, own=True).alias("b"), _meet())


def overlapping_pairs(
    df: DataFrame,
    key: str,
    id_col: str,
    start: str,
    end: str,
    bucket_minutes: int = 15,
) -> DataFrame:
    """All unordered overlapping pairs within each key: ``(key, first_id,
    second_id)`` with ``first_id < second_id`` (ids must be unique)."""
    once = (F.col("b.home") < F.col("a.home")) | (F.col("b.id") > F.col("a.id"))
    place = F.floor(_minute(F.greatest("a.s", "b.s")) / _width(F.col("a.level"), bucket_minutes))
    pairs = meetings(df, key, id_col, start, end, bucket_minutes).where(_overlap() & once & (F.col("a.b") == place))
    return pairs.select(
        F.col("a.k").alias(key),
        F.least("a.id", "b.id").alias("first_id"),
        F.greatest("a.id", "b.id").alias("second_id"),
    )


def with_overlap(
    df: DataFrame, others: DataFrame, key: str, id_col: str, start: str, end: str, which: str, bucket_minutes: int = 15
) -> DataFrame:
    """Distinct ids of ``df`` that overlap a row of ``others`` of the same key
    and a ``which`` id (``"later"``, ``"earlier"`` or ``"other"``). Semi
    joins, of rows at home with the other side's rows there and of visitors
    with the other side's rows at home: no pair is ever made a row."""
    than = {
        "later": F.col("b.id") > F.col("a.id"),
        "earlier": F.col("b.id") < F.col("a.id"),
        "other": F.col("b.id") != F.col("a.id"),
    }[which]
    w = bucket_minutes
    a, b = (_homes(x, key, id_col, start, end, w) for x in (df, others))
    at_home = _at_home(a, w).alias("a").join(_visiting(b, a, w, own=True).alias("b"), _meet() & _overlap() & than, "left_semi")
    visitors = _visiting(a, b, w, own=False).alias("a").join(_at_home(b, w).alias("b"), _meet() & _overlap() & than, "left_semi")
    return at_home.select("id").union(visitors.select("id")).distinct().select(F.col("id").alias(id_col))


def overlap_components(
    df: DataFrame, key: str, id_col: str, start: str, end: str, bucket_minutes: int = 1440
) -> DataFrame:
    """Label each row with the connected component of its key's interval
    overlap graph: ``(component_lo, component_id)`` of the component's first
    interval in ``(lo, id)`` order, where ``lo/hi`` are the interval's
    earlier/later end. Rows whose open spans intersect, directly or through
    a chain, share a component; intervals that only touch do not (they
    cannot overlap). Rows with a NULL time get no component.

    A new component starts where ``lo`` is past every earlier ``hi``: a
    running maximum. It is computed in two levels so no task sorts all rows
    of one key: per-bucket maxima scanned over the key's bucket list, then a
    window inside each (key, bucket).
    """
    from pyspark.sql import Window

    lo = F.least(F.col(start), F.col(end))
    hi = F.greatest(F.col(start), F.col(end))
    base = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(key).alias("__k"),
        F.col(id_col).alias("__id"),
        lo.alias("__lo"),
        hi.alias("__hi"),
        bucket_of(lo, bucket_minutes).alias("__b"),
    )
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = base.groupBy("__k", "__b").agg(F.max("__hi").alias("__bmax"))
    per_bucket = per_bucket.withColumn("__carry_hi", F.max("__bmax").over(before)).drop("__bmax")
    x = base.join(per_bucket, ["__k", "__b"])
    inside = Window.partitionBy("__k", "__b").orderBy("__lo", "__id")
    prev_hi = F.greatest(F.col("__carry_hi"), F.max("__hi").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # ">=": intervals that only touch never overlap (overlap needs the open
    # spans to intersect, reversed and empty intervals included), so a run
    # of back-to-back trips is many small components, not one
    x = x.withColumn("__start", prev_hi.isNull() | (F.col("__lo") >= prev_hi))
    marker = F.when(F.col("__start"), F.struct(F.col("__lo").alias("lo"), F.col("__id").alias("id")))
    x = x.withColumn("__last_in", F.max(marker).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    starts = x.groupBy("__k", "__b").agg(F.max(marker).alias("__bstart"))
    starts = starts.withColumn("__carry_start", F.max("__bstart").over(before)).drop("__bstart")
    y = x.join(starts, ["__k", "__b"])
    comp = F.coalesce(F.col("__last_in"), F.col("__carry_start"))
    return y.select(
        F.col("__k").alias(key),
        F.col("__id").alias(id_col),
        comp.getField("lo").alias("component_lo"),
        comp.getField("id").alias("component_id"),
    )
