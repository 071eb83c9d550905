"""Parallel reads of database tables: the SQL that the source itself runs.

A table read over JDBC comes through one connection unless the reader is told
how to divide it. Equal ranges between the least and the greatest key leave
most rows in a few of them where keys are not evenly spread. Here the database
says where its keys divide into equal counts, and one query a range is made.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


def literal(value) -> str:
    """``value`` as an SQL literal; quotes inside texts are doubled."""
    if isinstance(value, bool) or value is None:
        raise ValueError("a key bound is a number, a text, a date or a time")
    if isinstance(value, int | Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"'{value.isoformat(timespec='microseconds' if value.microsecond else 'seconds')}'"
    if isinstance(value, dt.date):
        return f"'{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise ValueError(f"no literal for a bound of type {type(value).__name__}")


def _named(source: str) -> str:
    """A table with a name of its own; ``(query) AS name`` has one."""
    return source if source.lstrip().startswith("(") else f"{source} AS t"


def of_periods(table: str, periods: Iterable[tuple[int, int]], year: str = "year", month: str = "month") -> str:
    """``table`` as a source with only the rows of the ``(year, month)``
    periods, so that other months never leave the database. Months of one
    year share one comparison of the year, which an index on it can serve.
    No period gives a source without rows."""
    months: dict[int, set[int]] = {}
    for y, m in periods:
        months.setdefault(int(y), set()).add(int(m))
    tests = [f"({year} = {y} AND {month} IN ({', '.join(map(str, sorted(ms)))}))" for y, ms in sorted(months.items())]
    return f"(SELECT * FROM {_named(table)} WHERE {' OR '.join(tests) or '1 = 0'}) AS p"


def bounds_source(source: str, key: str, parts: int) -> str:
    """A source of at most ``parts`` rows ``(part, lo)``: the least key of each
    of ``parts`` equal counts of the rows in the order of the key."""
    if parts < 1:
        raise ValueError("parts must be 1 or more")
    ranked = f"SELECT {key} AS k, NTILE({parts}) OVER (ORDER BY {key}) AS part FROM {_named(source)} WHERE {key} IS NOT NULL"
    return f"(SELECT part, MIN(k) AS lo FROM ({ranked}) AS r GROUP BY part) AS b"


def key_ranges(key: str, bounds: Sequence) -> list[str]:
    """Predicates, one a task, of which every row meets exactly one. ``bounds``
    are the least keys of the parts in the database's order; the first range
    also takes smaller and null keys (so rows written meanwhile are not lost)
    and the last is open above. Equal neighbours are one bound: a key is never
    divided, so a unique key is the one to choose."""
    cuts = [literal(v) for n, v in enumerate(bounds) if n and v != bounds[n - 1]]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{key} >= {lo} AND {key} < {hi}" for lo, hi in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *inner, f"{key} >= {cuts[-1]}"]


def read_in_ranges(
    spark: SparkSession, url: str, source: str, key: str, parts: int, properties: dict[str, str] | None = None
) -> DataFrame:
    """``source`` (a table or ``(query) AS name``) in about ``parts`` tasks of
    equal counts by ``key``. The driver reads ``parts`` bounds, no rows."""
    properties = dict(properties or {})
    found = spark.read.jdbc(url, bounds_source(source, key, parts), properties=properties).collect()
    bounds = [r["lo"] for r in sorted(found, key=lambda r: r["part"])]
    return spark.read.jdbc(url, source, predicates=key_ranges(key, bounds), properties=properties)
