"""The SQL sent to a database source, run in DuckDB (its own process only)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

from waterbook.sources import database
from waterbook.sources.tables import Tables


def _bounds(con, source, key, parts):
    found = con.execute(f"SELECT * FROM {database.bounds_source(source, key, parts)}").fetchall()
    return [lo for _, lo in sorted(found)]


def _counts(con, source, predicates):
    return [con.execute(f"SELECT count(*) FROM {source} WHERE {p}").fetchone()[0] for p in predicates]


@pytest.fixture
def con():
    c = duckdb.connect()
    # keys crowd at one end: equal ranges would put nearly all rows in the first
    c.execute("CREATE TABLE bills AS SELECT (i * i * i) // 1000 AS id, 2024 + i % 3 AS year, 1 + i % 12 AS month, "
              "'k''' || (i % 50) AS code, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS posted_at FROM range(10000) r(i)")
    c.execute("INSERT INTO bills VALUES (NULL, 2024, 5, NULL, NULL), (-7, NULL, NULL, 'z', NULL)")
    return c


@pytest.mark.parametrize("key", ["id", "code", "posted_at"])
@pytest.mark.parametrize("parts", [1, 2, 8, 64])
def test_every_row_is_in_one_range(con, key, parts):
    predicates = database.key_ranges(key, _bounds(con, "bills", key, parts))
    counts = _counts(con, "bills", predicates)
    assert sum(counts) == 10_002 and len(counts) <= parts
    both = " OR ".join(f"(({p}) AND ({q}))" for i, p in enumerate(predicates) for q in predicates[:i])
    if both:
        assert con.execute(f"SELECT count(*) FROM bills WHERE {both}").fetchone()[0] == 0


def test_crowded_keys_are_divided_evenly(con):
    counts = _counts(con, "bills", database.key_ranges("id", _bounds(con, "bills", "id", 8)))
    assert len(counts) == 8 and max(counts) < 1.2 * 10_002 / 8


def test_few_or_no_keys(con):
    con.execute("CREATE TABLE one AS SELECT 5 AS id FROM range(9)")
    con.execute("CREATE TABLE none AS SELECT 5 AS id WHERE false")
    for table, rows in (("one", 9), ("none", 0)):
        predicates = database.key_ranges("id", _bounds(con, table, "id", 4))
        assert predicates == ["1 = 1"] and _counts(con, table, predicates) == [rows]


def test_only_the_periods_leave_the_database(con):
    source = database.of_periods("bills", [(2024, 5), (2025, 5), (2024, 6)])
    got = con.execute(f"SELECT DISTINCT year, month FROM {source}").fetchall()
    assert set(got) <= {(2024, 5), (2025, 5), (2024, 6)} and got
    want = con.execute("SELECT count(*) FROM bills WHERE (year, month) IN ((2024, 5), (2025, 5), (2024, 6))").fetchone()[0]
    assert con.execute(f"SELECT count(*) FROM {source}").fetchone()[0] == want
    assert con.execute(f"SELECT count(*) FROM {database.of_periods('bills', [])}").fetchone()[0] == 0
    # a divided source of periods
    counts = _counts(con, source, database.key_ranges("id", _bounds(con, source, "id", 4)))
    assert sum(counts) == want


def test_literals():
    assert database.literal("o'k") == "'o''k'" and database.literal(Decimal("1.50")) == "1.50"
    assert database.literal(dt.date(2024, 5, 1)) == "'2024-05-01'"
    assert database.literal(dt.datetime(2024, 5, 1, 7, 30)) == "'2024-05-01T07:30:00'"
    for bad in (None, True, 1.5, b"x"):
        with pytest.raises(ValueError):
            database.literal(bad)
    with pytest.raises(ValueError):
        database.bounds_source("bills", "id", 0)


class _Reader:
    """Stands for a session whose reader notes what is asked of it."""

    def __init__(self):
        self.calls = []
        self.read = self

    def format(self, kind):
        self.options = {"format": kind}
        return self

    def option(self, key, value):
        self.options[key] = value
        return self

    def load(self):
        self.calls.append(self.options)
        return self

    def jdbc(self, url, source, predicates=None, properties=None):
        self.calls.append({"url": url, "source": source, "predicates": predicates, "properties": properties})
        return self

    def collect(self):
        return [{"part": 2, "lo": 40}, {"part": 1, "lo": 3}, {"part": 3, "lo": 90}]


def test_reader_gets_periods_and_ranges():
    spark = _Reader()
    tables = Tables.from_jdbc(
        spark,
        "jdbc:x",
        {"consumption": "dbo.bills", "customer": "dbo.customers", "street": "dbo.streets"},
        {"user": "u"},
        partitioning={"street": {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}},
        ranges={"consumption": ("bill_id", 3)},
        periods={"consumption": [(2025, 5)], "customer": [(2025, 5)]},
    )
    for name in ("consumption", "customer", "street"):
        tables.loaders[name]()
    bounds, rows, customers, streets = spark.calls
    source = "(SELECT * FROM dbo.bills AS t WHERE (year = 2025 AND month IN (5))) AS p"
    assert source in bounds["source"] and "NTILE(3)" in bounds["source"]
    assert rows["source"] == source and rows["properties"] == {"user": "u"}
    assert rows["predicates"] == ["bill_id < 40 OR bill_id IS NULL", "bill_id >= 40 AND bill_id < 90", "bill_id >= 90"]
    assert customers["dbtable"].startswith("(SELECT * FROM dbo.customers") and customers["user"] == "u"
    assert streets["dbtable"] == "dbo.streets" and streets["numPartitions"] == "3"
