"""The keyed store against whole-table updates, and which files a change touches."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from waterbook import schemas
from waterbook.operators.keyed_store import BUCKET, KeyedStore, hash_buckets, range_buckets
from waterbook.plans import logbook

from tests.conftest import rows_of

SCHEMA = "id long, v string, km long"


def store_of(spark, rows, width=10, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    store = KeyedStore(spark, tempfile.mkdtemp(prefix="wb-store-"), "id", frame.schema, range_buckets(width), **more)
    store.create(frame)
    return store


def files(store):
    """Data files of every bucket."""
    root = os.path.join(store.root, "rows")
    return {d: sorted(x for x in os.listdir(os.path.join(root, d)) if x.endswith(".parquet"))
            for d in os.listdir(root) if d.startswith(BUCKET)}


@pytest.mark.parametrize("max_listed", [10_000, 0])
def test_changes_touch_only_their_buckets(spark, max_listed):
    store = store_of(spark, [(i, f"v{i}", None) for i in range(40)], max_listed=max_listed)
    before = files(store)
    assert len(before) == 4
    store.set_columns(spark.createDataFrame([(12, 5), (12, 7), (99, 1)], "id long, km long"), ["km"])
    store.delete(spark.createDataFrame([(13,), (13,)], "id long"))
    after = files(store)
    assert {d for d in before if before[d] != after[d]} == {f"{BUCKET}=1"}
    got = {r.id: r for r in store.read().collect()}
    assert sorted(got) == [i for i in range(40) if i != 13]
    assert got[12].km == 7 and got[12].v == "v12" and got[11].km is None


def test_late_older_and_repeated_writes(spark):
    store = store_of(spark, [(1, "old", None), (2, "two", 1)])
    newer = spark.createDataFrame([(1, "new", 9), (3, "three", 1)], SCHEMA)
    older = spark.createDataFrame([(1, "mid", 5), (1, "mid", 4), (2, "two", 1)], SCHEMA)
    for batch in (newer, older, newer, older):
        store.put(batch, ["km"])
    assert rows_of(store.read()) == [(1, "new", 9), (2, "two", 1), (3, "three", 1)]
    store.delete(spark.createDataFrame([(1,)], "id long"))
    store.put(older, ["km"])  # older than what was deleted
    assert rows_of(store.read(), "id") == [(2,), (3,)]
    store.put(spark.createDataFrame([(1, "again", 10)], SCHEMA), ["km"])
    assert rows_of(store.read(), "id") == [(1,), (2,), (3,)]


def test_interrupted_change_is_finished(spark):
    store = store_of(spark, [(i, "a", 1) for i in range(20)])

    class Lost(Exception):
        pass

    class Interrupted(KeyedStore):
        def recover(self):
            if not self.spark.read.schema("id long").parquet(self._path("ready")).isEmpty():
                raise Lost

    broken = Interrupted(spark, store.root, "id", store.schema, store.bucket)
    with pytest.raises(Lost):
        broken.put(spark.createDataFrame([(3, "b", 2)], SCHEMA), ["km"])
    assert store.read().where("v = 'b'").count() == 0
    store.put(spark.createDataFrame([(15, "c", 2)], SCHEMA), ["km"])
    assert rows_of(store.read().where("v <> 'a'"), "id", "v") == [(15, "c"), (3, "b")]
    assert store.read().count() == 20


def test_empty_tables_changes_and_null_keys(spark):
    store = store_of(spark, [])
    none = spark.createDataFrame([], SCHEMA)
    store.put(none, ["km"])
    store.delete(none)
    assert store.read().count() == 0
    store.put(spark.createDataFrame([(None, "n", 1), (5, "x", 1)], SCHEMA), ["km"])
    assert rows_of(store.read(), "id", "v") == [(5, "x"), (None, "n")]
    plates = KeyedStore(spark, tempfile.mkdtemp(prefix="wb-plates-"), "v", store.schema, hash_buckets(8))
    plates.create(store.read())
    plates.delete(spark.createDataFrame([("n",)], "v string"))
    assert rows_of(plates.read(), "v") == [("x",)]


def test_deleting_a_whole_bucket(spark):
    store = store_of(spark, [(i, "a", 1) for i in range(20)])
    store.delete(spark.range(10))
    assert sorted(r.id for r in store.read().collect()) == list(range(10, 20))


def test_checked_trip_lines(spark):
    root = tempfile.mkdtemp(prefix="wb-lines-")
    with open(os.path.join(root, "a.json"), "w", encoding="utf-8") as fh:
        fh.write('{"id":1,"car":"C","start":"2026-05-01T08:00","kmStart":"12"}\n{"id":2,"car":"C","kmStart":"x"}\n'
                 '{"id":3,"car":"\n[]\nnull\n')
    rows = logbook.read_checked(spark, root).collect()
    assert {r.id: r.bad_fields for r in rows if r.id} == {1: [], 2: ["kmStart"]}
    assert rows[0].start_at == dt.datetime(2026, 5, 1, 8)
    assert '{"id":3,"car":"' in {r.bad_line for r in rows}


def test_profile_store_keeps_its_schema(spark):
    store = logbook.profile_store(spark, tempfile.mkdtemp(prefix="wb-prof-"), 4)
    rows = spark.createDataFrame([("A", 4, 2001, None, "x")], schemas.VEHICLE_PROFILE)
    logbook.start_profiles(store, rows)
    at = dt.datetime(2024, 1, 2)
    store.put(spark.createDataFrame([("A", at, 1, 5, 2001, None, "y"), ("B", at, 2, 7, 2002, None, None)],
                                    schemas.PROFILE_WRITE), logbook.VERSION)
    assert rows_of(store.read(), "car", "seats") == [("A", 5), ("B", 7)]
    assert store.read().where(F.col("written_at") == F.lit(at)).count() == 2
