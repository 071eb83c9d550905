"""JSON sources and sinks, partitioned fact layout, trip-order stream."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from waterbook.params import FleetParams
from waterbook.plans.fleet import trips_after_replacement
from waterbook.sources import lists
from waterbook.sources.tables import (
    Tables,
    read_profile_json,
    read_trip_json,
    write_consumption,
    write_json,
)
from waterbook.streaming import trip_log

from tests.conftest import SF_SMALL


def _write_lines(path, objs):
    with open(path, "w", encoding="utf-8") as fh:
        for o in objs:
            fh.write(json.dumps(o, ensure_ascii=False) + "\n")


def order(i, car, start, end, km="100", km_end=None, dest="Bà Rịa"):
    return {"id": i, "car": car, "driver": "A", "leader": "B", "dest": dest, "start": start, "end": end,
            "kmStart": km, "pass": "2", "kmEnd": km_end}


def test_trip_json_reader_types_and_bad_numbers(spark):
    d = tempfile.mkdtemp(prefix="wb-trips-")
    _write_lines(os.path.join(d, "a.json"), [
        order(1, "72A-12345", "2026-05-01T08:00", "2026-05-01T10:30", km="1200", km_end="1290"),
        order(2, "72A-12345", "2026-05-01T09:00", "", km="abc"),
    ])
    rows = {r.id: r for r in read_trip_json(spark, d).collect()}
    assert rows[1].start_at == dt.datetime(2026, 5, 1, 8, 0) and rows[1].km_end - rows[1].km_start == 90
    assert rows[2].end_at is None and rows[2].km_start is None


def test_profile_map_and_lines(spark):
    d = tempfile.mkdtemp(prefix="wb-prof-")
    doc = {"72A-12345": {"name": "Xe 1", "brand": "T", "seats": "7", "y1": "2019", "y2": "2020", "place": "X",
                         "type": "5.000km", "nextM": "2026-01-10", "nextR": "2026-07"},
           "72B-00123": {"name": "Xe 2", "seats": "x", "nextM": ""}}
    with open(os.path.join(d, "profiles.json"), "w", encoding="utf-8") as fh:
        json.dump(doc, fh, ensure_ascii=False)
    got = {r.car: r for r in read_profile_json(spark, d, layout="map").collect()}
    assert got["72A-12345"].seats == 7 and got["72A-12345"].next_maintenance == dt.date(2026, 1, 10)
    assert got["72B-00123"].seats is None and got["72B-00123"].next_maintenance is None
    out = tempfile.mkdtemp(prefix="wb-prof-out-")
    write_json(read_profile_json(spark, d, layout="map").withColumnRenamed("car", "car"), out)
    back = {r.car for r in spark.read.json(out).collect()}
    assert back == {"72A-12345", "72B-00123"}


def test_list_text_parse_and_column_tokens(spark):
    assert lists.parse_text(" 5499024\r\n,, 12 ,5499024\n") == ["5499024", "12"]
    df = spark.createDataFrame([(" a ,b\r\n",), (None,), ("b,,c",)], "t string")
    assert sorted(r.token for r in lists.tokens(df, "t").collect()) == ["a", "b", "c"]


def test_partitioned_fact_prunes_by_period(spark):
    root = tempfile.mkdtemp(prefix="wb-fact-")
    t = Tables.from_generated(spark, SF_SMALL)
    write_consumption(t.consumption, os.path.join(root, "consumption"))
    back = spark.read.parquet(os.path.join(root, "consumption"))
    q = back.where((F.col("year") == 1998) & (F.col("month") == 5))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan
    assert q.count() == t.consumption.where("year = 1998 AND month = 5").count()


def test_order_stream_applies_replace_policy(spark):
    src = tempfile.mkdtemp(prefix="wb-orders-")
    root = tempfile.mkdtemp(prefix="wb-log-")
    ck = tempfile.mkdtemp(prefix="wb-ck-")
    batch1 = [order(1, "C1", "2026-05-01T08:00", "2026-05-01T10:00"),
              order(2, "C1", "2026-05-01T11:00", "2026-05-01T12:00"),
              order(3, "C2", "2026-05-01T08:00", "2026-05-01T09:00")]
    batch2 = [order(4, "C1", "2026-05-01T09:30", "2026-05-01T11:30"),  # replaces 1 and 2
              order(5, "C2", "2026-05-01T09:00", "2026-05-01T10:00")]  # touches 3: no overlap
    _write_lines(os.path.join(src, "b1.json"), batch1)
    params = FleetParams(dt.datetime(2026, 5, 1, 12, 0))
    q = trip_log.start(spark, src, root, checkpoint_location=ck, available_now=True)
    q.awaitTermination(120)
    _write_lines(os.path.join(src, "b2.json"), batch2)
    q = trip_log.start(spark, src, root, checkpoint_location=ck, available_now=True)
    q.awaitTermination(120)
    state = {r.id for r in trip_log.read_log(spark, root, params).collect()}
    assert state == {3, 4, 5}
    again = tempfile.mkdtemp(prefix="wb-ck-")  # a new checkpoint reads all files again
    trip_log.start(spark, src, root, checkpoint_location=again, available_now=True).awaitTermination(120)
    assert state == {r.id for r in trip_log.read_log(spark, root, params).collect()}
    assert trip_log.read_orders(spark, root).count() == 5
    everything = read_trip_json(spark, src)
    assert state == {r.id for r in trips_after_replacement(everything, params).collect()}


def test_order_stream_refuse_policy(spark):
    from waterbook.plans.fleet import trips_after_refusal

    src = tempfile.mkdtemp(prefix="wb-orders-r-")
    root = tempfile.mkdtemp(prefix="wb-log-r-")
    ck = tempfile.mkdtemp(prefix="wb-ck-r-")
    _write_lines(os.path.join(src, "b1.json"), [order(1, "C1", "2026-05-01T08:00", "2026-05-01T10:00"),
                                                order(2, "C1", "2026-05-01T09:00", "2026-05-01T09:30")])
    params = FleetParams(dt.datetime(2026, 5, 1, 12, 0))
    q = trip_log.start(spark, src, root, checkpoint_location=ck, available_now=True)
    q.awaitTermination(120)
    _write_lines(os.path.join(src, "b2.json"), [order(3, "C1", "2026-05-01T09:45", "2026-05-01T11:00"),
                                                order(4, "C1", "2026-05-01T10:00", "2026-05-01T11:00")])
    q = trip_log.start(spark, src, root, checkpoint_location=ck, available_now=True)
    q.awaitTermination(120)
    state = {r.id for r in trip_log.read_log(spark, root, params, "refuse").collect()}
    assert state == {1, 4}
    assert state == {r.id for r in trips_after_refusal(read_trip_json(spark, src), params).collect()}
