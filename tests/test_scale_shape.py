"""Plan properties that matter at scale, checked on every registered query."""

from __future__ import annotations

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_CHECK, SF_SMALL
from waterbook import catalog as C
from waterbook.plans import arrears, consumption, readings
from waterbook.sources.tables import DOMAIN_TABLES, Tables, write_consumption

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_no_cross_products_anywhere(spark, broadcast):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for name, fn in E.queries().items():
            plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            for bad in FORBIDDEN:
                assert bad not in plan, f"{name}: {bad}"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_input_order_does_not_change_results(spark):
    t = Tables.from_generated(spark, SF_CHECK)
    shuffled = t
    for name in ("consumption", "customer", "large_reading"):
        shuffled = shuffled.with_table(name, t.get(name).orderBy(F.rand(7)).repartition(5))
    for fn in (
        lambda x: consumption.region_sectioned_report(x, C.MONTH),
        lambda x: consumption.class_period_growth(x, C.CLASS_PERIOD),
        lambda x: arrears.arrears_snapshot(x, C.ARREARS),
        lambda x: readings.reading_class_summary(x, C.READING),
    ):
        a = sorted(map(tuple, fn(t).collect()), key=repr)
        b = sorted(map(tuple, fn(shuffled).collect()), key=repr)
        assert a == b


def test_parquet_lake_layout_gives_same_reports(spark):
    root = tempfile.mkdtemp(prefix="wb-lake-")
    gen = Tables.from_generated(spark, SF_CHECK)
    for name in DOMAIN_TABLES:
        path = os.path.join(root, name)
        if name == "consumption":
            write_consumption(gen.get(name), path)
        else:
            gen.get(name).write.parquet(path)
    lake = Tables.from_parquet(spark, root)
    for fn in (
        lambda x: consumption.region_ytd_growth(x, C.YTD),
        lambda x: arrears.arrears_cumulative(x, C.CUMULATIVE),
        lambda x: readings.reading_delta(x, C.READING),
    ):
        a = sorted(map(tuple, fn(gen).collect()), key=repr)
        b = sorted(map(tuple, fn(lake).collect()), key=repr)
        assert a == b
    plan = consumption.region_ytd_growth(lake, C.YTD)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ <= 5", plan)
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ IN \(1997,1998\)", plan)


def test_bucketed_layout_needs_no_shuffle_of_the_fact(spark):
    from waterbook.sources.tables import write_bucketed

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # dimensions too big to broadcast
    try:
        gen = Tables.from_generated(spark, SF_CHECK)
        write_bucketed(gen, "wb_bucketed_test", tempfile.mkdtemp(prefix="wb-bucketed-"), 8)
        lake = Tables.from_catalog(spark, "wb_bucketed_test")
        df = consumption.region_month_growth(lake, C.MONTH)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(customer_id" not in plan  # only region sums move
        sheet = consumption.region_sectioned_report(lake, C.MONTH)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(customer_id" not in sheet
        assert sheet.count("FileScan parquet spark_catalog.wb_bucketed_test.consumption") == 1
        assert sheet.count("SortMergeJoin") == 1
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(
            map(tuple, consumption.region_month_growth(gen, C.MONTH).collect()), key=repr
        )
        rd = readings.reading_delta(lake, C.READING)._jdf.queryExecution().executedPlan().toString()
        reading_side = rd.split("SortMergeJoin")[1].split("Exchange")[0]
        assert "large_reading" in reading_side  # window + pivot on the buckets, no exchange before them
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
