"""Domain tables derived from the generated base tables (the test adapter).

Each domain column is a SQL expression over one base table. The same text
is valid in Spark SQL and DuckDB, so the oracle queries inline exactly these
definitions as CTEs (see ``waterbook.oracle``); only ``trip.end_at`` needs a
per-engine interval expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUSTOMER = [
    ("customer_id", "c_custkey"),
    ("street_code", "lpad(cast(c_nationkey as string), 3, '0')"),
    ("meter_code", "lpad(cast(c_custkey as string), 7, '0')"),
    ("street_sub", "cast(c_custkey % 2 as int)"),
    ("name", "c_name"),
    (
        "region_code",
        "case c_nationkey % 7 when 0 then 'VT' when 1 then ' bria ' when 2 then 'LD' "
        "when 3 then 'XMOC' when 4 then 'cd' when 5 then 'ZZ' end",
    ),
    (
        "class_code",
        "case c_mktsegment when 'AUTOMOBILE' then '1' when 'BUILDING' then 'XD' "
        "when 'FURNITURE' then 'CQ' when 'MACHINERY' then case c_custkey % 2 when 0 then 'VIP' else ' vip ' end end",
    ),
]

STREET = [
    ("street_code", "lpad(cast(n_nationkey as string), 3, '0')"),
    ("street_sub", "d"),
]
STREET_WHERE = "n_nationkey <> 24"

CONSUMPTION = [
    ("bill_id", "o_orderkey"),
    ("customer_id", "case when o_orderkey % 53 = 0 then -1 else o_custkey end"),
    ("year", "cast(year(o_orderdate) as int)"),
    ("month", "case when o_orderkey % 997 = 0 then 13 else cast(month(o_orderdate) as int) end"),
    ("volume", "case when o_orderkey % 31 <> 0 then cast(floor(o_totalprice / 10) / 100 as decimal(18,2)) end"),
    ("is_cancelled", "case o_orderkey % 10 when 0 then 1 when 1 then null else 0 end"),
    (
        "purpose_code",
        "case o_orderkey % 5 when 0 then 'H' when 1 then 'k ' when 2 then 'Q' when 3 then ' s' else 'X' end",
    ),
    (
        "pay_channel",
        "case o_orderpriority when '1-URGENT' then 'AB' when '2-HIGH' then 'ab' "
        "when '3-MEDIUM' then 'TM' when '5-LOW' then ' aB ' end",
    ),
    (
        "cashier",
        "case o_orderkey % 8 when 0 then 'BAOCQ' when 1 then 'bayhv ' when 2 then 'HANTN' "
        "when 3 then 'HIENLTT' when 4 then 'THAOLN' when 5 then 'YENDT' when 6 then 'OTHER' end",
    ),
    ("posted_at", "case when o_orderkey % 97 <> 0 then cast(o_orderdate as date) + 10 end"),
    (
        "paid_at",
        "case when o_orderstatus = 'F' and o_orderkey % 11 <> 0 "
        "then cast(o_orderdate as date) + cast(20 + o_orderkey % 40 as int) end",
    ),
    ("is_paid", "case o_orderstatus when 'F' then 1 when 'O' then 0 end"),
    ("bill_mode", "case o_orderkey % 3 when 0 then 0 when 1 then 1 end"),
    ("amount_1", "cast(case when o_orderkey % 4 = 0 then o_totalprice else 0.0 end as decimal(18,2))"),
    ("amount", "cast(case when o_orderkey % 6 <> 0 then o_totalprice else 0.0 end as decimal(18,2))"),
]

LARGE_READING = [
    (
        "customer_code",
        "concat(lpad(cast(c_nationkey as string), 3, '0'), lpad(cast(c_custkey as string), 7, '0'))",
    ),
    ("name", "c_name"),
    (
        "region_code",
        "case c_nationkey % 7 when 0 then 'VT' when 1 then 'BRIA' when 2 then 'LD' "
        "when 3 then 'XMOC' when 4 then 'CD' else 'ZZ' end",
    ),
    ("read_at", "ts"),
    ("volume", "case when event_id % 17 <> 0 then cast(floor(value * 100) / 100 as decimal(18,2)) end"),
]

#: Number plate of a generated vehicle.
PLATE = "concat('72A-', lpad(cast(user_id as string), 5, '0'))"

TRIP = [
    ("id", "event_id"),
    ("car", PLATE),
    ("driver", "concat('D', cast(event_id % 3 as string))"),
    ("leader", "concat('L', cast(event_id % 7 as string))"),
    ("dest", "concat('P', cast(event_id % 41 as string))"),
    ("start_at", "ts"),
    ("duration_min", "cast(30 + floor(value * 10) as int)"),
    ("km_start", "event_id"),
    ("km_end", "case when event_id % 4 <> 0 then event_id + cast(floor(value) as bigint) end"),
]
TRIP_WHERE = "true"  # every event is an order
TRIP_END_SPARK = "start_at + make_dt_interval(0, 0, duration_min, 0)"
TRIP_END_DUCKDB = "start_at + to_minutes(duration_min)"

VEHICLE_PROFILE = [
    ("car", PLATE),
    ("seats", "cast(4 + user_id % 12 as int)"),
    ("year_made", "cast(2000 + user_id % 20 as int)"),
    (
        "next_maintenance",
        "case when user_id % 5 <> 0 then date '2024-01-01' + cast(user_id % 60 as int) end",
    ),
    ("next_inspection", "concat('2024-', lpad(cast(1 + user_id % 12 as string), 2, '0'))"),
]
VEHICLE_PROFILE_WHERE = "user_id % 6 <> 0"

# Profile edits: each event of a car saves a full profile.
PROFILE_WRITE = [
    ("car", PLATE),
    ("written_at", "ts"),
    ("write_id", "event_id"),
    ("seats", "cast(4 + (user_id + event_id) % 12 as int)"),
    ("year_made", "cast(2000 + user_id % 20 as int)"),
    ("next_maintenance", "cast(ts as date) + 30"),
    ("next_inspection", "concat('2024-', lpad(cast(1 + event_id % 12 as string), 2, '0'))"),
]
PROFILE_WRITE_WHERE = "true"

FLUSH_JOB = [
    ("id", "p_partkey"),
    ("length_m", "cast(case when p_partkey % 79 = 0 then -5 when p_partkey % 50 = 7 then 1 else 100 + p_size * 20 end as double)"),
    ("diameter_mm", "cast(case when p_partkey % 83 = 0 then -50 else 50 + (p_partkey % 8) * 100 end as double)"),
    (
        "roughness",
        "case when p_partkey % 61 <> 0 then "
        "cast(case p_partkey % 4 when 0 then 0.010 when 1 then 0.012 when 2 then 0.013 else 0.015 end as double) end",
    ),
    ("pressure_bar", "cast(p_partkey % 40 as double) / 10"),
    ("z_start", "case when p_partkey % 71 <> 0 then cast(p_size % 20 as double) end"),
    ("z_end", "cast(p_partkey % 20 as double)"),
    ("terrain", "case when p_partkey % 9 = 0 then 'FLAT' else 'CALC' end"),
    ("bends_90", "case when p_partkey % 73 = 0 then null when p_partkey % 50 = 7 then 0 else p_size % 6 end"),
    ("bends_45", "case when p_partkey % 50 = 7 then 0 else p_size % 4 end"),
    ("pig_loss_bar", "case when p_partkey % 67 <> 0 then cast(case when p_partkey % 2 = 0 then 0.15 else 0.25 end as double) end"),
    ("start_min", "cast((p_partkey * 37) % 1440 as int)"),
    ("end_min", "cast((p_partkey * 53) % 1440 as int)"),
    (
        "material",
        "case p_partkey % 6 when 0 then 'HDPE_PVC' when 1 then ' ductile_lined' when 2 then 'STEEL_NEW' "
        "when 3 then 'Iron_Old ' when 4 then 'WOOD' end",
    ),
    ("pig_type", "case p_partkey % 4 when 0 then 'SOFT' when 1 then 'dense ' when 2 then 'FOAM' end"),
]


def _project(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns])


# Schemas of the generated base tables that the adapter reads. Giving them
# avoids a footer-reading job per table at plan time (no inference).
BASE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in BASE_SCHEMAS:
        reader = reader.schema(BASE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(read_base(spark, sf_dir, "customer"), CUSTOMER)


def street(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_base(spark, sf_dir, "nation").where(STREET_WHERE)
    doubled = nation.select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    return _project(doubled, STREET)


def consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(read_base(spark, sf_dir, "orders"), CONSUMPTION)


def large_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_base(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    cust = read_base(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = events.join(cust, events.user_id == cust.c_custkey, "inner")
    return _project(joined, LARGE_READING)


def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_base(spark, sf_dir, "events").where(TRIP_WHERE)
    base = _project(events, TRIP)
    return base.withColumn("end_at", F.expr(TRIP_END_SPARK)).select(
        "id", "car", "driver", "leader", "dest", "start_at", "end_at", "duration_min", "km_start", "km_end"
    )


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_base(spark, sf_dir, "events").select(F.expr(PLATE).alias("car")).distinct()


def vehicle_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cars = read_base(spark, sf_dir, "events").select("user_id").distinct().where(VEHICLE_PROFILE_WHERE)
    return _project(cars, VEHICLE_PROFILE)


def profile_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_base(spark, sf_dir, "events").where(PROFILE_WRITE_WHERE)
    return _project(events, PROFILE_WRITE)


def flush_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(read_base(spark, sf_dir, "part"), FLUSH_JOB)


BUILDERS = {
    "customer": customer,
    "street": street,
    "consumption": consumption,
    "large_reading": large_reading,
    "trip": trip,
    "fleet": fleet,
    "vehicle_profile": vehicle_profile,
    "profile_write": profile_write,
    "flush_job": flush_job,
}
