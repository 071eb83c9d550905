"""Vehicle profiles and trip orders kept as keyed stores, changed in batches.

The typed reports of ``fleet`` compute a whole new table from a change; here
only the buckets a change names are rewritten (``operators.keyed_store``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waterbook import schemas
from waterbook.functions.dates import ntz
from waterbook.operators.keyed_store import KeyedStore, hash_buckets, range_buckets
from waterbook.params import FleetParams
from waterbook.plans.fleet import cancellations, returns_due
from waterbook.sources.tables import Tables, bad_trip_fields, typed_trip_columns, write_json

VERSION = ("written_at", "write_id")


def profile_store(spark: SparkSession, root: str, buckets: int = 64) -> KeyedStore:
    """Profiles by plate with the version of their last write."""
    return KeyedStore(spark, root, "car", schemas.PROFILE_WRITE, hash_buckets(buckets))


def trip_store(spark: SparkSession, root: str, ids_per_bucket: int = 1_000_000) -> KeyedStore:
    """Trip orders by id; ids grow with time, so returns and cancellations
    of recent orders touch the last buckets only."""
    return KeyedStore(spark, root, "id", schemas.TRIP, range_buckets(ids_per_bucket))


def start_profiles(store: KeyedStore, profiles: DataFrame) -> None:
    """Profiles without a write of their own rank below every write."""
    null = [F.lit(None).cast(schemas.PROFILE_WRITE[c].dataType).alias(c) for c in VERSION]
    store.create(profiles.select("*", *null))


def profiles_after_batches(tables: Tables, root: str, split: dt.datetime) -> DataFrame:
    """Stored profiles after two batches of writes, those from ``split`` on
    arriving first: a late, older write changes nothing."""
    store = profile_store(tables.spark, root)
    start_profiles(store, tables.vehicle_profile)
    late = F.coalesce(F.col("written_at") < ntz(split), F.lit(True))
    for batch in (tables.profile_write.where(~late), tables.profile_write.where(late)):
        store.put(batch, VERSION)
    return store.read().drop("write_id").withColumnRenamed("written_at", "updated_at")


def trips_after_batches(tables: Tables, root: str, p: FleetParams, ids_per_bucket: int = 1_000_000) -> DataFrame:
    """The trip log after a batch of return readings and one of cancellations."""
    store = trip_store(tables.spark, root, ids_per_bucket)
    store.create(tables.trip)
    store.set_columns(returns_due(tables.trip, p), ["km_end"])
    store.delete(cancellations(tables.trip, p))
    return store.read()


# -- the log as JSON lines ---------------------------------------------------------

FORM_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def trip_form_lines(trips: DataFrame) -> DataFrame:
    """Trips with the field names and texts of the trip form."""
    text = lambda c: F.col(c).cast("string")
    return trips.select(
        "id",
        "car",
        "driver",
        "leader",
        "dest",
        F.date_format("start_at", FORM_TIME).alias("start"),
        F.date_format("end_at", FORM_TIME).alias("end"),
        text("km_start").alias("kmStart"),
        text("km_end").alias("kmEnd"),
    )


def cut_lines(trips: DataFrame) -> DataFrame:
    """What an interrupted writer leaves of an order: a line that ends early."""
    return trips.select(F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"car":"'), F.col("car")).alias("value"))


def trip_log_read_back(tables: Tables, p: FleetParams, root: str) -> DataFrame:
    """All trips written as JSON lines, among them cut-off lines of orders
    later cancelled, and read back typed; a line that is no JSON object comes
    back whole in ``bad_line`` and nothing else."""
    write_json(trip_form_lines(tables.trip), root)
    cancelled = tables.trip.join(cancellations(tables.trip, p), "id", "left_semi")
    cut_lines(cancelled).write.mode("append").text(root)
    return read_checked(tables.spark, root).drop("passengers", "bad_fields")


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """Typed trips, ``bad_fields`` (fields whose text cannot be read) and
    ``bad_line`` (a line that cannot). Every line gives a row."""
    schema = T.StructType([*schemas.TRIP_JSON.fields, T.StructField("bad_line", T.StringType())])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "bad_line").json(path)
    whole = F.col("bad_line").isNull()
    typed = raw.select(*typed_trip_columns(), bad_trip_fields().alias("bad_fields"), "bad_line")
    return typed.select(*[F.when(whole, F.col(c)).alias(c) for c in typed.columns[:-1]], "bad_line")
