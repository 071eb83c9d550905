"""Trip orders as a stream, kept in an append-only log.

Under either policy the current trips are a function of all orders by id:
with ``replace`` an order stays exactly when no later order of its car
overlaps it, with ``refuse`` when it overlaps no kept earlier one. So the
stream only appends the orders of a micro-batch, touching no stored row, and
``read_log`` applies the policy. A micro-batch that is written twice (a retry,
or a restart with a new checkpoint that reads the files again) repeats orders
whose ids are known; reading keeps one row per id, so nothing is lost or
counted twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from waterbook import schemas
from waterbook.operators.upsert import latest_per_key
from waterbook.params import FleetParams
from waterbook.plans.fleet import trips_after_refusal, trips_after_replacement
from waterbook.session import ensure_checkpoint_dir
from waterbook.sources.tables import typed_trips

POLICIES = {"replace": trips_after_replacement, "refuse": trips_after_refusal}


def order_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New trip orders arriving as JSON-lines files in ``source_dir``."""
    reader = spark.readStream.schema(schemas.TRIP_JSON)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return typed_trips(reader.json(source_dir))


def read_orders(spark: SparkSession, table_root: str) -> DataFrame:
    """All orders ever entered, one row per id."""
    rows = spark.read.schema(schemas.TRIP_LOG).parquet(table_root)
    columns = [f.name for f in schemas.TRIP_LOG.fields]
    return latest_per_key(rows, "id", [c for c in columns if c != "id"]).select(*columns)


def read_log(spark: SparkSession, table_root: str, params: FleetParams, policy: str = "replace") -> DataFrame:
    """The trips that stand under ``policy``."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {sorted(POLICIES)}")
    return POLICIES[policy](read_orders(spark, table_root), params)


def start(
    spark: SparkSession,
    source_dir: str,
    table_root: str,
    checkpoint_location: str | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the ingestion query. The checkpoint goes under the session's
    shared ``spark.checkpoint.dir`` unless a location is given."""
    location = checkpoint_location or os.path.join(ensure_checkpoint_dir(spark), "trip-log-stream")

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(table_root)

    writer = order_stream(spark, source_dir).writeStream.foreachBatch(append).option("checkpointLocation", location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
