"""The ``Tables`` holder and the loaders behind it.

Reports take a ``Tables`` object, so where the data comes from (the test
adapter over generated tables, a Parquet lake, a JDBC database, JSON trip
logs) is decided once, by the caller.

Production layout: ``consumption`` is written partitioned by
``(year, month)``, so the period predicates of every report prune
directories before any file is opened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterbook import schemas
from waterbook.sources import database, fixtures

DOMAIN_TABLES = (
    "customer",
    "street",
    "consumption",
    "large_reading",
    "trip",
    "fleet",
    "vehicle_profile",
    "profile_write",
    "flush_job",
)


@dataclass
class Tables:
    """Lazily loaded domain tables. Loading only builds a plan; nothing is
    read until an action runs, and unused tables are never touched."""

    spark: SparkSession
    loaders: dict[str, Callable[[], DataFrame]]
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def get(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.loaders[name]()
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in DOMAIN_TABLES:
            return self.get(name)
        raise AttributeError(name)

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        loaders = dict(self.loaders)
        loaders[name] = lambda: df
        return Tables(self.spark, loaders)

    # -- constructors -----------------------------------------------------

    @classmethod
    def from_generated(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        """Domain tables derived from the generated base tables (tests)."""
        loaders = {name: (lambda b=b: b(spark, sf_dir)) for name, b in fixtures.BUILDERS.items()}
        return cls(spark, loaders)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        """One Parquet dataset per domain table under ``root``."""
        root = root.rstrip("/")
        loaders = {
            name: (lambda n=name: spark.read.schema(schemas.DOMAIN[n]).parquet(f"{root}/{n}"))
            for name in DOMAIN_TABLES
        }
        return cls(spark, loaders)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "Tables":
        """Domain tables registered in a catalog database (e.g. written by
        ``write_bucketed``); bucketing metadata then reaches the planner."""
        return cls(spark, {name: (lambda n=name: spark.table(f"{database}.{n}")) for name in DOMAIN_TABLES})

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        table_names: dict[str, str],
        properties: dict[str, str] | None = None,
        partitioning: dict[str, dict[str, str]] | None = None,
        ranges: dict[str, tuple[str, int]] | None = None,
        periods: dict[str, list[tuple[int, int]]] | None = None,
    ) -> "Tables":
        """Tables read from a relational database over JDBC.

        ``table_names`` maps a domain name to a table or ``(subquery) alias``.
        ``partitioning`` gives, per domain table, ``partitionColumn``,
        ``lowerBound``, ``upperBound`` and ``numPartitions`` so large tables
        are read by many tasks in parallel instead of one connection.
        ``ranges`` gives ``(key column, tasks)`` instead, for keys that are not
        evenly spread: the database is asked for the bounds of equal counts
        (``sources.database``). ``periods`` gives the ``(year, month)`` pairs
        to read of a table; other rows stay in the database.
        Connection options (user, password, driver) come from the caller.
        """
        properties = dict(properties or {})
        partitioning, ranges, periods = partitioning or {}, ranges or {}, periods or {}

        def load(name: str) -> DataFrame:
            source = table_names[name]
            if name in periods:
                source = database.of_periods(source, periods[name])
            if name in ranges:
                return database.read_in_ranges(spark, url, source, *ranges[name], properties)
            reader = spark.read.format("jdbc").option("url", url).option("dbtable", source)
            for key, value in {**properties, **partitioning.get(name, {})}.items():
                reader = reader.option(key, value)
            return reader.load()

        return cls(spark, {name: (lambda n=name: load(n)) for name in table_names})


ODOMETER = "decimal(18,2)"


# -- trip log and vehicle profiles as JSON ---------------------------------


def read_trip_json(spark: SparkSession, path: str) -> DataFrame:
    """Trip entries as JSON lines with the field names of the trip form.

    Form values arrive as text: times as ``yyyy-MM-ddTHH:mm`` with or without
    seconds, read as wall clock in any session time zone, and odometer
    readings as decimal digits. What cannot be read becomes NULL instead of
    failing the job; ``rejected_trips`` returns such entries.
    """
    return typed_trips(spark.read.schema(schemas.TRIP_JSON).json(path))


def typed_trips(raw: DataFrame) -> DataFrame:
    """Trip-form text fields to typed trip columns (batch or streaming)."""
    return raw.select(*typed_trip_columns())


def typed_trip_columns() -> list[Column]:
    return [
        F.col("id").cast("long").alias("id"),
        F.col("car"),
        F.col("driver"),
        F.col("leader"),
        F.col("dest"),
        F.col("pass").alias("passengers"),
        F.col("start").try_cast("timestamp_ntz").alias("start_at"),
        F.col("end").try_cast("timestamp_ntz").alias("end_at"),
        F.col("kmStart").try_cast(ODOMETER).alias("km_start"),
        F.col("kmEnd").try_cast(ODOMETER).alias("km_end"),
    ]


def bad_trip_fields() -> Column:
    """Names of the fields with a time or odometer text that cannot be read."""
    kinds = {"start": "timestamp_ntz", "end": "timestamp_ntz", "kmStart": ODOMETER, "kmEnd": ODOMETER}
    given = lambda f: F.trim(F.coalesce(F.col(f), F.lit(""))) != ""
    bad = [F.when(given(f) & F.col(f).try_cast(k).isNull(), F.lit(f)) for f, k in kinds.items()]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def rejected_trips(raw: DataFrame) -> DataFrame:
    """Raw entries with a field that cannot be read, and the names of those fields."""
    return raw.withColumn("bad_fields", bad_trip_fields()).where(F.size("bad_fields") > 0)


def read_profile_json(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Vehicle profiles keyed by plate.

    ``layout="lines"``: one JSON object per line with a ``car`` field (the
    scalable layout). ``layout="map"``: each file is one JSON object mapping
    plate -> profile, the shape a browser stores; it is parsed with
    ``from_json`` into a map and exploded to one row per plate.
    """
    if layout == "lines":
        raw = spark.read.schema(schemas.PROFILE_JSON_LINE).json(path)
    elif layout == "map":
        text = spark.read.text(path, wholetext=True)
        parsed = text.select(F.explode(F.from_json("value", schemas.PROFILE_JSON_MAP)).alias("car", "p"))
        raw = parsed.select("car", "p.*")
    else:
        raise ValueError("layout must be 'lines' or 'map'")
    return raw.select(
        F.col("car"),
        F.col("name"),
        F.col("brand"),
        F.expr("try_cast(seats AS INT)").alias("seats"),
        F.expr("try_cast(y1 AS INT)").alias("year_made"),
        F.expr("try_cast(y2 AS INT)").alias("year_in_service"),
        F.col("place"),
        F.col("type").alias("maintenance_type"),
        F.expr("try_to_date(nextM)").alias("next_maintenance"),
        F.col("nextR").alias("next_inspection"),
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink (the trip log and profile store)."""
    df.write.mode(mode).json(path)


def write_consumption(
    df: DataFrame, path: str, mode: str = "overwrite", parts: int = 32, max_records: int = 5_000_000
) -> None:
    """Billing fact partitioned by billing period for directory pruning.

    A period is dealt to up to ``parts`` tasks by a hash of the bill, so a
    large month is not written by one task; adaptive execution joins small
    parts, and no file holds more than ``max_records`` rows."""
    part = F.pmod(F.xxhash64("bill_id"), F.lit(parts))
    dealt = df.repartition(F.col("year"), F.col("month"), part)
    dealt.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy("year", "month").parquet(path)


# Bucketed layout: the tables joined or grouped on a customer key are
# bucketed on it with the same bucket count, so the per-customer aggregate
# and the customer join read co-located buckets and need no shuffle of the
# billing fact. The fact stays partitioned by billing period for pruning.
BUCKET_KEYS = {
    "consumption": "customer_id",
    "customer": "customer_id",
    "large_reading": "customer_code",
    "trip": "car",
}


def write_bucketed(tables: Tables, database: str, location: str, buckets: int) -> None:
    """Write every domain table into ``database`` (created at ``location``),
    bucketed and sorted on its key where it has one. Sized so one bucket of
    one period partition is a few hundred MB at the target scale."""
    spark = tables.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name in DOMAIN_TABLES:
        df = tables.get(name)
        key = BUCKET_KEYS.get(name)
        if key:  # a bucket (of a period) is written by one task: one file each
            periods = ["year", "month"] if name == "consumption" else []
            df = df.repartition(*periods, F.pmod(F.hash(key), F.lit(buckets)))
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{location.rstrip('/')}/{name}")
        if name == "consumption":
            writer = writer.partitionBy("year", "month")
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")
