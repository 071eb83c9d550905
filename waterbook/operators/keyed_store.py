"""A keyed table of Parquet files, changed by bucket of the key.

Every key belongs to one bucket, a folder of the table. A change reads and
rewrites only the buckets of the keys it names (dynamic partition overwrite);
the files of all others stay as they are. Deleted rows stay as marked rows, so
a bucket never loses its last row and a late, older write stays deleted.

A change is first written whole to ``pending``, then announced in ``ready``,
then moved into the buckets. Whatever ends a job half way, the next change or
``recover`` repeats the move, and repeating a change gives the same table. One
writer at a time; a key is one row, so no bucket is larger than its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waterbook.operators.upsert import latest_per_key, update_by_key

BUCKET, DELETED = "store_bucket", "store_deleted"


def hash_buckets(count: int) -> Callable[[Column], Column]:
    """Keys in no order (plates): ``count`` even buckets."""
    return lambda key: F.pmod(F.xxhash64(key), F.lit(count)).cast("long")


def range_buckets(width: int) -> Callable[[Column], Column]:
    """Numbers that grow with time (order ids): ``width`` of them a bucket,
    so changes of recent rows touch few buckets. A NULL key is in bucket -1."""
    return lambda key: F.coalesce(F.floor(key / F.lit(width)).cast("long"), F.lit(-1).cast("long"))


@dataclass(frozen=True)
class KeyedStore:
    """``schema`` is that of the rows; ``bucket`` gives a key's bucket number.
    Up to ``max_listed`` bucket numbers of a change are listed to prune the
    folders; a change that touches more joins on the bucket number."""

    spark: SparkSession
    root: str
    key: str
    schema: T.StructType
    bucket: Callable[[Column], Column]
    max_listed: int = 10_000

    def _path(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{part}"

    def _schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType()), T.StructField(BUCKET, T.LongType())])

    def _stored(self, part: str = "rows") -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(self._path(part))

    def _announce(self, pending: bool) -> None:
        rows = self.spark.range(1 if pending else 0).coalesce(1)
        rows.write.mode("overwrite").parquet(self._path("ready"))

    def create(self, rows: DataFrame) -> None:
        """Start the table with one row per key."""
        named = rows.select(*self.schema.names).withColumn(DELETED, F.lit(False))
        placed = named.withColumn(BUCKET, self.bucket(F.col(self.key)))
        placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self._path("rows"))
        self._announce(False)

    def read(self) -> DataFrame:
        return self._stored().where(~F.col(DELETED)).select(*self.schema.names)

    def put(self, rows: DataFrame, version: Sequence[str]) -> None:
        """Insert or replace whole rows. The greatest ``version`` of a key
        counts, stored or new; a stored NULL version is the smallest."""
        new = rows.select(*self.schema.names).withColumn(DELETED, F.lit(False))
        order = [*version, DELETED, *[c for c in self.schema.names if c not in (self.key, *version)]]
        self._rewrite(rows, lambda stored: latest_per_key(stored.unionByName(new), self.key, order))

    def set_columns(self, updates: DataFrame, columns: Sequence[str], version: Sequence[str] = ()) -> None:
        """Set ``columns`` of stored keys to the non-NULL values of ``updates``."""
        self._rewrite(updates, lambda stored: update_by_key(stored, updates, self.key, columns, version))

    def delete(self, keys: DataFrame) -> None:
        """Mark the stored rows of ``keys`` as deleted."""
        gone = keys.select(self.key, F.lit(True).alias("store_gone")).distinct()
        mark = (F.col(DELETED) | F.coalesce("store_gone", F.lit(False))).alias(DELETED)
        self._rewrite(keys, lambda stored: stored.join(gone, self.key, "left").select(*self.schema.names, mark))

    def _rewrite(self, changes: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        self.recover()
        touched = changes.select(self.bucket(F.col(self.key)).alias(BUCKET)).distinct()
        listed = [r[0] for r in touched.limit(self.max_listed + 1).collect()]
        if not listed:
            return
        stored = self._stored()
        if len(listed) <= self.max_listed:
            stored = stored.where(F.col(BUCKET).isin(listed))
        else:
            stored = stored.join(touched, BUCKET, "left_semi")
        rows = change(stored.drop(BUCKET)).select(*self.schema.names, DELETED)
        rows.withColumn(BUCKET, self.bucket(F.col(self.key))).write.mode("overwrite").parquet(self._path("pending"))
        self._announce(True)
        self.recover()

    def recover(self) -> None:
        """Finish an announced change; nothing to do if there is none."""
        if self.spark.read.schema("id long").parquet(self._path("ready")).isEmpty():
            return
        rows = self._stored("pending").repartition(BUCKET)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self._path("rows"))
        self._announce(False)
