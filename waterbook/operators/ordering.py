"""Row numbers of a whole ordering, without a task that sees all rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterbook.session import ensure_checkpoint_dir


def numbered(df: DataFrame, *order: Column, into: str = "row_no") -> DataFrame:
    """``df`` with ``into``: 1 for the first row by ``order``, 2 for the next.

    The rows are dealt to range partitions of the order and sorted inside
    them; with their partition and their place in it they are written to the
    shared folder, so ``df`` runs once. Only the rows per partition are added
    up: a number is the partition's first plus the place. The window over
    these counts has one row per partition. ``order`` has to be total (end it
    with a key); rows equal in all of it get different numbers in any order."""
    place = F.monotonically_increasing_id()  # partition << 33 | place
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__place"))
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"numbered-{uuid.uuid4().hex}")
    dealt.write.parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    out = rows.join(F.broadcast(firsts), "__part")  # a row per partition
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__first") + F.col("__place") + 1).alias(into))
