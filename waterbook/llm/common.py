"""Column helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..session import ensure_checkpoint_dir

#: The white space that separates words: blank and the control characters 9-13.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def pack(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns of ``df`` as one struct column, so that whatever the input
    calls its columns, none meets a name an operator makes."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def sealed(df: DataFrame) -> DataFrame:
    """``df`` as it is, but no filter or projection on top is moved into what
    makes its columns, where each mention of a column would be put back as its
    whole expression, inside lambdas too."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str, at_once: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    and survives lost executors. ``at_once``: rows per row group at most, for
    large rows; the reader else decodes up to 4096 of them together."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("parquet.block.row.count.limit", at_once) if at_once else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantile(df: DataFrame, column: str, quantile: float) -> float | None:
    """The interpolated quantile of all values that are not null, as
    ``percentile`` gives it, but from a distributed order; None without any."""
    # stored before the filter, which would else be moved into what makes the values
    values = stored(df.select(F.col(column).cast("double").alias("v")), "values").filter("v is not null")
    size = values.count()
    if not size:
        return None
    at = quantile * (size - 1)
    low = int(at)
    got = sorted(r.v for r in numbered(values, F.col("v").asc()).filter(F.col("row_no").between(low + 1, low + 2)).collect())
    return got[0] + (at - low) * (got[-1] - got[0]) if at > low else got[0]


def public_vocabulary(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
