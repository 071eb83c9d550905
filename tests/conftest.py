from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from decimal import Decimal  # noqa: E402

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from waterbook import schemas  # noqa: E402
from waterbook.session import ensure_checkpoint_dir  # noqa: E402
from waterbook.sources.tables import DOMAIN_TABLES, Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("waterbook-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def typed(value, kind):
    """Whole numbers stand for decimals and for text plates in literal rows."""
    if value is not None and isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    return str(value) if isinstance(value, int) and isinstance(kind, T.StringType) else value


def make_tables(spark, **frames) -> Tables:
    """Tables from literal rows: ``name=[tuple, ...]`` in the domain schema
    column order (missing last columns are NULL); tables not given are empty."""
    loaders = {}
    for name in DOMAIN_TABLES:
        fields = schemas.DOMAIN[name].fields
        rows = [tuple(row) + (None,) * (len(fields) - len(row)) for row in frames.get(name, [])]
        rows = [tuple(typed(v, f.dataType) for v, f in zip(row, fields, strict=True)) for row in rows]
        df = spark.createDataFrame(rows, schemas.DOMAIN[name])
        loaders[name] = lambda df=df: df
    return Tables(spark, loaders)


def rows_of(df, *cols, order=None):
    sel = df.select(*cols) if cols else df
    out = [tuple(r) for r in sel.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r)) if order is None else out
