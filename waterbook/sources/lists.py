"""List parameters: delimited text -> distinct, trimmed, non-empty tokens.

Users paste lists separated by commas or line breaks. Line breaks (CR, LF)
count as commas, blanks around a token are dropped, empty tokens are
skipped and duplicates collapse.

The same rule exists twice: ``parse_text`` for a parameter string on the
driver (bounded by the parameter, becomes an ``isin`` set), and
``tokens_column`` / ``tokens`` for text held in a DataFrame column, which
runs distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_text(text: str | None) -> list[str]:
    if text is None:
        return []
    flat = text.replace("\r", ",").replace("\n", ",")
    seen: dict[str, None] = {}
    for part in flat.split(","):
        token = part.strip(" ")
        if token:
            seen.setdefault(token, None)
    return list(seen)


def tokens_column(text: Column) -> Column:
    """Array of distinct tokens of a text column (empty array for NULL)."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\r\n", ",,")
    parts = F.transform(F.split(flat, ",", -1), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda t: t != F.lit("")))


def tokens(df: DataFrame, text_col: str, out: str = "token") -> DataFrame:
    """Distinct tokens over all rows of ``df[text_col]``."""
    return df.select(F.explode(tokens_column(F.col(text_col))).alias(out)).distinct()


def to_values(param: str | Sequence[str]) -> list[str]:
    if isinstance(param, str):
        return parse_text(param)
    return parse_text(",".join(str(p) for p in param))


def to_frame(spark: SparkSession, param, out: str = "token") -> DataFrame:
    """Any list parameter as a one-column DataFrame of tokens."""
    if isinstance(param, DataFrame):
        first = param.columns[0]
        clean = param.select(F.trim(F.col(first).cast("string")).alias(out))
        return clean.where(F.col(out).isNotNull() & (F.col(out) != "")).distinct()
    return spark.createDataFrame([(t,) for t in to_values(param)], f"{out} string")
