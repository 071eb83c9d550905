"""Text formatting of report numbers (presentation only).

Formats follow the reports: Vietnamese number text groups thousands with
``.`` and uses ``,`` as the decimal mark. Rounding is half away from zero
and is done on exact integers or decimals before any text is built, so the
text never depends on binary floating point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waterbook.sources import literals as L


def _long(x: Column) -> Column:
    return F.round(x, 0).cast("long")


def grouped(x: Column, sep: str = ".") -> Column:
    """``#,##0`` text of a number rounded half away from zero (``1.234.567``)."""
    text = F.format_number(_long(x), 0)
    return F.translate(text, ",", sep) if sep != "," else text


def signed_grouped(x: Column) -> Column:
    """As ``grouped`` with a ``+`` in front of a positive value."""
    return F.when(x > 0, F.concat(F.lit("+"), grouped(x))).otherwise(grouped(x))


def _hundredths_parts(h: Column) -> tuple[Column, Column, Column]:
    """Sign text, whole part and two-digit fraction of a hundredths count."""
    a = F.abs(h)
    return F.when(h < 0, F.lit("-")).otherwise(F.lit("")), F.floor(a / F.lit(100)), F.pmod(a, F.lit(100))


def pct_fixed2(h: Column) -> Column:
    """``0.00`` in vi-VN (no grouping) from hundredths: ``-12,50``."""
    sign, whole, frac = _hundredths_parts(h)
    return F.concat(sign, whole.cast("long").cast("string"), F.lit(","), F.lpad(frac.cast("string"), 2, "0"))


def pct_trimmed(h: Column) -> Column:
    """``#,##0.##`` in vi-VN from hundredths: grouping, trailing zeros dropped
    (``1.234,5``, ``12``)."""
    sign, whole, frac = _hundredths_parts(h)
    frac_text = (
        F.when(frac == 0, F.lit(""))
        .when(F.pmod(frac, F.lit(10)) == 0, F.concat(F.lit(","), (frac / 10).cast("long").cast("string")))
        .otherwise(F.concat(F.lit(","), F.lpad(frac.cast("string"), 2, "0")))
    )
    return F.concat(sign, F.translate(F.format_number(whole.cast("long"), 0), ",", "."), frac_text)


def comma_grouped(x: Column) -> Column:
    """``{:,.0f}``: comma groups, rounded half away from zero."""
    return F.format_number(_long(x), 0)


def signed_comma_grouped(x: Column) -> Column:
    """``{:+,.0f}``: always signed, ``+0`` for zero."""
    return F.when(_long(x) >= 0, F.concat(F.lit("+"), comma_grouped(x))).otherwise(comma_grouped(x))


def fixed2_dot(h: Column) -> Column:
    """Two decimals with a ``.`` mark from hundredths: ``-12.50``."""
    sign, whole, frac = _hundredths_parts(h)
    return F.concat(sign, whole.cast("long").cast("string"), F.lit("."), F.lpad(frac.cast("string"), 2, "0"))


def growth_text_signed(h: Column, positive: Column, zero: Column) -> Column:
    """Growth cell of the sectioned report: ``+x,xx %`` when growth is
    positive, the literal ``0,00 %`` when it is zero, else ``x,xx %``;
    empty when there is no growth value."""
    return (
        F.when(h.isNull(), F.lit(""))
        .when(positive, F.concat(F.lit("+"), pct_fixed2(h), F.lit(" %")))
        .when(zero, F.lit(L.ZERO_GROWTH_TEXT))
        .otherwise(F.concat(pct_fixed2(h), F.lit(" %")))
    )


def blank_zero_grouped(x: Column) -> Column:
    """``##,#`` (en-US) with commas turned into dots: zero prints empty."""
    return F.when(_long(x) == 0, F.lit("")).otherwise(grouped(x))


def money_text(x: Column) -> Column:
    """``CONVERT(VARCHAR, CAST(x AS MONEY), 1)`` minus ``.00``: comma groups,
    two decimals kept only when not zero."""
    return F.replace(F.format_number(F.round(x.cast("decimal(38,4)"), 2), 2), F.lit(".00"), F.lit(""))


def right_align(text: Column, width: int) -> Column:
    """``RIGHT(SPACE(n) + s, n)``: pads on the left, keeps the right end
    when too long, and stays NULL when the text is NULL."""
    return F.right(F.concat(F.lit(" " * width), text), F.lit(width))


def dd_mm_yyyy(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")

