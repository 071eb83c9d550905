"""Difference and growth percentage with an explicit zero-base policy.

Spark in ANSI mode raises on division by zero for every numeric type, so
the divisor is always guarded. Policies seen in the reports:

* ``"zero"``: growth 0 when the base is 0;
* ``"null"``: growth NULL when the base is 0 (``NULLIF`` divisor);
* ``"inf"``: +/-infinity when the base is 0 and the change is not, 0 when
  both are 0 (a NaN filled with 0).

``order="sql"`` computes ``100.0 * diff / base``; ``order="ratio"``
computes ``diff / base * 100``. Both are doubles, kept unrounded; rounding
is presentation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("zero", "null", "inf")


def growth_pct(base: Column, cmp_: Column, on_zero: str = "zero", order: str = "sql") -> Column:
    if on_zero not in POLICIES:
        raise ValueError(f"on_zero must be one of {POLICIES}")
    b = base.cast("double")
    d = (cmp_ - base).cast("double")
    ratio = (d * F.lit(100.0)) / b if order == "sql" else (d / b) * F.lit(100.0)
    if on_zero == "zero":
        at_zero = F.lit(0.0)
    elif on_zero == "null":
        at_zero = F.lit(None).cast("double")
    else:
        at_zero = (
            F.when(d > 0, F.lit(float("inf"))).when(d < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
        )
    return F.when(b == 0, at_zero).otherwise(ratio)


def _whole_quotient(num: Column, den: Column) -> Column:
    """Integer quotient of whole decimals: the remainder is taken off first,
    so the division is exact."""
    safe = F.when(den != 0, den)
    return ((num - num % safe) / safe).cast("long")


def growth_hundredths(base: Column, diff: Column) -> Column:
    """``100 * diff / base`` rounded half away from zero to 2 decimals, as an
    exact integer count of hundredths (NULL on a zero or null base).

    Both numbers are taken as whole hundredths in decimals of 38 digits, and
    divided without a remainder, so nothing passes through a double: the
    printed percentage is exact at any size of the volumes.
    """
    whole = lambda c: F.abs((c.cast("decimal(28,2)") * 100).cast("decimal(28,0)"))
    abs_b, abs_d = whole(base), whole(diff)
    num = (abs_d * F.lit(20000).cast("decimal(5,0)") + abs_b).cast("decimal(38,0)")
    den = (abs_b * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")
    q = _whole_quotient(num, den)
    sign = F.signum(diff.cast("double")) * F.signum(base.cast("double"))
    return F.when(abs_b == 0, F.lit(None).cast("long")).otherwise(q * sign.cast("long"))
