"""Code normalisation and decoding (regions, purposes, classes)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waterbook.sources import literals as L


def norm(col: Column | str) -> Column:
    """``UPPER(LTRIM(RTRIM(x)))``: blanks trimmed on both ends, upper case."""
    return F.upper(F.trim(F.col(col) if isinstance(col, str) else col))


def concat_nullsafe(*parts: Column | str) -> Column:
    """T-SQL ``CONCAT``: a null part counts as empty text (never null)."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("", *cols)


def _chain(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    first_cond, first_val = pairs[0]
    expr = reduce(lambda acc, cv: acc.when(cv[0], cv[1]), pairs[1:], F.when(first_cond, first_val))
    return expr.otherwise(otherwise)


def region_name(code_norm: Column) -> Column:
    """Mixed-case region name; unknown or null codes fall in "other"."""
    return _chain(
        [(code_norm.isin(*codes), F.lit(name)) for codes, name, _, _ in L.REGIONS],
        F.lit(L.REGION_OTHER_NAME),
    )


def region_ordinal(code_norm: Column) -> Column:
    return _chain(
        [(code_norm.isin(*codes), F.lit(ordinal)) for codes, _, _, ordinal in L.REGIONS],
        F.lit(L.REGION_OTHER_ORDINAL),
    )


def region_upper_name(code_norm: Column) -> Column:
    """Upper-case region name; an unknown code is shown as "other (code)"."""
    other = concat_nullsafe(L.REGION_OTHER_UPPER_PREFIX, code_norm, L.REGION_OTHER_UPPER_SUFFIX)
    return _chain([(code_norm.isin(*codes), F.lit(up)) for codes, _, up, _ in L.REGIONS], other)


def purpose_name(code_norm: Column) -> Column:
    return _chain([(code_norm == c, F.lit(n)) for c, n, _ in L.PURPOSES], F.lit(L.PURPOSE_OTHER_NAME))


def purpose_ordinal(code_norm: Column) -> Column:
    return _chain([(code_norm == c, F.lit(o)) for c, _, o in L.PURPOSES], F.lit(L.PURPOSE_OTHER_ORDINAL))


def purpose_codes() -> list[str]:
    return [c for c, _, _ in L.PURPOSES]


def class_name(code: Column) -> Column:
    """Class decode, blanks trimmed and case folded, with the catch-all name."""
    mapping = F.create_map(*[F.lit(x) for c, n in L.CLASSES for x in (c.upper(), n)])
    return F.coalesce(F.try_element_at(mapping, norm(code)), F.lit(L.CLASS_OTHER_NAME))
