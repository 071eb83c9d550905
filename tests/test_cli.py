"""Command-line entry: every report builds and orders on the generated tables."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL
from waterbook.__main__ import REPORTS, build, parse
from waterbook.sources.tables import Tables

ARGS = [
    "--month", "5", "--base", "1997", "--cmp", "1998", "--year", "1998", "--cutoff", "1998-06-18",
    "--regions", "VT,BRIA", "--region", "BRIA", "--as-of", "2024-01-15T12:00:00",
]


@pytest.mark.parametrize("report", sorted(REPORTS))
@pytest.mark.parametrize("text", [False, True])
def test_report_builds(spark, report, text):
    a = parse([report, "--tables", f"generated:{SF_SMALL}", *ARGS, *(["--text"] if text else [])])
    df = build(Tables.from_generated(spark, SF_SMALL), a)
    assert df.limit(5).collect() is not None


def test_arrears_text_headings(spark):
    a = parse(["arrears", "--tables", f"generated:{SF_SMALL}", *ARGS, "--text"])
    cols = build(Tables.from_generated(spark, SF_SMALL), a).columns
    assert "18/06_Tồn CK" in cols and "18/05_Tồn TM+CK" in cols
