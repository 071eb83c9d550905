"""Pipe-flushing results: golden value from the form defaults, validity."""

from __future__ import annotations

import pytest

from waterbook import schemas
from waterbook.plans.flushing import flush_volume, resolve_codes

DEFAULT_JOB = (1, 500.0, 100.0, 0.010, 2.5, 15.5, 12.0, "CALC", 4, 2, 0.15, 9 * 60, 9 * 60 + 25)


def jobs_of(spark, *rows):
    """Jobs without codes."""
    return spark.createDataFrame([(*row, None, None) for row in rows], schemas.FLUSH_JOB)


def test_missing_or_impossible_inputs_are_named(spark):
    def job(**changed):
        names = [f.name for f in schemas.FLUSH_JOB.fields[: len(DEFAULT_JOB)]]
        return tuple(changed.get(n, v) for n, v in zip(names, DEFAULT_JOB, strict=True))

    rows = [
        job(id=1, pig_loss_bar=None),
        job(id=2, roughness=None),
        job(id=3, diameter_mm=-100.0),
        job(id=4, length_m=-1.0),
        job(id=5, length_m=0.0),
        job(id=6, z_start=None, bends_90=None),
    ]
    got = {r.id: r for r in flush_volume(jobs_of(spark, *rows)).collect()}
    want = {1: "missing_input", 2: "missing_input", 3: "bad_diameter", 4: "bad_length", 5: "bad_length", 6: None}
    assert {i: r.invalid_reason for i, r in got.items()} == want
    for i, reason in want.items():
        assert (got[i].velocity is None) == (got[i].volume_m3 is None) == (reason is not None)


def test_unknown_code_is_a_missing_input(spark):
    row = (*DEFAULT_JOB[:3], None, *DEFAULT_JOB[4:10], None, *DEFAULT_JOB[11:])
    jobs = spark.createDataFrame([(*row, " steel_new ", "foam")], schemas.FLUSH_JOB)
    r = flush_volume(resolve_codes(jobs)).collect()[0]
    assert (r.invalid_reason, r.velocity) == ("missing_input", None)


def test_golden_form_defaults(spark):
    jobs = jobs_of(spark, DEFAULT_JOB)
    r = flush_volume(jobs, quantize_places=None).collect()[0]
    assert r.invalid_reason is None
    assert r.dz == pytest.approx(3.5)
    assert r.net_head == pytest.approx(27.0)
    assert r.friction_factor == pytest.approx(6.839903786706786, rel=1e-12)
    assert r.local_factor == pytest.approx(0.22426095820591235, rel=1e-12)
    assert r.velocity == pytest.approx(1.9550212063, abs=1e-9)
    assert r.flow_lps == pytest.approx(15.3547006486, abs=1e-9)
    assert r.local_loss_m == pytest.approx(0.8571495839, abs=1e-9)
    assert r.duration_s == 1500
    assert r.volume_m3 == pytest.approx(23.0320509728, abs=1e-9)


def test_invalid_rows_and_cap(spark):
    rows = [
        (2, 500.0, 100.0, 0.010, 2.5, 15.5, 12.0, "CALC", 4, 2, 0.15, 600, 600),  # equal times
        (3, 500.0, 100.0, 0.010, 0.1, 0.0, 20.0, "CALC", 0, 0, 0.25, 60, 120),  # head <= 0
        (4, None, 100.0, 0.010, 2.5, 0.0, 0.0, "CALC", 0, 0, 0.15, 60, 120),  # missing length
        (5, 1.0, 500.0, 0.010, 3.9, 0.0, 0.0, "FLAT", 0, 0, 0.15, 1430, 10),  # cap, past midnight
    ]
    got = {r.id: r for r in flush_volume(jobs_of(spark, *rows)).collect()}
    assert got[2].invalid_reason == "bad_duration" and got[2].velocity is None
    assert got[3].invalid_reason == "low_head" and got[3].volume_m3 is None
    assert got[4].invalid_reason == "missing_input"
    assert got[5].invalid_reason is None and got[5].velocity == 15.0 and got[5].duration_s == 1200


def test_codes_resolve_to_numbers(spark):
    from waterbook.plans.flushing import resolve_codes

    df = spark.createDataFrame(
        [(1, "iron_old", "DENSE", None, None), (2, "HDPE_PVC", "SOFT", 0.02, None), (3, "X", None, None, 0.3)],
        "id long, material string, pig_type string, roughness double, pig_loss_bar double",
    )
    got = {r.id: (r.roughness, r.pig_loss_bar) for r in resolve_codes(df).collect()}
    assert got == {1: (0.015, 0.25), 2: (0.02, 0.15), 3: (None, 0.3)}


def test_result_panel_text(spark):
    from waterbook.plans.present import format_flush

    jobs = jobs_of(spark, DEFAULT_JOB)
    r = format_flush(flush_volume(jobs)).collect()[0]
    assert (r.dz_text, r.net_head_text, r.velocity_text) == ("3.50 m", "27.00 mH₂O", "1.96 m/s")
    assert (r.flow_text, r.duration_text, r.volume_text, r.local_loss_text) == (
        "15.35 lít/giây",
        "25.0 phút",
        "23.03 m³",
        "0.86 m",
    )
