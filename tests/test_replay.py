"""The refuse-policy replay against a naive sequential replay (no Spark)."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from waterbook.operators.replay import accept_in_order, later_overlaps, replay_partition, sweep_partition

BASE = np.datetime64("2024-01-01T00:00")


def _naive(rows):
    kept, out = [], {}
    for i, s, e in sorted(rows):
        ok = not any(s < ke and e > ks for ks, ke in kept)
        if ok:
            kept.append((s, e))
        out[i] = ok
    return out


def _frame(rows, component=0):
    return pd.DataFrame(
        {
            "id": [r[0] for r in rows],
            "car": 1,
            "component_lo": BASE,
            "component_id": component,
            "start_at": [BASE + np.timedelta64(r[1], "m") for r in rows],
            "end_at": [BASE + np.timedelta64(r[2], "m") for r in rows],
        }
    )


def test_binary_search_replay_equals_naive_and_streams():
    rng = random.Random(7)
    for _ in range(500):
        reversed_ok = rng.random() < 0.2
        rows = []
        for i in range(rng.randint(1, 40)):
            s = rng.randint(0, 60)
            rows.append((i, s, s + rng.randint(-10 if reversed_ok else 0, 25)))
        pdf = _frame(rows)
        out = accept_in_order(pdf)
        got = {int(i): bool(a) for i, a in zip(out["id"], out["accepted"])}
        assert got == _naive(rows)
        batches = [pdf.iloc[k : k + 7] for k in range(0, len(pdf), 7)]
        streamed = pd.concat(list(replay_partition(iter(batches))))
        assert {int(i): bool(a) for i, a in zip(streamed["id"], streamed["accepted"])} == got


def test_long_chain_is_fast():
    # 20 000 orders of one chain: every order overlaps the previous one
    rows = [(i, i, i + 2) for i in range(20_000)]
    out = accept_in_order(_frame(rows))
    assert int(out["accepted"].sum()) == 10_000


def _naive_replaced(rows):
    return {
        i: any(j > i and sj < e and ej > s for j, sj, ej in rows)
        for i, s, e in rows
    }


def test_sweep_equals_naive_later_overlap_and_streams():
    rng = random.Random(11)
    for _ in range(500):
        rows = []
        for i in range(rng.randint(1, 40)):
            s = rng.randint(0, 60)
            rows.append((i, s, s + rng.randint(-10, 25)))
        pdf = _frame(rows)
        out = later_overlaps(pdf)
        got = {int(i): bool(r) for i, r in zip(out["id"], out["replaced"])}
        assert got == _naive_replaced(rows)
        batches = [pdf.iloc[k : k + 5] for k in range(0, len(pdf), 5)]
        streamed = pd.concat(list(sweep_partition(iter(batches))))
        assert {int(i): bool(r) for i, r in zip(streamed["id"], streamed["replaced"])} == got


def test_sweep_handles_all_overlapping_in_n_log_n():
    # 20 000 orders that all overlap each other: 2*10^8 pairs, one sweep
    rows = [(i, i % 97, 10_000 + i % 89) for i in range(20_000)]
    out = later_overlaps(_frame(rows))
    assert int(out["replaced"].sum()) == 19_999
