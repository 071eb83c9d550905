"""Long components cut where the lowest id decides, against a plain replay."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from waterbook import catalog as C
from waterbook.operators.pieces import split_long
from waterbook.operators.replay import COMPONENT_KEY
from waterbook.plans import fleet

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, car string, start_at timestamp_ntz, end_at timestamp_ntz"
KEYED = SCHEMA + ", component_lo timestamp_ntz, component_id long"


def _orders(spark, rows):
    at = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    return spark.createDataFrame([(i, c, at(s), at(e)) for i, c, s, e in rows], SCHEMA)


def _kept(rows):
    kept, out = {}, set()
    for i, c, s, e in sorted(rows):
        log = kept.setdefault(c, [])
        if s is None or e is None or c is None or not any(s < ke and e > ks for ks, ke in log):
            out.add(i)
            if s is not None and e is not None:
                log.append((s, e))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_cut_components_keep_the_same_orders(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        s = rng.randint(0, 400)
        # lengths from reversed and zero to long ones that span many others
        rows.append((i, rng.choice(["a", "a", "b"]), s, s + rng.choice([-7, 0, 1, 5, 12, 60])))
    rows += [(900, "a", None, 5), (901, None, 5, 9), (902, "a", 5, None)]
    got = {r.id for r in fleet.trips_after_refusal(_orders(spark, rows), C.FLEET, max_piece=3).collect()}
    assert got == _kept(rows)


def test_orders_entered_in_time_order_stop_cutting(spark):
    rows = [(i, "a", i, i + 2) for i in range(300)]
    got = {r.id for r in fleet.trips_after_refusal(_orders(spark, rows), C.FLEET, max_piece=5).collect()}
    assert got == set(range(0, 300, 2))


def test_no_orders(spark):
    assert fleet.trips_after_refusal(_orders(spark, []), C.FLEET).count() == 0


def test_a_chain_of_200_000_orders_runs_in_several_tasks(spark):
    n = 200_000
    ids = np.random.default_rng(5).permutation(n)
    start = pd.Series(np.datetime64("2024-01-01T00:00") + np.arange(n).astype("timedelta64[m]"))
    orders = spark.createDataFrame(
        pd.DataFrame({"id": ids, "car": "a", "start_at": start, "end_at": start + pd.Timedelta(minutes=2)}), SCHEMA
    )
    keyed = orders.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS component_lo", "0L AS component_id")
    left, refused = split_long(keyed)
    sizes = [r["count"] for r in left.groupBy(*COMPONENT_KEY).count().collect()]
    assert max(sizes) <= 20_000 and len(sizes) >= 10
    assert sum(sizes) + refused.count() < n
    # replay of a chain: only neighbours overlap
    kept = np.zeros(n + 2, dtype=bool)
    for place in np.argsort(ids):
        kept[place + 1] = not (kept[place] or kept[place + 2])
    want = set(ids[kept[1:-1]].tolist())
    got = {r.id for r in fleet.trips_after_refusal(orders, C.FLEET).select("id").collect()}
    assert got == want
