"""Per-component replays of the trip rules, run inside ``mapInPandas``.

This module is pickled by value: executors receive the function's code with
the task, so they need no copy of this package on their Python path (only
pandas and numpy). Keep it self-contained.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

COMPONENT_KEY = ["car", "component_lo", "component_id"]


def accept_in_order(pdf):
    """Refuse policy for whole overlap components. A component of one order
    is kept outright (vectorised). Inside larger components the orders are
    walked by id and one is kept only if it overlaps no order kept so far.

    Kept orders never overlap each other, so sorted by (start, end) their
    ends do not decrease either: an order [s, e) conflicts exactly when the
    last kept order starting before e ends after s. One binary search per
    order, O(k log k) for a chain of k orders. A component holding an order
    that ends before it starts keeps the plain linear check."""
    import bisect

    import numpy as np
    import pandas as pd

    key = ["car", "component_lo", "component_id"]
    size = pdf.groupby(key, sort=False)["id"].transform("size")
    accepted = np.ones(len(pdf), dtype=bool)
    multi = pdf[size.to_numpy() > 1].sort_values([*key, "id"])
    position = {i: k for k, i in enumerate(pdf["id"].to_numpy())}
    for _, g in multi.groupby(key, sort=False):
        ids = g["id"].to_numpy()
        starts = g["start_at"].to_numpy().astype("int64")
        ends = g["end_at"].to_numpy().astype("int64")
        if (ends < starts).any():
            kept_pairs: list[tuple] = []
            for i, st, en in zip(ids, starts, ends):
                if any(st < ke and en > ks for ks, ke in kept_pairs):
                    accepted[position[i]] = False
                else:
                    kept_pairs.append((st, en))
            continue
        kept: list[tuple] = []  # (start, end), sorted
        kept_starts: list[int] = []
        for i, st, en in zip(ids, starts, ends):
            k = bisect.bisect_left(kept_starts, en)  # kept orders starting before en
            if k > 0 and kept[k - 1][1] > st:
                accepted[position[i]] = False
                continue
            at = bisect.bisect_right(kept, (st, en))
            kept.insert(at, (st, en))
            kept_starts.insert(at, st)
    return pd.DataFrame({"id": pdf["id"].astype("int64").to_numpy(), "accepted": accepted})


def later_overlaps(pdf):
    """Replace policy for whole overlap components, without pairs: an order
    is replaced when some later order (higher id) of its component overlaps
    it. Orders are walked from the latest down; a Fenwick tree over the
    component's sorted starts holds the greatest end among the later orders,
    so "a later order starts before my end and ends after my start" is one
    prefix-maximum query. O(k log k) per component, exact for any intervals."""
    import bisect

    import numpy as np
    import pandas as pd

    key = ["car", "component_lo", "component_id"]
    replaced = np.zeros(len(pdf), dtype=bool)
    position = {i: k for k, i in enumerate(pdf["id"].to_numpy())}
    size = pdf.groupby(key, sort=False)["id"].transform("size")
    multi = pdf[size.to_numpy() > 1].sort_values([*key, "id"], ascending=[True, True, True, False])
    for _, g in multi.groupby(key, sort=False):
        ids = g["id"].to_numpy()
        starts = g["start_at"].to_numpy().astype("int64")
        ends = g["end_at"].to_numpy().astype("int64")
        order = sorted(set(starts.tolist()))
        tree = [None] * (len(order) + 1)  # 1-based Fenwick tree of prefix maxima
        for i, st, en in zip(ids, starts, ends):
            k = bisect.bisect_left(order, en)  # later orders starting before en
            best = None
            while k > 0:
                if tree[k] is not None and (best is None or tree[k] > best):
                    best = tree[k]
                k -= k & -k
            if best is not None and best > st:
                replaced[position[i]] = True
            k = bisect.bisect_left(order, st) + 1
            while k <= len(order):
                if tree[k] is None or en > tree[k]:
                    tree[k] = en
                k += k & -k
    return pd.DataFrame({"id": pdf["id"].astype("int64").to_numpy(), "replaced": replaced})


def _stream_components(batches, fn):
    """Stream a partition sorted by component through ``fn``: only the last,
    possibly unfinished component is carried from batch to batch, as a list of
    its pieces that is joined once, so memory holds one batch plus one
    component and a long component costs linear time."""
    import pandas as pd

    key, pending, of = ["car", "component_lo", "component_id"], [], None
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf.iloc[-1]
        same = (pdf[key] == last[key]).all(axis=1).to_numpy()
        done, own = pdf[~same], tuple(last[key])
        if pending and (len(done) or own != of):
            yield fn(pd.concat([*pending, done], ignore_index=True))
            pending = []
        elif len(done):
            yield fn(done.reset_index(drop=True))
        pending.append(pdf[same])
        of = own
    if pending:
        yield fn(pd.concat(pending, ignore_index=True))


def replay_partition(batches):
    """``mapInPandas`` body for the refuse policy (see ``accept_in_order``)."""
    yield from _stream_components(batches, accept_in_order)


def sweep_partition(batches):
    """``mapInPandas`` body for the replace policy (see ``later_overlaps``)."""
    yield from _stream_components(batches, later_overlaps)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
