"""Vehicle trip log: overlaps, replacement, status, availability, upkeep.

A trip is a row ``(id, car, driver, leader, dest, start_at, end_at,
km_start, km_end)``; ids grow with the time an order was entered, so a
higher id is a later order. ``as_of`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterbook.functions.dates import ntz
from waterbook.operators.intervals import overlap_components, overlapping_pairs, with_overlap
from waterbook.operators.pieces import split_long
from waterbook.operators.replay import COMPONENT_KEY, replay_partition, sweep_partition
from waterbook.operators.upsert import delete_by_key, latest_per_key, update_by_key
from waterbook.params import FleetParams
from waterbook.sources import literals as L


def trip_validation(trips: DataFrame) -> DataFrame:
    """Required fields of an order: start, end and destination. A trip that
    ends before it starts passes that rule, so it is flagged separately."""
    dest_ok = F.col("dest").isNotNull() & (F.col("dest") != "")
    valid = F.col("start_at").isNotNull() & F.col("end_at").isNotNull() & dest_ok
    return trips.select(
        "id",
        "car",
        valid.alias("is_valid"),
        F.coalesce(F.col("end_at") < F.col("start_at"), F.lit(False)).alias("bad_interval"),
    )


def trip_overlaps(trips: DataFrame, p: FleetParams) -> DataFrame:
    """Pairs of trips of the same car whose times overlap (half-open:
    touching end-to-start is not an overlap). One row per unordered pair."""
    return overlapping_pairs(trips, "car", "id", "start_at", "end_at", p.overlap_bucket_minutes)


def trips_after_replacement(trips: DataFrame, p: FleetParams, method: str = "pairs") -> DataFrame:
    """Replace policy: a later order removes earlier overlapping orders of
    the same car. A trip survives exactly when no later trip of its car
    overlaps it, whether or not that later trip survives.

    ``method="pairs"`` (default, all JVM): a semi join finds the orders that
    a later one overlaps, and an anti join drops them; no pair becomes a row.
    ``method="sweep"``: no bucket join either; per
    overlap component a sweep over later orders (``later_overlaps``), for
    data where many orders of a car overlap each other."""
    if method == "pairs":
        replaced = with_overlap(trips, trips, "car", "id", "start_at", "end_at", "later", p.overlap_bucket_minutes)
        return trips.join(replaced, "id", "left_anti")
    if method != "sweep":
        raise ValueError("method must be 'pairs' or 'sweep'")
    comps = overlap_components(trips, "car", "id", "start_at", "end_at", bucket_minutes=1440)
    keyed = trips.select("id", "car", "start_at", "end_at").join(comps, ["car", "id"])
    ordered = keyed.repartition(*COMPONENT_KEY).sortWithinPartitions(*COMPONENT_KEY, "id")
    flags = ordered.mapInPandas(sweep_partition, schema="id long, replaced boolean")
    return trips.join(flags.where(F.col("replaced")).select("id"), "id", "left_anti")


def order_conflicts(orders: DataFrame, log: DataFrame, p: FleetParams, which: str = "earlier") -> DataFrame:
    """Per order, whether a trip of the log (entered ``earlier``, ``later``
    or any ``other``) holds its car at the same time: the yes/no check before
    an order is saved."""
    hit = with_overlap(orders, log, "car", "id", "start_at", "end_at", which, p.overlap_bucket_minutes)
    flagged = orders.join(hit.withColumn("conflict", F.lit(True)), "id", "left")
    return flagged.select("id", "car", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def trips_after_refusal(trips: DataFrame, p: FleetParams, max_piece: int = 20_000) -> DataFrame:
    """Refuse policy: an order is kept only if it overlaps no *kept* earlier
    order of its car (the user declines to delete the old one).

    Sequential by nature, but only within a connected component of a car's
    overlap graph: orders in different components never interact.
    ``overlap_components`` labels the components with a two-level prefix
    scan (no task sorts all orders of a car). Orders are then hashed by
    component and sorted inside each partition, and ``mapInPandas`` streams
    the Arrow batches: single-order components (the common case) are kept
    in one vectorised step, larger ones are replayed in id order, and only
    one unfinished component is carried between batches. A hot car's
    components spread over the partitions, and one of more than ``max_piece``
    orders is first cut where the lowest id decides (``split_long``, which
    runs jobs at once), so a long chain is replayed by several tasks.
    Orders without both times never conflict."""
    comps = overlap_components(trips, "car", "id", "start_at", "end_at", bucket_minutes=1440)
    keyed = trips.select("id", "car", "start_at", "end_at").join(comps, ["car", "id"])
    left, refused = split_long(keyed.select("id", "car", "start_at", "end_at", *COMPONENT_KEY[1:]), max_piece)
    ordered = left.repartition(*COMPONENT_KEY).sortWithinPartitions(*COMPONENT_KEY, "id")
    decided = ordered.mapInPandas(replay_partition, schema="id long, accepted boolean")
    rejected = decided.where(~F.col("accepted")).select("id").union(refused)
    return trips.join(rejected, "id", "left_anti")


def _on_road(p: FleetParams) -> F.Column:
    now = ntz(p.as_of)
    return (F.col("start_at") <= now) & (now <= F.col("end_at"))


def trip_status(trips: DataFrame, p: FleetParams) -> DataFrame:
    """Per trip: on the road when ``start <= as_of <= end`` (closed), else
    done; the route label from the fixed origin; start and end as text."""
    on_road = F.coalesce(_on_road(p), F.lit(False))
    return trips.select(
        "id",
        "car",
        on_road.alias("on_road"),
        F.when(on_road, F.lit(L.TRIP_ON_ROAD)).otherwise(F.lit(L.TRIP_DONE)).alias("status"),
        F.concat(F.lit(L.TRIP_ORIGIN + L.ROUTE_ARROW), F.col("dest")).alias("route"),
        F.date_format("start_at", "yyyy-MM-dd HH:mm").alias("start_text"),
        F.date_format("end_at", "yyyy-MM-dd HH:mm").alias("end_text"),
    )


def trip_distance(trips: DataFrame) -> DataFrame:
    """Kilometres driven, NULL until the return odometer is entered."""
    dist = F.col("km_end") - F.col("km_start")
    text = F.when(F.col("km_end").isNotNull(), F.concat(dist.cast("string"), F.lit(L.DISTANCE_UNIT))).otherwise(
        F.lit(L.DISTANCE_MISSING)
    )
    return trips.select("id", "car", dist.alias("distance_km"), text.alias("distance_text"))


def on_road_cars(trips: DataFrame, p: FleetParams) -> DataFrame:
    return trips.where(_on_road(p)).select("car").distinct()


def maintenance_overdue(fleet: DataFrame, profiles: DataFrame, p: FleetParams) -> DataFrame:
    """Per fleet car: next maintenance date and whether it is before
    ``as_of``. No profile or no date: not flagged."""
    prof = profiles.select("car", "next_maintenance")
    j = fleet.select("car").join(prof, "car", "left")
    overdue = F.coalesce(F.col("next_maintenance").cast("timestamp_ntz") < ntz(p.as_of), F.lit(False))
    return j.select(
        "car",
        F.col("next_maintenance").isNotNull().alias("has_date"),
        "next_maintenance",
        overdue.alias("overdue"),
    )


def vehicles_available(fleet: DataFrame, trips: DataFrame, profiles: DataFrame, p: FleetParams) -> DataFrame:
    """Fleet cars not on the road at ``as_of``, with the overdue flag."""
    idle = fleet.select("car").join(on_road_cars(trips, p), "car", "left_anti")
    return maintenance_overdue(idle, profiles, p).select("car", "overdue")


def vehicle_history(trips: DataFrame, car=None) -> DataFrame:
    """Trip date, destination and leader per car (one car when given)."""
    t = trips if car is None else trips.where(F.col("car") == F.lit(car))
    return t.select(
        "car",
        "id",
        F.date_format("start_at", "yyyy-MM-dd").alias("trip_date"),
        "dest",
        "leader",
    )


def profile_upsert(profiles: DataFrame, writes: DataFrame) -> DataFrame:
    """Keyed upsert by plate, last write wins. ``writes`` carries the full
    profile and ``(written_at, write_id)`` as its version; stored profiles
    rank below every write."""
    cols = [c for c in profiles.columns if c != "car"]
    stored = profiles.select(
        "car",
        F.lit(None).cast("timestamp_ntz").alias("written_at"),
        F.lit(None).cast("long").alias("write_id"),
        *cols,
    )
    upd = writes.select("car", "written_at", "write_id", *cols)
    latest = latest_per_key(stored.unionByName(upd), "car", ["written_at", "write_id"])
    return latest.select("car", *cols, F.col("written_at").alias("updated_at"))


def trip_completion(trips: DataFrame, returns: DataFrame) -> DataFrame:
    """Set the return odometer on the trips named in ``returns`` (id, km_end)."""
    return update_by_key(trips, returns, "id", ["km_end"])


def trip_deletion(trips: DataFrame, deletes: DataFrame) -> DataFrame:
    """Drop the trips whose id is in ``deletes``."""
    return delete_by_key(trips, deletes, "id")


# -- request sets derived from the tables (used by the registered queries) --------


def returns_due(trips: DataFrame, p: FleetParams) -> DataFrame:
    """Return readings for trips that ended by ``as_of`` without one: the
    odometer advanced by the booked minutes (a stand-in), entered twice."""
    due = trips.where(F.col("km_end").isNull() & (F.col("end_at") <= ntz(p.as_of)))
    # a first reading, and its correction upwards
    first = (F.col("km_start") + F.col("duration_min")).cast("long")
    return due.select("id", F.explode(F.array(first - 1, first)).alias("km_end"))


def cancellations(trips: DataFrame, p: FleetParams) -> DataFrame:
    """Orders that have not started by ``as_of`` and have no return reading."""
    return trips.where(F.col("km_end").isNull() & (F.col("start_at") > ntz(p.as_of))).select("id")
