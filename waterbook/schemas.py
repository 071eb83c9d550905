"""Explicit schemas of the domain tables and JSON sources (no inference)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
TS, D, DBL = T.TimestampNTZType(), T.DateType(), T.DoubleType()
VOL = T.DecimalType(18, 2)

#: Type of every sum of volumes; reports keep it, presentation rounds.
SUM_TYPE = "decimal(28,2)"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CUSTOMER = _struct(
    ("customer_id", L),
    ("street_code", S),
    ("meter_code", S),
    ("street_sub", I),
    ("name", S),
    ("region_code", S),
    ("class_code", S),
)
STREET = _struct(("street_code", S), ("street_sub", I))
CONSUMPTION = _struct(
    ("bill_id", L),
    ("customer_id", L),
    ("year", I),
    ("month", I),
    ("volume", VOL),
    ("is_cancelled", I),
    ("purpose_code", S),
    ("pay_channel", S),
    ("cashier", S),
    ("posted_at", D),
    ("paid_at", D),
    ("is_paid", I),
    ("bill_mode", I),
    ("amount_1", T.DecimalType(18, 2)),
    ("amount", T.DecimalType(18, 2)),
)
LARGE_READING = _struct(("customer_code", S), ("name", S), ("region_code", S), ("read_at", TS), ("volume", VOL))
TRIP = _struct(
    ("id", L),
    ("car", S),
    ("driver", S),
    ("leader", S),
    ("dest", S),
    ("start_at", TS),
    ("end_at", TS),
    ("duration_min", I),
    ("km_start", L),
    ("km_end", L),
)
FLEET = _struct(("car", S))
VEHICLE_PROFILE = _struct(
    ("car", S), ("seats", I), ("year_made", I), ("next_maintenance", D), ("next_inspection", S)
)
PROFILE_WRITE = _struct(
    ("car", S),
    ("written_at", TS),
    ("write_id", L),
    ("seats", I),
    ("year_made", I),
    ("next_maintenance", D),
    ("next_inspection", S),
)
FLUSH_JOB = _struct(
    ("id", L),
    ("length_m", DBL),
    ("diameter_mm", DBL),
    ("roughness", DBL),
    ("pressure_bar", DBL),
    ("z_start", DBL),
    ("z_end", DBL),
    ("terrain", S),
    ("bends_90", I),
    ("bends_45", I),
    ("pig_loss_bar", DBL),
    ("start_min", I),
    ("end_min", I),
    ("material", S),
    ("pig_type", S),
)

DOMAIN = {
    "customer": CUSTOMER,
    "street": STREET,
    "consumption": CONSUMPTION,
    "large_reading": LARGE_READING,
    "trip": TRIP,
    "fleet": FLEET,
    "vehicle_profile": VEHICLE_PROFILE,
    "profile_write": PROFILE_WRITE,
    "flush_job": FLUSH_JOB,
}

# Trip form as stored by the browser tool: every value is text.
TRIP_JSON = _struct(
    ("id", L),
    ("car", S),
    ("driver", S),
    ("leader", S),
    ("dest", S),
    ("start", S),
    ("end", S),
    ("kmStart", S),
    ("pass", S),
    ("kmEnd", S),
)
# Trip log as stored by the order stream (typed form fields, plate as text).
TRIP_LOG = _struct(
    ("id", L),
    ("car", S),
    ("driver", S),
    ("leader", S),
    ("dest", S),
    ("passengers", S),
    ("start_at", TS),
    ("end_at", TS),
    ("km_start", VOL),
    ("km_end", VOL),
)
_PROFILE_FIELDS = [
    ("name", S),
    ("brand", S),
    ("seats", S),
    ("y1", S),
    ("y2", S),
    ("place", S),
    ("type", S),
    ("nextM", S),
    ("nextR", S),
]
PROFILE_JSON_LINE = _struct(("car", S), *_PROFILE_FIELDS)
PROFILE_JSON_MAP = T.MapType(S, _struct(*_PROFILE_FIELDS))
