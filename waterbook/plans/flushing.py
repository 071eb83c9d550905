"""Pipe-flushing flow and volume over a whole table of jobs.

Pure column arithmetic: one narrow projection, no shuffle, no UDF. Rows
that the calculator would refuse carry an ``invalid_reason`` and NULL
results instead of being dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterbook.functions import hydraulics as H
from waterbook.functions.codes import norm
from waterbook.functions.dates import clock_seconds


def flush_volume(jobs: DataFrame, quantize_places: int | None = None) -> DataFrame:
    """Per job: height difference, net head, friction and local factors,
    velocity (m/s, capped), flow (l/s), local head loss (m), duration (s)
    and flushed volume (m3).

    ``invalid_reason``: ``missing_input`` (length, diameter, roughness,
    pressure, pig loss or a time missing), ``bad_length`` (not positive),
    ``bad_diameter`` or ``bad_roughness`` (negative), ``bad_duration`` (not
    after the start, equal times included), ``low_head`` (net head <= 0);
    results are then NULL. Missing elevations and bends count as 0.
    ``quantize_places`` rounds the double results through an integer so that
    two engines print them identically; full precision by default.
    """
    c = F.col
    seconds = clock_seconds(c("start_min"), c("end_min"))
    dz = H.height_difference(c("z_start"), c("z_end"), c("terrain"))
    head = H.net_head(c("pressure_bar"), dz, c("pig_loss_bar"))
    missing = (
        c("length_m").isNull()
        | c("diameter_mm").isNull()
        | c("roughness").isNull()
        | c("pressure_bar").isNull()
        | c("pig_loss_bar").isNull()
        | c("start_min").isNull()
        | c("end_min").isNull()
    )
    reason = (
        F.when(missing, F.lit("missing_input"))
        .when(c("length_m") <= 0, F.lit("bad_length"))
        .when(c("diameter_mm") < 0, F.lit("bad_diameter"))
        .when(c("roughness") < 0, F.lit("bad_roughness"))
        .when(seconds <= 0, F.lit("bad_duration"))
        .when(head <= 0, F.lit("low_head"))
    )
    base = jobs.select(
        "id",
        reason.alias("invalid_reason"),
        dz.alias("dz"),
        head.alias("net_head"),
        H.friction_factor(c("roughness"), c("length_m"), c("diameter_mm")).alias("friction"),
        H.local_factor(c("bends_90"), c("bends_45")).alias("local"),
        H.area(c("diameter_mm")).alias("area"),
        seconds.alias("duration_s"),
        "bends_90",
        "bends_45",
    )
    ok = c("invalid_reason").isNull()
    v = H.velocity(c("net_head"), c("friction"), c("local"))
    with_v = base.withColumn("velocity", F.when(ok, v))
    flow = c("velocity") * c("area")
    out = with_v.select(
        "id",
        "invalid_reason",
        "dz",
        "net_head",
        F.when(ok, c("friction")).alias("friction_factor"),
        F.when(ok, c("local")).alias("local_factor"),
        "velocity",
        (flow * F.lit(1000.0)).alias("flow_lps"),
        H.local_loss(c("bends_90"), c("bends_45"), c("velocity")).alias("local_loss_m"),
        F.when(ok, c("duration_s")).alias("duration_s"),
        (flow * c("duration_s")).alias("volume_m3"),
    )
    if quantize_places is None:
        return out
    doubles = ["dz", "net_head", "friction_factor", "local_factor", "velocity", "flow_lps", "local_loss_m", "volume_m3"]
    return out.select(*[H.quantize(c(x), quantize_places).alias(x) if x in doubles else c(x) for x in out.columns])


def resolve_codes(jobs: DataFrame) -> DataFrame:
    """Fill ``roughness`` from a ``material`` code and ``pig_loss_bar`` from a
    ``pig_type`` code where the number is missing (the calculator's option
    lists). A lookup in a literal map, so no join."""
    from waterbook.sources import literals as L

    out = jobs
    if "material" in jobs.columns:
        m = F.create_map(*[F.lit(x) for code, _, n in L.PIPE_MATERIALS for x in (code, n)])
        current = F.col("roughness") if "roughness" in jobs.columns else F.lit(None).cast("double")
        out = out.withColumn("roughness", F.coalesce(current, F.try_element_at(m, norm("material"))))
    if "pig_type" in jobs.columns:
        m = F.create_map(*[F.lit(x) for code, _, n in L.PIG_TYPES for x in (code, n)])
        current = F.col("pig_loss_bar") if "pig_loss_bar" in out.columns else F.lit(None).cast("double")
        out = out.withColumn("pig_loss_bar", F.coalesce(current, F.try_element_at(m, norm("pig_type"))))
    return out
