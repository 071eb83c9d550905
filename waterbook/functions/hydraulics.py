"""Pipe-flushing hydraulics as column expressions (no UDF).

For each job: net head ``H = 10*P + dZ - 10*pig`` (``dZ = z1 - z2``, or 0
on flat terrain), hydraulic radius ``Rh = D/4``, area ``A = pi*D^2/4``,
local-loss factor ``zeta = 0.9*bends90 + 0.4*bends45``, velocity
``v = sqrt(H / (n^2*L/Rh^(4/3) + zeta/(2g)))`` capped at 15 m/s, flow
``Q = v*A``, volume ``W = Q*t`` and local head loss ``zeta*v^2/(2g)``.
The velocity has a closed form, so nothing iterates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waterbook.sources import literals as L

FOUR_THIRDS = 4.0 / 3.0


def height_difference(z_start: Column, z_end: Column, terrain: Column) -> Column:
    return F.when(terrain == F.lit(L.TERRAIN_FLAT), F.lit(0.0)).otherwise(
        F.coalesce(z_start, F.lit(0.0)) - F.coalesce(z_end, F.lit(0.0))
    )


def net_head(pressure_bar: Column, dz: Column, pig_loss_bar: Column) -> Column:
    return pressure_bar * F.lit(L.METRES_PER_BAR) + dz - pig_loss_bar * F.lit(L.METRES_PER_BAR)


def friction_factor(roughness: Column, length_m: Column, diameter_mm: Column) -> Column:
    """``n^2 * L / Rh^(4/3)``; NULL for a zero diameter (infinite loss)."""
    rh = diameter_mm / F.lit(1000.0) / F.lit(4.0)
    rh_pow = F.pow(rh, F.lit(FOUR_THIRDS))
    return F.when(rh_pow > 0, F.pow(roughness, F.lit(2.0)) * length_m / rh_pow)


def local_factor(bends_90: Column, bends_45: Column) -> Column:
    zeta = F.coalesce(bends_90, F.lit(0)) * F.lit(L.BEND_90_LOSS) + F.coalesce(bends_45, F.lit(0)) * F.lit(
        L.BEND_45_LOSS
    )
    return zeta / F.lit(2.0 * L.GRAVITY)


def velocity(head: Column, friction: Column, local: Column) -> Column:
    """Capped velocity. Zero total loss means unbounded speed, so the cap;
    an infinite friction loss (zero diameter) means no flow."""
    loss = friction + local
    raw = F.when(friction.isNull(), F.lit(0.0)).when(loss <= 0, F.lit(L.VELOCITY_CAP)).otherwise(F.sqrt(head / loss))
    # not least(): that would turn a missing velocity into the cap
    return F.when(raw > L.VELOCITY_CAP, F.lit(L.VELOCITY_CAP)).otherwise(raw)


def area(diameter_mm: Column) -> Column:
    d = diameter_mm / F.lit(1000.0)
    return F.pi() * F.pow(d, F.lit(2.0)) / F.lit(4.0)


def local_loss(bends_90: Column, bends_45: Column, v: Column) -> Column:
    zeta = F.coalesce(bends_90, F.lit(0)) * F.lit(L.BEND_90_LOSS) + F.coalesce(bends_45, F.lit(0)) * F.lit(
        L.BEND_45_LOSS
    )
    return zeta * (F.pow(v, F.lit(2.0)) / F.lit(2.0 * L.GRAVITY))


def quantize(x: Column, places: int = 6) -> Column:
    """Round to ``places`` decimals through an integer, so two engines whose
    ``pow`` differ in the last bit still print the same value."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
