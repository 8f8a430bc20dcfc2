"""Column expressions for phases, circular means and models of instrumental effects."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants and units.
LIGHT = 2.99792458e8
TEC_PHASE = -8.44797245e9
TEC3_PHASE = -1e21
MAD_SIGMA = 1.4826
UNITS = {"": 1.0, "s": 1.0, "ks": 1e3, "ms": 1e6, "hz": 1.0, "khz": 1e3, "mhz": 1e6}

TURN = 2 * math.pi


def wrap(x: Column) -> Column:
    """Into [-pi, pi)."""
    return x - TURN * F.floor((x + math.pi) / TURN)


def normalize_phase(x: Column) -> Column:
    """Into [-pi, pi], both ends kept: the remainder of truncated division, then one turn back where needed."""
    y = x % F.lit(TURN)
    return F.when(y < -math.pi, y + TURN).when(y > math.pi, y - TURN).otherwise(y)


def wrap_rotation(x: Column) -> Column:
    """Into [-pi/2, pi/2)."""
    return x - math.pi * F.floor((x + math.pi / 2) / math.pi)


def log10_positive(x: Column) -> Column:
    """The decimal logarithm; null for what isn't above 0."""
    return F.when(x > 0, F.log10(x))


def circular_mean(x: Column, weight: Column | None = None) -> Column:
    """An aggregate: the angle of the (weighted) sum of unit vectors."""
    w = F.lit(1.0) if weight is None else weight
    return F.atan2(F.sum(w * F.sin(x)), F.sum(w * F.cos(x)))


def circular_variance(x: Column) -> Column:
    """An aggregate: 1 - R."""
    return 1 - F.hypot(F.avg(F.cos(x)), F.avg(F.sin(x)))


def circular_std(x: Column) -> Column:
    """An aggregate: sqrt(-2 ln R)."""
    return F.sqrt(-2 * F.ln(F.hypot(F.avg(F.cos(x)), F.avg(F.sin(x)))))


def phase_model(kind: str, x: Column, freq: Column, first_pol: Column | None = None) -> Column:
    """The phase (or rotation) that a solution of another kind causes at a frequency in Hz."""
    if kind == "clock":
        return TURN * x * freq
    if kind == "tec":
        return TEC_PHASE * x / freq
    if kind == "tec3rd":
        return TEC3_PHASE * x / (freq * freq * freq)
    if kind == "rotationmeasure":
        angle = F.pow(LIGHT / freq, F.lit(2)) * x
        return angle if first_pol is None else F.when(first_pol, -angle).otherwise(angle)
    return x


def quantity(text: str) -> float:
    """A number with an optional unit: s, ks, ms (mega), Hz, kHz, MHz."""
    import re

    m = re.fullmatch(r"\s*([0-9.eE+-]+?)\s*([A-Za-z]*)\s*", str(text))
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"can't read the quantity {text!r}")
    return float(m[1]) * UNITS[m[2].lower()]


def station_class(ant: Column) -> Column:
    """CS, RS or other."""
    return F.when(ant.contains("CS"), "CS").when(ant.contains("RS"), "RS").otherwise("other")


def longitude(x: Column, y: Column) -> Column:
    """Degrees east of a place given from the earth's centre."""
    return F.degrees(F.atan2(y, x))


def latitude(x: Column, y: Column, z: Column) -> Column:
    """Geocentric degrees north of a place given from the earth's centre."""
    return F.degrees(F.atan2(z, F.hypot(x, y)))


def first_good(value: Column, weight: Column, axis: Column) -> Column:
    """The first value along an axis that is neither flagged nor null (an aggregate)."""
    ok = (weight != 0) & value.isNotNull()
    return F.min_by(F.when(ok, value), F.when(ok, axis))
